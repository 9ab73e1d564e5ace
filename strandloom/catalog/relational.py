"""Queries over pools, masks, set operations, lineage, chains and the cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.catalog import tables as t
from strandloom.constants import BUCKET, OFFSET, POSE
from strandloom.operators import cascade, chains, identity, lineage, pool, select
from strandloom.staging import row_bound, together, with_bound

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


POSES = "conformer, rotamer, gx, gy, gz"


@query(
    "pool_canonical_order",
    f"WITH {t.ORDERS} SELECT pose_id, {POSES}, mx, my, mz, ox, oy, oz, source_id FROM order_pool",
)
def pool_canonical_order(spark, sf_dir):
    return t.orders(spark, sf_dir).select("pose_id", *POSE, *BUCKET, *OFFSET, "source_id")


@query(
    "pool_canonical_order_with_copies",
    f"WITH {t.LINES} SELECT pose_id, {POSES}, source_id, l_linenumber, l_partkey FROM lines",
)
def pool_canonical_order_with_copies(spark, sf_dir):
    return t.lines(spark, sf_dir).select("pose_id", *POSE, "source_id", "l_linenumber", "l_partkey")


@query(
    "pool_bucket_counts",
    f"WITH {t.LINES} SELECT mx, my, mz, ox, oy, oz, CAST(count(*) AS BIGINT) AS poses "
    "FROM lines GROUP BY ALL",
)
def pool_bucket_counts(spark, sf_dir):
    return pool.bucket_counts(pool.with_buckets(t.line_poses(spark, sf_dir)))


@query(
    "pool_bucket_starts",
    f"WITH {t.LINES}, c AS (SELECT mx, my, mz, count(*) AS n, count(DISTINCT (ox, oy, oz)) AS o "
    "FROM lines GROUP BY ALL) SELECT mx, my, mz, CAST(n AS BIGINT) AS poses, CAST(o AS BIGINT) AS offsets, "
    "CAST(sum(n) OVER (ORDER BY mx, my, mz) - n AS BIGINT) AS first_id FROM c",
)
def pool_bucket_starts(spark, sf_dir):
    return pool.bucket_starts(t.lines(spark, sf_dir))


@query(
    "pool_selection_in_request_order",
    f"WITH {t.ORDERS} SELECT e.event_id AS request_pos, p.pose_id, {POSES} FROM events e JOIN order_pool p "
    "ON p.pose_id = (e.event_id * 7919 + e.user_id) % (SELECT count(*) FROM orders)",
)
def pool_selection_in_request_order(spark, sf_dir):
    orders = t.orders(spark, sf_dir)
    rows = row_bound(orders)
    requests = t.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_pos"),
        ((F.col("event_id") * 7919 + F.col("user_id")) % rows).alias("pose_id"),
    )
    return pool.select_poses(orders, requests).select("request_pos", "pose_id", *POSE)


@query(
    "conformer_runs",
    f"WITH {t.LINES}, c AS (SELECT conformer, count(*) AS n FROM lines GROUP BY conformer) "
    "SELECT conformer, CAST(n AS BIGINT) AS poses, "
    "CAST(sum(n) OVER (ORDER BY conformer) - n AS BIGINT) AS start FROM c",
)
def conformer_runs(spark, sf_dir):
    return pool.run_starts(pool.conformer_runs(t.line_poses(spark, sf_dir)))


@query("score_mask", f"WITH {t.ORDERS} SELECT pose_id FROM order_pool WHERE score < -100.0")
def score_mask(spark, sf_dir):
    return select.mask(t.orders(spark, sf_dir), -100.0)


def _below_zero(orders):
    """Orders with a negative score; the score column belongs to the same pool."""
    rows = row_bound(orders)
    scores = with_bound(orders.select("pose_id", "score"), rows)
    return select.filter_by_score(with_bound(orders.drop("score"), rows), scores, 0.0)


_KEPT = (
    "kept AS (SELECT CAST(row_number() OVER (ORDER BY pose_id) - 1 AS BIGINT) AS pose_id, "
    f"pose_id AS parent_id, {POSES} FROM order_pool WHERE score < 0.0)"
)


@query(
    "score_filter_with_provenance",
    f"WITH {t.ORDERS}, {_KEPT} SELECT pose_id, parent_id, {POSES} FROM kept",
)
def score_filter_with_provenance(spark, sf_dir):
    orders = t.orders(spark, sf_dir)
    kept = _below_zero(orders)
    return kept.select("pose_id", "parent_id", *POSE)


@query(
    "index_filter_keeps_copies",
    f"WITH {t.ORDERS}, i AS (SELECT (event_id * 7919 + user_id) % (SELECT count(*) FROM orders) AS id FROM events) "
    f"SELECT CAST(row_number() OVER (ORDER BY pose_id) - 1 AS BIGINT) AS pose_id, pose_id AS parent_id, {POSES} "
    "FROM order_pool JOIN i ON i.id = pose_id",
)
def index_filter_keeps_copies(spark, sf_dir):
    orders = t.orders(spark, sf_dir)
    index = t.read(spark, sf_dir, "events").select(
        ((F.col("event_id") * 7919 + F.col("user_id")) % row_bound(orders)).alias("pose_id")
    )
    return select.filter_by_index(orders, index).select("pose_id", "parent_id", *POSE)


@query(
    "select_by_rmsd",
    f"WITH {t.ORDERS} SELECT CAST(row_number() OVER (ORDER BY score / 100.0, pose_id) - 1 AS BIGINT) "
    "AS request_pos, pose_id, score / 100.0 AS rmsd FROM order_pool WHERE score / 100.0 < 1.5",
)
def select_by_rmsd(spark, sf_dir):
    rmsds = t.orders(spark, sf_dir).select("pose_id", (F.col("score") / 100.0).alias("rmsd"))
    return select.select_by_rmsd(rmsds, 1.5).select("request_pos", "pose_id", "rmsd")


@query(
    "score_sum",
    f"WITH {t.ORDERS} SELECT pose_id, score + source_id * 0.5::DOUBLE AS score FROM order_pool",
)
def score_sum(spark, sf_dir):
    orders = t.orders(spark, sf_dir)
    second = orders.select("pose_id", (F.col("source_id") * F.lit(0.5)).alias("score"))
    return pool.score_add(orders.select("pose_id", "score"), second)


@query(
    "common_conformer_masks",
    f"WITH {t.CUSTOMERS}, {t.ORDERS} SELECT 1 AS side, pose_id FROM customers "
    "WHERE conformer IN (SELECT conformer FROM order_pool) UNION ALL SELECT 2, pose_id FROM order_pool "
    "WHERE conformer IN (SELECT conformer FROM customers)",
)
def common_conformer_masks(spark, sf_dir):
    one, two = select.common_conformer_masks(t.customers(spark, sf_dir), t.orders(spark, sf_dir))
    return one.select(F.lit(1).alias("side"), "pose_id").unionByName(
        two.select(F.lit(2).alias("side"), "pose_id")
    )


@query(
    "apply_conformer_mask",
    f"WITH {t.CUSTOMERS}, {t.ORDERS} SELECT CAST(row_number() OVER (ORDER BY pose_id) - 1 AS BIGINT) AS pose_id, "
    f"pose_id AS parent_id, {POSES} FROM customers WHERE conformer IN (SELECT conformer FROM order_pool)",
)
def apply_conformer_mask(spark, sf_dir):
    one = t.customers(spark, sf_dir)
    mask, _ = select.common_conformer_masks(one, t.orders(spark, sf_dir))
    applied = select.apply_mask(one, mask, pool.fingerprint(one))
    return applied.select("pose_id", "parent_id", *POSE)


_SHARED = (
    f"shared AS (SELECT CAST(row_number() OVER (ORDER BY mx, my, mz, ox, oy, oz, conformer, rotamer) - 1 AS BIGINT) "
    f"AS pose_id, {POSES} FROM (SELECT {POSES}, mx, my, mz, ox, oy, oz FROM lines INTERSECT "
    f"SELECT {POSES}, mx, my, mz, ox, oy, oz FROM order_lines))"
)
_IDENTITY = f"WITH {t.LINES}, {t.ORDER_LINES}, {_SHARED}"


def _identity(spark, sf_dir):
    one, two = t.lines(spark, sf_dir), t.orders_in_line_frame(spark, sf_dir)
    return one, two, identity.intersect_pools(one, two)


@query("identity_pool", f"{_IDENTITY} SELECT pose_id, {POSES} FROM shared")
def identity_pool(spark, sf_dir):
    return _identity(spark, sf_dir)[2][0].select("pose_id", *POSE)


def _map_sql(pool_name):
    return (
        f"SELECT p.pose_id AS parent_id, s.pose_id FROM {pool_name} p JOIN shared s "
        "USING (conformer, rotamer, gx, gy, gz)"
    )


@query("identity_map_one", f"{_IDENTITY} {_map_sql('lines')}")
def identity_map_one(spark, sf_dir):
    return _identity(spark, sf_dir)[2][1]


@query("identity_map_two", f"{_IDENTITY} {_map_sql('order_lines')}")
def identity_map_two(spark, sf_dir):
    return _identity(spark, sf_dir)[2][2]


@query(
    "identity_manifest",
    f"{_IDENTITY}, b AS (SELECT mx, my, mz FROM lines INTERSECT SELECT mx, my, mz FROM order_lines) "
    "SELECT 'identity_poses' AS measure, CAST(count(*) AS BIGINT) AS poses FROM shared "
    "UNION ALL SELECT 'input_poses_one', count(*) FROM lines "
    "UNION ALL SELECT 'input_poses_two', count(*) FROM order_lines "
    "UNION ALL SELECT 'kept_poses_one', count(*) FROM lines JOIN b USING (mx, my, mz) "
    "UNION ALL SELECT 'kept_poses_two', count(*) FROM order_lines JOIN b USING (mx, my, mz)",
)
def identity_manifest(spark, sf_dir):
    one, two, (output, _, _) = _identity(spark, sf_dir)
    return identity.manifest(one, two, output)


@query(
    "deduplicate_map",
    f"WITH {t.LINES} SELECT pose_id AS parent_id, CAST(dense_rank() OVER (ORDER BY mx, my, mz, ox, oy, oz, "
    "conformer, rotamer) - 1 AS BIGINT) AS pose_id FROM lines",
)
def deduplicate_map(spark, sf_dir):
    return identity.deduplicate(t.lines(spark, sf_dir))[1]


@query("identity_of_a_pool_with_itself_map_two", SQL["deduplicate_map"])
def identity_of_a_pool_with_itself_map_two(spark, sf_dir):
    lines = t.lines(spark, sf_dir)
    return identity.intersect_pools(lines, lines)[2]


@query(
    "pose_occurrences",
    f"WITH {t.LINES} SELECT {POSES}, CAST(count(*) AS BIGINT) AS poses, min(pose_id) AS first_id "
    "FROM lines GROUP BY ALL",
)
def pose_occurrences(spark, sf_dir):
    return identity.occurrences(t.lines(spark, sf_dir))


def _parents(children, parents, key):
    """Parent ids through the key the child rows carry."""
    keys = parents.select(F.col("pose_id").alias("parent_id"), F.col("source_id").alias(key))
    # The keys are unique, so there is at most one parent per child.
    return with_bound(children.join(keys, key).select("pose_id", "parent_id"), row_bound(children))


@query(
    "lineage_lines_to_customers",
    f"WITH {t.CUSTOMERS}, {t.ORDERS}, {t.LINES}, {_KEPT} SELECT l.pose_id, c.pose_id AS parent_id FROM lines l "
    "JOIN order_pool o ON o.source_id = l.source_id JOIN kept k ON k.parent_id = o.pose_id "
    "JOIN customers c ON c.source_id = o.parent_key",
)
def lineage_lines_to_customers(spark, sf_dir):
    customers, orders, lines = (f(spark, sf_dir) for f in (t.customers, t.orders, t.lines))
    kept = _below_zero(orders)
    # Lines grow from the filtered orders; the filter keeps the id of each order.
    kept_orders = kept.join(
        orders.select(F.col("pose_id").alias("parent_id"), "source_id"), "parent_id"
    )
    route = [
        _parents(lines, kept_orders, "source_id"),
        lineage.relation(kept),
        _parents(orders, customers, "parent_key"),
    ]
    return lineage.compose_route(route)


@query(
    "lineage_propagated_through_copies",
    f"WITH {t.ORDERS}, {t.LINES} SELECT DISTINCT o.pose_id AS grow_source, "
    "CAST(d.pose_id AS BIGINT) AS pose FROM (SELECT source_id, dense_rank() OVER (ORDER BY mx, my, mz, ox, oy, oz, "
    "conformer, rotamer) - 1 AS pose_id FROM lines) d JOIN order_pool o ON o.source_id = d.source_id",
)
def lineage_propagated_through_copies(spark, sf_dir):
    orders, lines = t.orders(spark, sf_dir), t.lines(spark, sf_dir)
    _, copies = identity.deduplicate(lines)
    return lineage.propagate([copies, _parents(lines, orders, "source_id")], functional=False)


@query(
    "link_edges_between_representatives",
    f"WITH {t.ORDERS}, {t.LINES}, {_KEPT} SELECT k.pose_id AS low, l.pose_id AS high FROM kept k "
    "JOIN order_pool o ON o.pose_id = k.parent_id JOIN lines l ON l.source_id = o.source_id",
)
def link_edges_between_representatives(spark, sf_dir):
    orders, lines = t.orders(spark, sf_dir), t.lines(spark, sf_dir)
    kept = _below_zero(orders)
    return lineage.link_edges(
        [lineage.relation(kept)], [_parents(lines, orders, "source_id")]
    )


def _layers(spark, sf_dir):
    # Chains use the poses and the keys that link them.
    needed = {t.customers: ["source_id"], t.orders: ["source_id", "parent_key"], t.lines: ["source_id"]}
    pools = together(*[lambda f=f, keys=keys: f(spark, sf_dir, [*POSE, *keys]) for f, keys in needed.items()])
    customers, orders, lines = pools
    edges = [
        lineage.link_edges([], [_parents(orders, customers, "parent_key")]),
        lineage.link_edges([], [_parents(lines, orders, "source_id")]),
    ]
    return chains.connect(["frag1", "frag2", "frag3"], pools, edges)


def _node_sql(name, pool_name):
    return (
        f"{name} AS (SELECT pose_id, source_id, dense_rank() OVER (ORDER BY conformer, rotamer, gx, gy, gz) "
        f"AS node FROM {pool_name})"
    )


_CHAINS = (
    f"WITH {t.CUSTOMERS}, {t.ORDERS}, {t.LINES}, "
    "alive_orders AS (SELECT * FROM order_pool o WHERE EXISTS (SELECT 1 FROM lines l WHERE l.source_id = o.source_id) "
    "AND EXISTS (SELECT 1 FROM customers c WHERE c.source_id = o.parent_key)), "
    "alive_customers AS (SELECT * FROM customers c WHERE EXISTS (SELECT 1 FROM alive_orders o "
    "WHERE o.parent_key = c.source_id)), alive_lines AS (SELECT * FROM lines l WHERE EXISTS "
    "(SELECT 1 FROM alive_orders o WHERE o.source_id = l.source_id)), "
    f"{_node_sql('n1', 'alive_customers')}, {_node_sql('n2', 'alive_orders')}, {_node_sql('n3', 'alive_lines')}, "
    "e12 AS (SELECT DISTINCT n1.node AS a, n2.node AS b FROM alive_orders o JOIN n2 USING (pose_id) "
    "JOIN n1 ON n1.source_id = o.parent_key), "
    "e23 AS (SELECT DISTINCT n2.node AS b, n3.node AS c FROM n3 JOIN n2 ON n2.source_id = n3.source_id), "
    "paths AS (SELECT CAST(a AS BIGINT) AS frag1, CAST(b AS BIGINT) AS frag2, CAST(c AS BIGINT) AS frag3 "
    "FROM e12 JOIN e23 USING (b))"
)
_NUMBERED = (
    "numbered AS (SELECT CAST(row_number() OVER (ORDER BY frag1, frag2, frag3) AS BIGINT) AS chain, * FROM paths)"
)


@query(
    "chain_counts",
    f"{_CHAINS} SELECT layer, pool, CAST(n AS BIGINT) AS kept, CAST(n AS BIGINT) AS unique_poses, "
    "CAST((SELECT count(*) FROM paths) AS VARCHAR) AS chains FROM (SELECT 1 AS layer, 'frag1' AS pool, "
    "max(node) AS n FROM n1 UNION ALL SELECT 2, 'frag2', max(node) FROM n2 UNION ALL SELECT 3, 'frag3', max(node) FROM n3)",
)
def chain_counts(spark, sf_dir):
    return chains.chain_counts(_layers(spark, sf_dir))


@query("chain_table", f"{_CHAINS}, {_NUMBERED} SELECT chain, frag1, frag2, frag3 FROM numbered")
def chain_table(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    return chains.number_chains(chains.enumerate_chains(layers), layers.names)


_FOCUS = (
    f"{_CHAINS}, {_NUMBERED}, f AS (SELECT frag1, frag3, min(chain) AS first FROM numbered GROUP BY frag1, frag3), "
    "g AS (SELECT CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS focused, frag1, frag3 FROM f)"
)


def _focus(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    numbered = chains.number_chains(chains.enumerate_chains(layers), layers.names)
    return chains.focus(numbered, ["frag1", "frag3"])


@query("chain_focus", f"{_FOCUS} SELECT focused, frag1, frag3 FROM g")
def chain_focus(spark, sf_dir):
    return _focus(spark, sf_dir)[0]


@query(
    "chain_focus_provenance",
    f"{_FOCUS} SELECT n.chain, g.focused FROM numbered n JOIN g USING (frag1, frag3)",
)
def chain_focus_provenance(spark, sf_dir):
    return _focus(spark, sf_dir)[1]


# Grid energies: the exact energy moved by less than the error bound of the step.
STEPS = [cascade.Step("coarse", 25.0), cascade.Step("fine", 1.0)]


def _energies(spark, sf_dir):
    return t.orders(spark, sf_dir).select(
        "pose_id",
        "source_id",
        F.col("score").alias("energy"),
        (F.col("score") + (F.col("parent_key") % 50 - 25) * 0.99).alias("coarse"),
        (F.col("score") + (F.col("source_id") % 21 - 10) * 0.09).alias("fine"),
    )


@query("energy_filter", f"WITH {t.ORDERS} SELECT pose_id FROM order_pool WHERE score < -40.0")
def energy_filter(spark, sf_dir):
    return cascade.cascade_filter(_energies(spark, sf_dir), -40.0, STEPS, 100)[0]


_BIG = "9007199254740992.0"


@query(
    "energy_cascade_steps",
    f"WITH {t.ORDERS}, e AS (SELECT pose_id, score, source_id % 500 = 0 AS big, score + (parent_key % 50 - 25) * 0.99::DOUBLE AS coarse, "
    "score + (source_id % 21 - 10) * 0.09::DOUBLE AS fine FROM order_pool), "
    "a AS (SELECT *, NOT big AND coarse >= -65 AND coarse < -15 AS stay FROM e), "
    "b AS (SELECT *, fine >= -41 AND fine < -39 AS stay2 FROM a WHERE stay) "
    "SELECT 0 AS step, CAST(count(*) AS BIGINT) AS entered, CAST(count(*) FILTER (big) AS BIGINT) AS unsafe, "
    "CAST(count(*) FILTER (NOT big AND NOT stay) AS BIGINT) AS decided FROM a "
    "UNION ALL SELECT 1, count(*), 0, count(*) FILTER (NOT stay2) FROM b "
    "UNION ALL SELECT NULL, n, 0, n FROM (SELECT (SELECT count(*) FROM a WHERE big) + (SELECT count(*) FROM b WHERE stay2) AS n)",
)
def energy_cascade_steps(spark, sf_dir):
    """Every 500th grid energy is so large that doubles cannot hold the error bound."""
    rows = _energies(spark, sf_dir)
    coarse = F.when(F.col("source_id") % 500 == 0, F.lit(float(_BIG)) * 64).otherwise(F.col("coarse"))
    return cascade.cascade_filter(rows.withColumn("coarse", coarse), -40.0, STEPS, 10)[1]


@query(
    "energy_route_statistics",
    f"WITH {t.ORDERS}, e AS (SELECT pose_id, score + (parent_key % 50 - 25) * 0.99::DOUBLE AS coarse, "
    "score + (source_id % 21 - 10) * 0.09::DOUBLE AS fine FROM order_pool) "
    "SELECT route, CAST(count(*) AS BIGINT) AS poses FROM (SELECT CASE WHEN coarse < -65 THEN 'accept-0' "
    "WHEN coarse >= -15 THEN 'reject-0' WHEN fine < -41 THEN 'accept-1' WHEN fine >= -39 THEN 'reject-1' "
    "ELSE 'exact' END AS route FROM e) GROUP BY route",
)
def energy_route_statistics(spark, sf_dir):
    chunks = cascade.cascade_statistics(
        _energies(spark, sf_dir), -40.0, STEPS, (F.col("pose_id") / 1000).cast("bigint")
    )
    return cascade.total_statistics(chunks)


@query(
    "energy_below_in_all_ranges",
    f"WITH {t.ORDERS} SELECT pose_id FROM order_pool WHERE score < 20.0 AND (source_id % 100) - 60.0 < 20.0",
)
def energy_below_in_all_ranges(spark, sf_dir):
    orders = t.orders(spark, sf_dir)
    second = orders.select("pose_id", (F.col("source_id") % 100 - 60.0).alias("score"))
    return select.all_ranges_below([orders.select("pose_id", "score"), second], 20.0)
