"""Layered path algebra: reachability, collapse, counting and enumeration.

Layers are pools in fragment order; ``edges[j]`` holds ``(low, high)`` pose ids
between layer j and j+1.  Only poses on a complete path survive; then physically
identical poses become one node, and only then are paths counted.  Collapsing can
join routes that no single lineage had; that is intended.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.constants import MAX_INDEX, MIN_GRID, POSE
from strandloom.staging import dense_groups, dense_ids, row_bound, skew_join, stage, together, with_bound


class TooManyChains(ValueError):
    pass


@dataclass
class Layers:
    """Collapsed layers.

    ``nodes[j]`` holds ``(node, first, pose...)``: distinct physical poses numbered 0..n-1
    in pose order, with the least pose id that has them; ``counts[j]`` is their number.
    ``edges[j]`` holds distinct ``(low, high)`` nodes.  ``poses[j]`` holds ``(node, pose...)``
    alone; ``ends`` has, for an outer layer, its edges with the poses of that layer.
    """

    names: list[str]
    nodes: list[DataFrame]
    edges: list[DataFrame]
    counts: list[int]
    poses: list[DataFrame] = field(default_factory=list)
    ends: dict[int, DataFrame] = field(default_factory=dict)


def _keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("_k")).distinct()


def _keep(edges: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return skew_join(
        edges, keys.withColumnRenamed("_k", column), [column], "left_semi"
    )


def prune_edges(edges: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """The edges, written, and the ids of each inner layer that are on a complete path.

    One forward and one backward sweep over ids: an id is alive if edges lead to it from
    the first layer and from it to the last one.  An edge is on a complete path if its
    ends in inner layers are alive; the joins that number these ends drop the others.
    """
    edges = together(*[lambda e=e: stage(e.select("low", "high"), "edges") for e in edges])

    def sweep(steps, near, far, label):
        ids = []
        for e in steps:
            ids.append(stage(_keys(_keep(e, near, ids[-1]) if ids else e, far), label))
        return ids

    forward, backward = together(
        lambda: sweep(edges[:-1], "low", "high", "reached"), lambda: sweep(edges[:0:-1], "high", "low", "leading")
    )
    return edges, [
        stage(_keep(f, "_k", b).withColumnRenamed("_k", "pose_id"), "alive") for f, b in zip(forward, backward[::-1])
    ]


def _nodes(rows: DataFrame, count: int, column: str) -> DataFrame:
    """Distinct poses of numbered rows, each with its least id, which is looked up by the pose."""
    heads = rows.where("_new = 2").select(*POSE, "node")
    least = rows.groupBy(*POSE).agg(F.min(column).alias("first"))
    found = skew_join(heads, least, POSE, left_rows=0, right_rows=0)  # one row a pose on either side
    return with_bound(found.select("node", "first", *POSE), count)


def _poses(rows: DataFrame, count: int) -> DataFrame:
    """Distinct poses of numbered rows, which no join has to find."""
    return with_bound(rows.where("_new = 2").select("node", *POSE), count)


def _collapsed(name: str, pool: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """Nodes of the surviving ids, their poses and number, and ``(pose_id, node)``.

    One sort does it: copies of a pose become neighbours.
    """
    alive = pool.select("pose_id", *POSE)
    if ids is not None:
        alive = alive.join(ids, "pose_id", "left_semi")
    rows, count = dense_groups(alive, POSE, [], ["pose_id"], "node", f"nodes-{name}")
    nodes = _nodes(rows, count, "pose_id")
    return nodes, _poses(rows, count), count, with_bound(rows.select("pose_id", "node"), row_bound(rows))


def _numbered(edge: DataFrame, ends: dict[str, DataFrame]) -> DataFrame:
    """Edges whose ends in ``ends`` are nodes; ``ends`` has the members of either side.

    A pose id has one node, so rows never multiply; ids that are not alive have none.
    """
    rows, placed = row_bound(edge), edge
    for side, members in ends.items():
        node = members.select(F.col("pose_id").alias(side), F.col("node").alias(f"_{side}"))
        placed = skew_join(placed, node, [side], left_rows=rows, right_rows=0, counted=edge).drop(side)
        placed = placed.withColumnRenamed(f"_{side}", side)
    return with_bound(placed, rows)


def _outer(name: str, pool: DataFrame, edge: DataFrame, side: str, other: str, members: DataFrame):
    """Nodes of the first or last layer, their poses and number, and its distinct edges with these poses.

    The one edge set of such a layer brings its ids, so its poses are numbered in the
    same sort that finds equal edges.
    """
    poses = pool.select(F.col("pose_id").alias(side), *POSE)
    near = _numbered(edge, {other: members})
    placed = skew_join(near, poses, [side], left_rows=row_bound(edge), right_rows=0, counted=edge)
    rows, count = dense_groups(placed.select(*POSE, other, side), POSE, [other], [side], "node", f"links-{name}")
    links = rows.where("_new > 0").select(*[F.col("node" if c == side else c).alias(c) for c in ("low", "high")], *POSE)
    return _nodes(rows, count, side), _poses(rows, count), count, with_bound(links, row_bound(rows))


def connect(names: list[str], pools: list[DataFrame], edges: list[DataFrame]) -> Layers:
    """Prune, then collapse identical poses and remap their edges.

    Layers do not wait for each other, nor do edge sets; nodes are numbered as they are made.
    """
    if len(pools) != len(names) or len(edges) != len(pools) - 1:
        raise ValueError("k pools need k names and k-1 edge sets")
    if not edges:
        nodes, poses, count, _ = _collapsed(names[0], pools[0], None)
        return Layers(list(names), [nodes], [], [count], [poses])
    edges, alive = prune_edges(edges)
    last, inner = len(edges), range(1, len(edges))
    if last == 1:
        alive, inner = [_keys(edges[0], "low").withColumnRenamed("_k", "pose_id")], [0]
    collapsed = together(*[lambda j=j, ids=ids: _collapsed(names[j], pools[j], ids) for j, ids in zip(inner, alive)])
    layers = dict(zip(inner, collapsed))
    members = {j: found[3] for j, found in layers.items()}
    ends = {}

    def linked(j):
        if j in (0, last - 1):
            outer, side, other, near = (last, "high", "low", j) if j == last - 1 else (0, "low", "high", 1)
            *layers[outer], ends[outer] = _outer(names[outer], pools[outer], edges[j], side, other, members[near])
            links = with_bound(ends[outer].select("low", "high"), row_bound(ends[outer]))
        else:
            both = _numbered(edges[j], {"low": members[j], "high": members[j + 1]})
            links = stage(both.select("low", "high").distinct(), f"links-{j}")
        return links

    links = together(*[lambda j=j: linked(j) for j in range(last)])
    nodes, poses, counts = ([layers[j][n] for j in range(last + 1)] for n in (0, 1, 2))
    return Layers(list(names), nodes, links, counts, poses, ends)


def count_paths(layers: Layers, max_count: int | None = None) -> int:
    """Number of complete paths; ``max_count + 1`` once that is exceeded.

    Counts are DECIMAL(38,0): they cannot wrap, and overflow is an error.
    """
    if not layers.edges:
        total = layers.counts[0]
        return total if max_count is None else min(total, max_count + 1)

    def capped(column):
        wide = column.cast("decimal(38,0)")
        if max_count is None:
            return wide
        return F.least(wide, F.lit(max_count + 1).cast("decimal(38,0)"))

    # Ways along each edge; those of the last edges are the paths.
    ways = layers.edges[0].withColumn("ways", F.lit(1).cast("decimal(38,0)"))
    for edge in layers.edges[1:]:
        known = ways.groupBy(F.col("high").alias("low")).agg(capped(F.sum("ways")).alias("ways"))
        known = stage(known, "ways")
        ways = skew_join(edge, known, ["low"], right_rows=row_bound(known))
    total = ways.agg(capped(F.sum("ways"))).first()[0]
    return int(total or 0)


def chain_counts(layers: Layers) -> DataFrame:
    """Per layer ``kept`` and ``unique`` (both after collapse) and the path total as text.

    The total may exceed every integer type; text never wraps.
    """
    total = count_paths(layers)
    rows = [(n, name, kept, kept, str(total)) for n, (name, kept) in enumerate(zip(layers.names, layers.counts), 1)]
    return layers.nodes[0].sparkSession.createDataFrame(
        rows, "layer int, pool string, kept bigint, unique_poses bigint, chains string"
    )


def enumerate_chains(layers: Layers, max_chains: int | None = None) -> DataFrame:
    """All paths, one 1-based node number per layer; never a part of them.

    A caller who gives ``max_chains`` gets an error instead of a larger table, from a
    count made before anything is enumerated.
    """
    if max_chains is not None and count_paths(layers, max_chains) > max_chains:
        raise TooManyChains(f"more than {max_chains} chains; raise the limit or filter the pools")
    return path_table(layers)


def path_table(layers: Layers) -> DataFrame:
    """Join the layers into one row per path.

    Each table that is joined again is written, so its rows are known.
    """
    names = layers.names
    if not layers.edges:
        table = layers.nodes[0].select((F.col("node") + 1).alias(names[0]))
        return with_bound(table, row_bound(layers.nodes[0]))
    first = layers.edges[0]
    table = with_bound(
        first.select(F.col("low").alias(names[0]), F.col("high").alias(names[1])), row_bound(first)
    )
    for j, edge in enumerate(layers.edges[1:], start=1):
        step = edge.select(F.col("low").alias(names[j]), F.col("high").alias(names[j + 1]))
        joined = skew_join(
            table, step, [names[j]], left_rows=row_bound(table), right_rows=row_bound(edge)
        )
        table = joined.select(*names[: j + 2])
        if j < len(layers.edges) - 1:
            table = stage(table, "paths")
    return table.select(*[(F.col(n) + 1).alias(n) for n in names])


def packed(layer: int) -> list[str]:
    """The two columns that hold the pose of a layer; they sort like poses."""
    return [f"_pose_{layer}", f"_gz_{layer}"]


def _packed_pose(layer: int) -> list[Column]:
    """Conformer, rotamer, gx and gy as one number, and gz."""
    half = F.lit((MAX_INDEX + 1) // 2)
    fields = [F.col("conformer") - half, F.col("rotamer"), F.col("gx") - MIN_GRID, F.col("gy") - MIN_GRID]
    whole = F.lit(0).cast("bigint")
    for c in fields:  # 16 bits each
        whole = F.shiftleft(whole, 16).bitwiseOR(c.cast("bigint"))
    return [c.alias(n) for c, n in zip((whole, F.col("gz").cast("int")), packed(layer))]


def unpacked_pose(layer: int) -> dict[str, Column]:
    """The pose fields in the two columns of a layer."""
    pose, gz = (F.col(c) for c in packed(layer))
    low = [F.shiftright(pose, n).bitwiseAND(F.lit(MAX_INDEX)).cast("int") for n in (32, 16, 0)]
    conformer = F.shiftright(pose, 48).cast("int") + F.lit((MAX_INDEX + 1) // 2)
    return dict(zip(POSE, (conformer, low[0], low[1] + MIN_GRID, low[2] + MIN_GRID, gz)))


def posed_path_table(layers: Layers) -> DataFrame:
    """One row per path as in ``path_table``, with the packed pose of each layer instead of its node.

    The outer layers' edges bring their poses; those of an inner layer are looked up by the
    key of the join that is made anyhow, before it multiplies rows.
    """
    names, last = layers.names, len(layers.edges)

    def with_poses(table, j):
        found = layers.poses[j].select(F.col("node").alias(names[j]), *_packed_pose(j))
        rows = row_bound(table)
        return with_bound(skew_join(table, found, [names[j]], left_rows=rows, right_rows=0, counted=table), rows)

    def step(j):
        """Edges j with the poses that they bring."""
        outer = last if j == last - 1 else j
        ended = layers.ends.get(outer) if outer in (0, last) else None
        edge = layers.edges[j] if ended is None else ended
        brought = [] if ended is None else _packed_pose(outer)
        return with_bound(edge.select(F.col("low").alias(names[j]), F.col("high").alias(names[j + 1]), *brought), row_bound(edge))

    if not last:
        return with_bound(layers.poses[0].select(*_packed_pose(0)), row_bound(layers.poses[0]))
    table = step(0)
    if last == 1:
        table = with_poses(table, 0)
    for j in range(1, last):
        if j > 1:
            table = stage(table, "paths")
        table, edge = with_poses(table, j), step(j)
        table = skew_join(table, edge, [names[j]], left_rows=row_bound(table), right_rows=row_bound(edge)).drop(names[j])
    return table.select(*[c for j in range(last + 1) for c in packed(j)])


def number_posed_chains(table: DataFrame, count: int) -> DataFrame:
    """Chains of ``posed_path_table`` with their 1-based number, which is that of ``number_chains``.

    Nodes are numbered in pose order, so the order of poses is the order of nodes.
    """
    return number_chains(table, [c for j in range(count) for c in packed(j)])


def number_chains(table: DataFrame, names: list[str]) -> DataFrame:
    """Add the 1-based row number of each chain in lexicographic order."""
    numbered = dense_ids(table, names, "chain", "chains")
    return with_bound(numbered.withColumn("chain", F.col("chain") + 1), row_bound(numbered))


def chain_range(numbered: DataFrame, first: int, last: int, total: int) -> DataFrame:
    """Chains FIRST..LAST, 1-based and inclusive."""
    if not 1 <= first <= last:
        raise ValueError("chain range must satisfy 1 <= START <= END")
    if last > total:
        raise ValueError(f"chain range END={last} exceeds the number of chains ({total})")
    return numbered.where(F.col("chain").between(first, last))


def focus(numbered: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct sub-chains over some layers, numbered by first appearance.

    Returns the focused table ``(focused, columns...)`` and the provenance
    ``(chain, focused)`` of every original chain.  Columns keep layer order.
    """
    order = [c for c in numbered.columns if c in columns]
    unknown = set(columns) - set(order)
    if unknown or len(set(columns)) != len(columns):
        raise ValueError(f"unknown or repeated pools: {sorted(unknown) or columns}")
    first_seen = numbered.groupBy(*order).agg(F.min("chain").alias("_first"))
    table = dense_ids(first_seen, ["_first"], "focused", "focus")
    table = with_bound(table.withColumn("focused", F.col("focused") + 1), row_bound(table))
    provenance = skew_join(
        numbered, table.drop("_first"), order, right_rows=row_bound(table)
    ).select("chain", "focused")
    return table.drop("_first"), provenance
