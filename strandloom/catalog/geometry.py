"""Queries over geometry: grow, anchor, RMSD, best fits, Gaussian filters, coordinates.

The library is derived from the given tables: one conformer per embedding label (22
atoms from the label's mean vector, filled up with two zeros), one rotamer per nation.  Pools come from orders,
so work grows with orders while the library stays the size of its tables.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandloom.catalog import tables as t
from strandloom.catalog.relational import _CHAINS, _NUMBERED, POSES, _layers
from strandloom.constants import GRID_SPACING, MAX_INDEX, POSE
from strandloom.functions import decimals, gaussian, nucleotides, superpose
from strandloom.functions import vectors as v
from strandloom.operators import anchor as anchoring
from strandloom.operators import chains, filter_cache, fit, library, rebuild, rmsd
from strandloom.operators import grow as growing
from strandloom.operators.pool import organize, pose_columns
from strandloom.staging import row_bound, stage, with_bound

QUERIES, SQL = {}, {}
G = repr(GRID_SPACING)


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


# ---------------------------------------------------------------- library


PADDED = "list_concat(embedding, [0::FLOAT, 0::FLOAT])"


def padded():
    """All 64 values of an embedding and two zeros, which makes 22 atoms."""
    return F.concat("embedding", F.array(*[F.lit(0.0).cast("float")] * 2))


def domain(spark, sf_dir, table, column):
    """The values of a library key, of which there are at most 65,536, in order."""
    rows = t.read(spark, sf_dir, table).select(column).distinct().orderBy(column).limit(MAX_INDEX + 2).collect()
    if len(rows) > MAX_INDEX + 1:
        raise ValueError(f"{column} has more values than a library has numbers")
    return [int(r[0]) for r in rows]


def conformers(spark, sf_dir):
    """Label means as 22 atoms; integer sums keep them exact."""
    entry = F.posexplode(padded()).alias("n", "e")
    sums = (
        t.read(spark, sf_dir, "embeddings")
        .select("label", entry)
        .groupBy("label", "n")
        .agg(
            (
                F.sum(F.rint(F.col("e").cast("double") * 65536.0).cast("bigint")).cast("double")
                / F.count("*")
                / 4096.0
            ).alias("x")
        )
    )
    ordered = F.sort_array(F.collect_list(F.struct("n", "x")))
    flat = sums.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("f"))
    atoms = F.transform(
        F.sequence(F.lit(0), F.lit(21)),
        lambda a: F.array(*[F.get("f", a * 3 + k) for k in range(3)]),
    )
    return flat.select(F.col("label").cast("int").alias("conformer"), atoms.alias("coords"))


def rotvecs(spark, sf_dir):
    """Every nation is a rotamer of each label that occurs."""
    labels = F.explode(F.lit(domain(spark, sf_dir, "embeddings", "label"))).alias("label")
    return t.read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", labels).select(
        F.col("label").cast("int").alias("conformer"),
        F.col("n_nationkey").cast("int").alias("rotamer"),
        (F.col("n_nationkey") * 0.07 - 0.5).alias("rx"),
        (F.col("n_regionkey") * 0.11 + 0.1).alias("ry"),
        (F.col("n_nationkey") * 0.05).alias("rz"),
    )


def rotamers(spark, sf_dir):
    return library.rotamers_from_rotvec(rotvecs(spark, sf_dir))


def dock_poses(spark, sf_dir):
    labels, nations = domain(spark, sf_dir, "embeddings", "label"), domain(spark, sf_dir, "nation", "n_nationkey")
    return t.read(spark, sf_dir, "orders").select(
        *pose_columns(
            F.get(F.lit(labels), (F.col("o_orderkey") % len(labels)).cast("int")),
            F.get(F.lit(nations), (F.col("o_custkey") % len(nations)).cast("int")),
            F.expr("o_orderkey % 21 - 10"),
            F.expr("o_custkey % 19 - 9"),
            F.expr("(o_orderkey div 7) % 17 - 8"),
        ),
        F.col("o_orderkey").alias("source_id"),
    )


def dock_pool(spark, sf_dir):
    return organize(dock_poses(spark, sf_dir), ["source_id"], label="dock")


LIB = (
    "mean AS (SELECT label AS conformer, n, sum(CAST(round_even(e * 65536.0::DOUBLE, 0) AS BIGINT))::DOUBLE "
    "/ count(*) / 4096.0::DOUBLE AS x FROM (SELECT label, unnest(" + PADDED + ")::DOUBLE AS e, "
    "generate_subscripts(" + PADDED + ", 1) - 1 AS n FROM embeddings) GROUP BY label, n), "
    "atoms AS (SELECT conformer, n // 3 AS atom, max(x) FILTER (n % 3 = 0) AS x, max(x) FILTER (n % 3 = 1) AS y, "
    "max(x) FILTER (n % 3 = 2) AS z FROM mean GROUP BY conformer, n // 3), "
    "rotvecs AS (SELECT l.conformer, n_nationkey AS rotamer, n_nationkey * 0.07::DOUBLE - 0.5::DOUBLE AS rx, "
    "n_regionkey * 0.11::DOUBLE + 0.1::DOUBLE AS ry, n_nationkey * 0.05::DOUBLE AS rz FROM nation, "
    "(SELECT DISTINCT label AS conformer FROM embeddings) l), "
    # Rotation matrices through unit quaternions.
    "quat AS (SELECT conformer, rotamer, cos(h / 2) AS w, rx / h * sin(h / 2) AS qx, ry / h * sin(h / 2) AS qy, "
    "rz / h * sin(h / 2) AS qz FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS h FROM rotvecs)), "
    "rot AS (SELECT conformer, rotamer, 1 - 2 * (qy * qy + qz * qz) AS m0, 2 * (qx * qy - w * qz) AS m1, "
    "2 * (qx * qz + w * qy) AS m2, 2 * (qx * qy + w * qz) AS m3, 1 - 2 * (qx * qx + qz * qz) AS m4, "
    "2 * (qy * qz - w * qx) AS m5, 2 * (qx * qz - w * qy) AS m6, 2 * (qy * qz + w * qx) AS m7, "
    "1 - 2 * (qx * qx + qy * qy) AS m8 FROM quat), "
    # Every conformer atom turned by every rotamer.
    "turned AS (SELECT r.conformer, r.rotamer, a.atom, a.x * m0 + a.y * m3 + a.z * m6 AS x, "
    "a.x * m1 + a.y * m4 + a.z * m7 AS y, a.x * m2 + a.y * m5 + a.z * m8 AS z FROM rot r JOIN atoms a "
    "ON a.conformer = r.conformer)"
)
_DOCK_POSES = (
    "SELECT CAST(ls[o_orderkey % len(ls) + 1] AS INTEGER) AS conformer, CAST(ns[o_custkey % len(ns) + 1] AS INTEGER) AS rotamer, "
    "CAST(o_orderkey % 21 - 10 AS INTEGER) AS gx, CAST(o_custkey % 19 - 9 AS INTEGER) AS gy, "
    "CAST((o_orderkey // 7) % 17 - 8 AS INTEGER) AS gz, o_orderkey AS source_id FROM orders, "
    "(SELECT list(label ORDER BY label) AS ls FROM (SELECT DISTINCT label FROM embeddings)), "
    "(SELECT list(n_nationkey ORDER BY n_nationkey) AS ns FROM nation)"
)
DOCK = t.pool_sql("dock", _DOCK_POSES, "source_id")


# ---------------------------------------------------------------- grow

OVRMSD, CRMSD = 0.7, 0.25


def crmsds(spark, sf_dir):
    """Compatibility of label pairs: a given measure, one row per pair of labels."""
    labels = domain(spark, sf_dir, "embeddings", "label")
    label = t.read(spark, sf_dir, "embeddings").select("label").distinct()
    listed = label.withColumn("target", F.explode(F.lit(labels)))
    return listed.select(
        F.col("label").cast("int").alias("source"),
        F.col("target"),
        ((F.col("label") * 7 + F.col("target") * 3) % 10 / 10.0).alias("crmsd"),
    )


def _half(table, second):
    return table.withColumn("coords", F.slice("coords", 12 if second else 1, 11))


def _grown(spark, sf_dir, restrict=None):
    shapes, turns = conformers(spark, sf_dir), rotamers(spark, sf_dir)
    # Growing needs the poses and their ids.
    pool = organize(dock_poses(spark, sf_dir), ["source_id"], label="dock", columns=POSE)
    return growing.grow(
        pool, _half(shapes, True), turns, _half(shapes, False), turns,
        crmsds(spark, sf_dir), crmsd=CRMSD, ovrmsd=OVRMSD, restrict=restrict,
    )


_GROW = (
    f"WITH {LIB}, {DOCK}, src AS (SELECT conformer, rotamer, atom - 11 AS a, x, y, z FROM turned WHERE atom >= 11), "
    "tgt AS (SELECT conformer, rotamer, atom AS a, x, y, z FROM turned WHERE atom < 11), "
    "smean AS (SELECT conformer, rotamer, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM src GROUP BY ALL), "
    "tmean AS (SELECT conformer, rotamer, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tgt GROUP BY ALL), "
    "sc AS (SELECT s.conformer, s.rotamer, s.a, s.x - m.x AS x, s.y - m.y AS y, s.z - m.z AS z FROM src s "
    "JOIN smean m USING (conformer, rotamer)), "
    "tc AS (SELECT s.conformer, s.rotamer, s.a, s.x - m.x AS x, s.y - m.y AS y, s.z - m.z AS z FROM tgt s "
    "JOIN tmean m USING (conformer, rotamer)), "
    "rp AS (SELECT s.conformer AS cs, s.rotamer AS rs, t.conformer AS ct, t.rotamer AS rt, "
    "sum((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2) / 11.0::DOUBLE AS rc FROM sc s JOIN tc t USING (a) "
    f"WHERE (s.conformer * 7 + t.conformer * 3) % 10 / 10.0::DOUBLE < {CRMSD}::DOUBLE GROUP BY ALL "
    f"HAVING rc < {OVRMSD}::DOUBLE * {OVRMSD}::DOUBLE), "
    "opt AS (SELECT p.pose_id AS parent_id, rp.ct, rp.rt, rp.rc, "
    f"p.gx + (s.x - t.x) / {G}::DOUBLE AS cx, p.gy + (s.y - t.y) / {G}::DOUBLE AS cy, "
    f"p.gz + (s.z - t.z) / {G}::DOUBLE AS cz FROM dock p JOIN rp ON rp.cs = p.conformer AND rp.rs = p.rotamer "
    "JOIN smean s ON s.conformer = cs AND s.rotamer = rs JOIN tmean t ON t.conformer = ct AND t.rotamer = rt), "
    # 0.7 Angstrom are 1.3 grid points, so two points to each side are enough.
    "off AS (SELECT a.d AS dx, b.d AS dy, c.d AS dz FROM (SELECT unnest(range(-2, 3)) AS d) a, "
    "(SELECT unnest(range(-2, 3)) AS d) b, (SELECT unnest(range(-2, 3)) AS d) c), "
    "grown AS (SELECT parent_id, CAST(ct AS INTEGER) AS conformer, CAST(rt AS INTEGER) AS rotamer, "
    "CAST(round_even(cx, 0) + dx AS INTEGER) AS gx, CAST(round_even(cy, 0) + dy AS INTEGER) AS gy, "
    "CAST(round_even(cz, 0) + dz AS INTEGER) AS gz FROM opt, off WHERE rc + ((round_even(cx, 0) + dx - cx) ** 2 "
    "+ (round_even(cy, 0) + dy - cy) ** 2 + (round_even(cz, 0) + dz - cz) ** 2) / 3.0::DOUBLE "
    f"< {OVRMSD}::DOUBLE * {OVRMSD}::DOUBLE)"
)


@query("grow", f"{_GROW} SELECT parent_id, {POSES} FROM grown")
def grow(spark, sf_dir):
    return _grown(spark, sf_dir)


@query(
    "grow_restricted_to_pool",
    f"{_GROW} SELECT parent_id, {POSES} FROM grown SEMI JOIN dock USING (conformer, rotamer, gx, gy, gz)",
)
def grow_restricted_to_pool(spark, sf_dir):
    return _grown(spark, sf_dir, dock_poses(spark, sf_dir))


_REFERENCE = [[0.4, 0.3, -0.2], [1.1, -0.5, 0.6], [-0.7, 0.8, 0.9], [0.2, -1.2, 0.1], [-0.9, -0.3, -0.8],
              [0.6, 0.9, -1.1], [1.3, 0.2, 0.4], [-0.4, -0.6, 1.2], [0.1, 1.4, 0.3], [-1.2, 0.5, -0.1],
              [0.5, -0.8, -0.6]]
_REF_SQL = "ref(a, x, y, z) AS (VALUES " + ", ".join(
    f"({n}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for n, (x, y, z) in enumerate(_REFERENCE)
) + ")"


@query(
    "anchor_at_reference",
    f"WITH {LIB}, {_REF_SQL}, t AS (SELECT conformer, rotamer, atom AS a, x, y, z FROM turned WHERE atom < 11), "
    "g AS (SELECT unnest(range(-8, 9)) AS v), "
    f"p AS (SELECT t.conformer, t.rotamer, i.v AS gx, j.v AS gy, k.v AS gz, sqrt(sum((t.x + i.v * {G}::DOUBLE - r.x) ** 2 "
    f"+ (t.y + j.v * {G}::DOUBLE - r.y) ** 2 + (t.z + k.v * {G}::DOUBLE - r.z) ** 2) / 11.0::DOUBLE) AS d "
    "FROM t JOIN ref r USING (a), g i, g j, g k GROUP BY ALL) "
    "SELECT CAST(conformer AS INTEGER) AS conformer, CAST(rotamer AS INTEGER) AS rotamer, CAST(gx AS INTEGER) AS gx, "
    "CAST(gy AS INTEGER) AS gy, CAST(gz AS INTEGER) AS gz FROM p WHERE d < 1.6::DOUBLE",
)
def anchor_at_reference(spark, sf_dir):
    return growing.anchor_at_reference(
        _REFERENCE, _half(conformers(spark, sf_dir), False), rotamers(spark, sf_dir), ovrmsd=1.6
    )


# ---------------------------------------------------------------- RMSD

_REFERENCE_22 = [[math.sin(1.7 * n) * 2, math.cos(2.3 * n) * 2, math.sin(0.9 * n + 1) * 2] for n in range(22)]
_REF22_SQL = "ref(atom, x, y, z) AS (VALUES " + ", ".join(
    f"({n}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for n, (x, y, z) in enumerate(_REFERENCE_22)
) + ")"


def _rmsd_sql(where, count):
    return (
        f"SELECT p.pose_id, round_even(sqrt(sum((t.x + p.gx * {G}::DOUBLE - r.x) ** 2 + "
        f"(t.y + p.gy * {G}::DOUBLE - r.y) ** 2 + (t.z + p.gz * {G}::DOUBLE - r.z) ** 2) / {count}.0::DOUBLE), 3) "
        "AS value FROM dock p JOIN turned t ON t.conformer = p.conformer AND t.rotamer = p.rotamer "
        f"JOIN ref r ON r.atom = t.atom WHERE {where} GROUP BY p.pose_id"
    )


@query(
    "pose_rmsd_full_and_per_nucleotide",
    f"WITH {LIB}, {DOCK}, {_REF22_SQL}, f AS ({_rmsd_sql('true', 22)}), a AS ({_rmsd_sql('r.atom < 11', 11)}), "
    f"b AS ({_rmsd_sql('r.atom >= 11', 11)}) SELECT pose_id, f.value AS rmsd, a.value AS first, b.value AS second "
    "FROM f JOIN a USING (pose_id) JOIN b USING (pose_id)",
)
def pose_rmsd_full_and_per_nucleotide(spark, sf_dir):
    return rmsd.ensemble_rmsd(
        dock_pool(spark, sf_dir), conformers(spark, sf_dir), rotamers(spark, sf_dir), _REFERENCE_22, 11
    )


@query(
    "pose_coordinates",
    f"WITH {LIB}, {DOCK} SELECT p.pose_id, t.atom::INTEGER AS atom, round(t.x + p.gx * {G}::DOUBLE, 6) AS x, "
    f"round(t.y + p.gy * {G}::DOUBLE, 6) AS y, round(t.z + p.gz * {G}::DOUBLE, 6) AS z FROM dock p JOIN turned t "
    "ON t.conformer = p.conformer AND t.rotamer = p.rotamer",
)
def pose_coordinates(spark, sf_dir):
    placed = library.pose_coordinates(
        dock_pool(spark, sf_dir), conformers(spark, sf_dir), rotamers(spark, sf_dir)
    )
    rows = placed.select("pose_id", F.posexplode("xyz").alias("atom", "c"))
    return rows.select(
        "pose_id", "atom", *[F.round(F.get("c", F.lit(k)), 6).alias(n) for k, n in enumerate("xyz")]
    )


@query(
    "converted_poses",
    f"WITH {LIB}, {DOCK} SELECT p.pose_id, p.conformer, -rx AS rx, -ry AS ry, -rz AS rz, p.gx * {G}::DOUBLE AS x, "
    f"p.gy * {G}::DOUBLE AS y, p.gz * {G}::DOUBLE AS z FROM dock p JOIN rotvecs r ON r.conformer = p.conformer "
    "AND r.rotamer = p.rotamer",
)
def converted_poses(spark, sf_dir):
    return library.converted_poses(dock_pool(spark, sf_dir), rotvecs(spark, sf_dir))


_CONVERTED_SQL = SQL["converted_poses"]


@query("converted_pose_range", f"SELECT * FROM ({_CONVERTED_SQL}) WHERE pose_id BETWEEN 499 AND 1199")
def converted_pose_range(spark, sf_dir):
    """Poses 500 to 1,200, counted from one."""
    return library.converted_poses(dock_pool(spark, sf_dir), rotvecs(spark, sf_dir), pose_range=(500, 1200))


@query(
    "converted_poses_of_requests",
    f"SELECT event_id AS request_pos, c.* FROM events JOIN ({_CONVERTED_SQL}) c "
    "ON c.pose_id = (event_id * 31 + user_id) % (SELECT count(*) FROM orders)",
)
def converted_poses_of_requests(spark, sf_dir):
    pool = dock_pool(spark, sf_dir)
    requests = t.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_pos"), ((F.col("event_id") * 31 + F.col("user_id")) % row_bound(pool)).alias("pose_id")
    )
    return library.converted_poses(pool, rotvecs(spark, sf_dir), requests=requests)


# Forty structures share a place, so near pairs grow with the table, not its square.
NEAR = 0.6


@query(
    "structure_pairs_below_rmsd",
    f"WITH s AS (SELECT vec_id, list_transform(range(66), lambda n: {PADDED}[n + 1]::DOUBLE * 2 + "
    "CASE n % 3 WHEN 0 THEN (vec_id // 40) % 50 WHEN 1 THEN (vec_id // 2000) % 50 ELSE vec_id // 100000 END) AS x FROM embeddings), "
    "d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 67), "
    "lambda n: (a.x[n] - b.x[n]) ** 2)) / 22.0::DOUBLE) AS d FROM s a JOIN s b ON a.vec_id < b.vec_id) "
    f"SELECT i, j, round(d, 9) AS rmsd FROM d WHERE d < {NEAR}::DOUBLE",
)
def structure_pairs_below_rmsd(spark, sf_dir):
    structures = t.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform(
            padded(),
            lambda x, n: x.cast("double") * 2.0
            + F.when(n % 3 == 0, F.expr("(vec_id div 40) % 50"))
            .when(n % 3 == 1, F.expr("(vec_id div 2000) % 50"))
            .otherwise(F.expr("vec_id div 100000")),
        ).alias("coords"),
    )
    pairs = rmsd.pairs_below(structures, NEAR)
    return pairs.select("i", "j", F.round("rmsd", 9).alias("rmsd"))


# ---------------------------------------------------------------- best fits


def _fragments(spark, sf_dir):
    """Reference fragments: every embedding as 22 atoms, placed by its number."""
    shift = [F.col("vec_id") % 7 - 3.0, F.col("vec_id") % 5 - 2.0, F.col("vec_id") % 3 - 1.0]
    atoms = F.transform(
        F.sequence(F.lit(0), F.lit(21)),
        lambda a: F.array(
            *[F.get(padded(), a * 3 + k).cast("double") * 16.0 + shift[k] for k in range(3)]
        ),
    )
    return t.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("fragment"), F.col("label").cast("int").alias("conformer"), atoms.alias("coords")
    )


_FIT = (
    f"WITH {LIB}, refs AS (SELECT vec_id AS fragment, label AS conformer, a AS atom, {PADDED}[3 * a + 1]::DOUBLE * 16 "
    f"+ vec_id % 7 - 3 AS x, {PADDED}[3 * a + 2]::DOUBLE * 16 + vec_id % 5 - 2 AS y, "
    f"{PADDED}[3 * a + 3]::DOUBLE * 16 + vec_id % 3 - 1 AS z FROM embeddings, range(22) AS r(a)), "
    "g AS (SELECT r.fragment, t.conformer, t.rotamer, "
    f"round_even((avg(r.x) - avg(t.x)) / {G}::DOUBLE, 0) AS gx, round_even((avg(r.y) - avg(t.y)) / {G}::DOUBLE, 0) AS gy, "
    f"round_even((avg(r.z) - avg(t.z)) / {G}::DOUBLE, 0) AS gz FROM refs r JOIN turned t USING (conformer, atom) GROUP BY ALL), "
    "d AS (SELECT g.fragment, g.conformer, g.rotamer, g.gx, g.gy, g.gz, "
    f"sqrt(sum((t.x + g.gx * {G}::DOUBLE - r.x) ** 2 + (t.y + g.gy * {G}::DOUBLE - r.y) ** 2 "
    f"+ (t.z + g.gz * {G}::DOUBLE - r.z) ** 2) / 22.0::DOUBLE) AS rmsd FROM g JOIN turned t USING (conformer, rotamer) "
    "JOIN refs r ON r.fragment = g.fragment AND r.atom = t.atom GROUP BY ALL), "
    "best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY fragment ORDER BY rmsd, rotamer) = 1)"
)


@query(
    "best_pose_per_fragment",
    f"{_FIT} SELECT fragment, CAST(conformer AS INTEGER) AS conformer, CAST(rotamer AS INTEGER) AS rotamer, "
    "CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(gz AS INTEGER) AS gz, round(rmsd, 6) AS rmsd FROM best",
)
def best_pose_per_fragment(spark, sf_dir):
    best = fit.best_poses(
        _fragments(spark, sf_dir), conformers(spark, sf_dir), rotamers(spark, sf_dir)
    )
    return best.withColumn("rmsd", F.round("rmsd", 6))


def superposed_sql(name, keys, pairs):
    """CTEs that end in ``name(keys, crmsd)`` from ``pairs(keys, lx, ly, lz, rx, ry, rz)``."""
    sums = {f"{i}{j}": f"sum(l{i} * r{j}) - sum(l{i}) * sum(r{j}) / count(*)" for i in "xyz" for j in "xyz"}
    square = " + ".join(f"sum({q}{i} * {q}{i}) - sum({q}{i}) ** 2 / count(*)" for q in "lr" for i in "xyz")
    after = {"x": "y", "y": "z", "z": "x"}
    cof = {
        i + j: f"({after[i]}{after[j]} * {after[after[i]]}{after[after[j]]} - {after[i]}{after[after[j]]} * {after[after[i]]}{after[j]})"
        for i in "xyz" for j in "xyz"
    }
    parts = [
        f"{name}_m AS (SELECT {keys}, count(*)::DOUBLE AS n, ({square}) / 2 AS e, "
        + ", ".join(f"{v} AS {k}" for k, v in sums.items()) + f" FROM {pairs} GROUP BY {keys})",
        f"{name}_q AS (SELECT {keys}, n, e, {' + '.join(f'{k} * {k}' for k in sums)} AS q, "
        f"{' + '.join(f'x{j} * {cof[chr(120) + j]}' for j in 'xyz')} AS d, {' + '.join(f'{c} ** 2' for c in cof.values())} AS c FROM {name}_m)",
        f"{name}_0 AS (SELECT {keys}, n, e, -2 * q AS p2, -8 * d AS p1, q * q - 4 * c AS p0, e AS x FROM {name}_q)",
    ]
    for step in range(superpose.NEWTON_STEPS):
        parts.append(
            f"{name}_{step + 1} AS (SELECT * REPLACE (CASE WHEN (x * x * 4 + p2 * 2) * x + p1 > 0 "
            f"THEN x - (((x * x + p2) * x + p1) * x + p0) / ((x * x * 4 + p2 * 2) * x + p1) ELSE x END AS x) FROM {name}_{step})"
        )
    return ", ".join(parts) + f", {name} AS (SELECT {keys}, sqrt(greatest(e - x, 0) * 2 / n) AS crmsd FROM {name}_{superpose.NEWTON_STEPS})"


@query(
    "best_conformer_per_fragment",
    f"{_FIT}, sp AS (SELECT r.fragment, a.conformer, a.x AS lx, a.y AS ly, a.z AS lz, r.x AS rx, r.y AS ry, r.z AS rz "
    f"FROM refs r JOIN atoms a USING (atom)), {superposed_sql('sup', 'fragment, conformer', 'sp')} "
    "SELECT fragment, CAST(arg_min(conformer, (round(crmsd, 9), conformer)) AS INTEGER) AS conformer, round(min(crmsd), 6) AS crmsd FROM sup GROUP BY fragment",
)
def best_conformer_per_fragment(spark, sf_dir):
    same = F.lit("AC").alias("sequence")
    best = fit.best_conformers(
        _fragments(spark, sf_dir).select("fragment", same, "coords"),
        conformers(spark, sf_dir).select("conformer", same, "coords"),
    )
    return best.select("fragment", "conformer", F.round("crmsd", 6).alias("crmsd"))


# Overlapping names of neighbouring fragments, a letter per number.
_LETTER = "substring('ACGU', {} % 4 + 1, 1)"
_SEQUENCE = f"{_LETTER.format('fragment')} || {_LETTER.format('(fragment + 1)')}"


@query(
    "best_fit_pairs",
    f"{_FIT}, s AS (SELECT *, {_SEQUENCE} AS sequence FROM best), "
    "n AS (SELECT s.fragment, s.sequence, t.atom, "
    f"t.x + s.gx * {G}::DOUBLE AS x, t.y + s.gy * {G}::DOUBLE AS y, t.z + s.gz * {G}::DOUBLE AS z FROM s "
    "JOIN turned t USING (conformer, rotamer)), "
    "o AS (SELECT d.fragment AS down, u.fragment AS up, d.sequence || u.sequence[2:] AS sequence, "
    "round(sqrt(sum((d.x - u.x) ** 2 + (d.y - u.y) ** 2 + (d.z - u.z) ** 2) / 11.0::DOUBLE), 6) AS ovrmsd "
    "FROM n d JOIN n u ON u.fragment = d.fragment + 1 AND d.atom = u.atom + 11 WHERE u.atom < 11 "
    "GROUP BY d.fragment, u.fragment, d.sequence, u.sequence), "
    "cp AS (SELECT d.conformer AS dc, u.conformer AS uc, d.x AS lx, d.y AS ly, d.z AS lz, u.x AS rx, u.y AS ry, u.z AS rz "
    f"FROM atoms d JOIN atoms u ON d.atom = u.atom + 11), {superposed_sql('sup', 'dc, uc', 'cp')} "
    "SELECT o.*, round(crmsd, 6) AS crmsd FROM o JOIN s d ON d.fragment = o.down JOIN s u ON u.fragment = o.up "
    "JOIN sup ON dc = d.conformer AND uc = u.conformer",
)
def best_fit_pairs(spark, sf_dir):
    shapes, turns = conformers(spark, sf_dir), rotamers(spark, sf_dir)
    best = fit.best_poses(_fragments(spark, sf_dir), shapes, turns)
    fits = best.withColumn("sequence", F.expr(_SEQUENCE)).join(turns, ["conformer", "rotamer"])
    pairs = fit.adjacent_pairs(fits)
    for side, second in (("down", True), ("up", False)):
        pairs = pairs.join(
            _half(shapes, second).select(
                F.col("conformer").alias(f"{side}_conformer"), F.col("coords").alias(f"{side}_coords")
            ),
            f"{side}_conformer",
        )
    scored = fit.pair_rmsds(pairs)
    return scored.select("down", "up", "sequence", *[F.round(c, 6).alias(c) for c in ("ovrmsd", "crmsd")])


@query(
    "best_fit_bases",
    f"{_FIT} SELECT b.fragment, {_SEQUENCE.replace('fragment', 'b.fragment')} AS sequence, " + ", ".join(
        f"round(sqrt(avg((t.x + b.gx * {G}::DOUBLE - r.x) ** 2 + (t.y + b.gy * {G}::DOUBLE - r.y) ** 2 "
        f"+ (t.z + b.gz * {G}::DOUBLE - r.z) ** 2) FILTER (r.atom {half} 11)), 6) AS nucleotide{n}_ovrmsd"
        for n, half in ((1, "<"), (2, ">="))
    ) + " FROM best b JOIN turned t USING (conformer, rotamer) JOIN refs r ON r.fragment = b.fragment AND r.atom = t.atom GROUP BY b.fragment",
)
def best_fit_bases(spark, sf_dir):
    shapes, turns = conformers(spark, sf_dir), rotamers(spark, sf_dir)
    refs = _fragments(spark, sf_dir)
    best = fit.best_poses(refs, shapes, turns)
    fits = (
        best.join(refs.select("fragment", F.col("coords").alias("ref")), "fragment")
        .join(shapes, "conformer")
        .join(turns, ["conformer", "rotamer"])
        .withColumns({"sequence": F.expr(_SEQUENCE), "split": F.lit(11)})
    )
    found = fit.base_rmsds(fits)
    return found.select("fragment", "sequence", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query(
    "thresholds_strictly_above",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (split_part(l_extendedprice::VARCHAR, '.', 1)::BIGINT * 100 + substring(rpad(split_part(l_extendedprice::VARCHAR, '.', 2), 2, '0'), 1, 2)::BIGINT + 1)::DOUBLE "
    "/ 100 AS above, floor((l_extendedprice / 7.0::DOUBLE + 0.00003::DOUBLE)::DECIMAL(28,9) * 1000)::DOUBLE / 1000 AS below FROM lineitem",
)
def thresholds_strictly_above(spark, sf_dir):
    price = F.col("l_extendedprice")
    return t.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        decimals.above_cent_column(price).cast("double").alias("above"),
        decimals.floor_decimal_column(price / 7.0 + 0.00003, 3).cast("double").alias("below"),
    )


# ---------------------------------------------------------------- stacking

# Lattice points and tilts from the lines of an order.
_POINT = {
    "i": "l_partkey % 25 - 12",
    "j": "l_suppkey % 23 - 11",
    "k": "l_orderkey % 39 - 19",
}
_R33 = "cos(l_quantity * 0.02D)"
_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _placements(spark, sf_dir):
    return t.read(spark, sf_dir, "lineitem").select(
        *_LINE_KEYS,
        *[F.expr(e).cast("bigint").alias(n) for n, e in _POINT.items()],
        F.expr(_R33).alias("r33"),
    )


_PLACE_SQL = (
    f"p AS (SELECT {', '.join(_LINE_KEYS)}, {', '.join(f'{e} AS {n}' for n, e in _POINT.items())}, "
    "cos(l_quantity * 0.02::DOUBLE) AS r33 FROM lineitem), "
    "q AS (SELECT *, sqrt(i * i + j * j + k * k) * 0.25::DOUBLE AS d, acos(least(1.0::DOUBLE, abs(r33))) AS theta FROM p), "
    "phi AS (SELECT *, CASE WHEN d > 0 THEN acos(abs(k) * 0.25::DOUBLE / d) END AS phi FROM q), "
    # Fixed values: mean, precision and peak of the stacking density.
    "dev AS (SELECT *, d - 3.778988652846167::DOUBLE AS a, phi - 0.3359170155526752::DOUBLE AS b, "
    "theta - 0.21710309041293038::DOUBLE AS c FROM phi), "
    "scored AS (SELECT *, exp(-0.5::DOUBLE * (13.055035569772702::DOUBLE * a * a + 31.531026898594526::DOUBLE * b * b "
    "+ 35.02664194314763::DOUBLE * c * c + 2 * (-9.829936278368704::DOUBLE * a * b - 7.388302029768115::DOUBLE * a * c "
    "- 5.996886272605505::DOUBLE * b * c))) / 0.17639457343866755::DOUBLE AS score FROM dev)"
)
_CUTOFF_SQL = "f(filter, cutoff, tilt30, disp45) AS (VALUES " + ", ".join(
    f"('rrm{n}{s}', {c}::DOUBLE, {'tilt' in s}, {'disp' in s})"
    for n, c, suffixes in (
        (50, "3.30384", [""]), (60, "2.90431", [""]), (70, "2.04198", [""]), (80, "1.19748", [""]),
        (90, "0.27592", ["", "-tilt30", "-disp45", "-tilt30-disp45"]),
        (95, "0.06141", ["", "-tilt30", "-disp45", "-tilt30-disp45"]),
    )
    for s in suffixes
) + ")"


def _described(spark, sf_dir):
    step = gaussian.LATTICE_STEP
    d, phi, theta = gaussian.descriptors(
        F.col("r33"), *[F.col(a) * step for a in "ijk"]
    )
    return _placements(spark, sf_dir).withColumns({"d": d, "phi": phi, "theta": theta})


@query(
    "stacking_descriptors_and_score",
    f"WITH {_PLACE_SQL} SELECT {', '.join(_LINE_KEYS)}, round(d, 9) AS d, round(phi, 9) AS phi, "
    "round(theta, 9) AS theta, round(score, 9) AS score FROM scored",
)
def stacking_descriptors_and_score(spark, sf_dir):
    scored = _described(spark, sf_dir).withColumn(
        "score", gaussian.score(F.col("d"), F.col("phi"), F.col("theta"))
    )
    return scored.select(
        *_LINE_KEYS, *[F.round(c, 9).alias(c) for c in ("d", "phi", "theta", "score")]
    )


@query(
    "stacking_masks",
    f"WITH {_PLACE_SQL} SELECT disp45, tilt30, CAST(count(*) AS BIGINT) AS placements FROM (SELECT "
    "i*i + j*j + k*k < 400 AND 3*k*k > i*i + j*j AS ok, k*k > i*i + j*j AS disp45, 4*r33*r33 > 3 AS tilt30 FROM p) "
    "WHERE ok GROUP BY ALL",
)
def stacking_masks(spark, sf_dir):
    i, j, k = (F.col(a) for a in "ijk")
    return (
        _placements(spark, sf_dir)
        .where(gaussian.translation_mask(i, j, k))
        .groupBy(
            gaussian.translation_mask(i, j, k, True).alias("disp45"),
            gaussian.rotation_mask(F.col("r33"), True).alias("tilt30"),
        )
        .agg(F.count("*").alias("placements"))
    )


_VERDICT_SQL = (
    f"WITH {_PLACE_SQL}, {_CUTOFF_SQL}, w AS (SELECT n.filter, b.filter AS wide FROM f n JOIN f b ON n.filter <> b.filter "
    "AND n.cutoff >= b.cutoff AND (n.tilt30 OR NOT b.tilt30) AND (n.disp45 OR NOT b.disp45)), "
    "depth AS (SELECT f.filter, count(w.wide) AS depth FROM f LEFT JOIN w USING (filter) GROUP BY f.filter), "
    f"jobs AS (SELECT DISTINCT i, j, k, r33, d, phi, theta, score FROM scored), "
    "v AS (SELECT i, j, k, r33, f.filter, coalesce(d < 5 AND phi < radians(60) AND (NOT tilt30 OR theta < radians(30)) "
    "AND (NOT disp45 OR phi < radians(45)) AND score >= cutoff, false) AS ok FROM jobs, f), "
    # A filter counts as rejected when it fails and every wider one passed.
    "r AS (SELECT v.*, depth FROM v JOIN depth USING (filter) WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM w JOIN v x "
    "ON x.filter = w.wide AND x.i = v.i AND x.j = v.j AND x.k = v.k AND x.r33 = v.r33 WHERE w.filter = v.filter AND NOT x.ok)), "
    "imp AS (SELECT v.i, v.j, v.k, v.r33, v.filter, max_by(r.filter, (r.depth, r.filter)) AS implied_by FROM v JOIN w USING (filter) "
    "JOIN r ON r.filter = w.wide AND r.i = v.i AND r.j = v.j AND r.k = v.k AND r.r33 = v.r33 GROUP BY ALL) "
    "SELECT v.i, v.j, v.k, round(v.r33, 9) AS r33, v.filter, CASE WHEN imp.filter IS NOT NULL THEN 'implied' WHEN v.ok "
    "THEN 'accepted' ELSE 'rejected' END AS state, imp.implied_by FROM v LEFT JOIN imp ON imp.i = v.i AND imp.j = v.j "
    "AND imp.k = v.k AND imp.r33 = v.r33 AND imp.filter = v.filter"
)


@query("stacking_filter_check", _VERDICT_SQL)
def stacking_filter_check(spark, sf_dir):
    jobs = _described(spark, sf_dir).select(
        F.struct("i", "j", "k", "r33").alias("job"), "d", "phi", "theta"
    ).distinct()
    checked = anchoring.check_filters(jobs)
    return checked.select(
        "job.i", "job.j", "job.k", F.round("job.r33", 9).alias("r33"), "filter", "state", "implied_by"
    )


@query(
    "stacking_score_margins",
    f"WITH {_PLACE_SQL} SELECT round(min(abs(score / 0.27592::DOUBLE - 1)), 9) AS min_rel_margin, "
    "round(min(abs(4 * r33 * r33 - 3)), 9) AS min_tilt_gap FROM scored",
)
def stacking_score_margins(spark, sf_dir):
    scored = _described(spark, sf_dir).select(
        "r33", gaussian.score(F.col("d"), F.col("phi"), F.col("theta")).alias("score")
    )
    margins = gaussian.audit(scored, "rrm90")
    return margins.select(*[F.round(c, 9).alias(c) for c in margins.columns])


# Rotations from orders, as rotation vectors.
_ROTVEC = {
    "rx": "(o_orderkey % 997) * 0.003D - 1.4D",
    "ry": "(o_custkey % 991) * 0.0029D - 1.3D",
    "rz": "(o_totalprice - 250000.0D) * 0.000005D",
}


def _order_rotations(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").select(
        "o_orderkey", *[F.expr(e).alias(n) for n, e in _ROTVEC.items()]
    )


_QUAT_SQL = (
    "rv AS (SELECT o_orderkey, (o_orderkey % 997) * 0.003::DOUBLE - 1.4::DOUBLE AS rx, (o_custkey % 991) * 0.0029::DOUBLE "
    "- 1.3::DOUBLE AS ry, (o_totalprice - 250000.0::DOUBLE) * 0.000005::DOUBLE AS rz FROM orders), "
    "qt AS (SELECT o_orderkey, cos(h / 2) AS w, rx / h * sin(h / 2) AS x, ry / h * sin(h / 2) AS y, rz / h * sin(h / 2) AS z "
    "FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS h FROM rv))"
)
# Cells through half angles of the quaternion.
_CELL_SQL = (
    "ang AS (SELECT *, atan2(x, w) AS hp, atan2(z, y) - atan2(x, w) AS ph, 2 * atan2(sqrt(y * y + z * z), sqrt(w * w + x * x)) AS th FROM {src}), "
    "ax AS (SELECT *, sin(th) * cos(ph) AS s0, sin(th) * sin(ph) AS s1, cos(th) AS s2, "
    "(2 * hp) - 2 * pi() * floor(2 * hp / (2 * pi())) AS psi FROM ang), "
    "mj AS (SELECT *, CASE WHEN abs(s0) >= abs(s1) AND abs(s0) >= abs(s2) THEN 0 WHEN abs(s1) >= abs(s2) THEN 1 ELSE 2 END AS major FROM ax), "
    "ab AS (SELECT *, [s0, s1, s2][major + 1] AS top, CASE major WHEN 0 THEN s1 ELSE s0 END AS u, CASE major WHEN 2 THEN s1 ELSE s2 END AS v FROM mj), "
    "cells AS (SELECT *, CAST((((2 * major + CASE WHEN top < 0 THEN 1 ELSE 0 END) * 16 "
    "+ least(15, greatest(0, floor(8 * (1 + 4 / pi() * atan(u / abs(top))))))) * 16 "
    "+ least(15, greatest(0, floor(8 * (1 + 4 / pi() * atan(v / abs(top))))))) * 64 + least(63, floor(64 * psi / (2 * pi()))) AS INTEGER) AS cell FROM ab)"
)


@query(
    "hopf_cell_of_rotation",
    f"WITH {_QUAT_SQL}, {_CELL_SQL.format(src='qt')} SELECT o_orderkey, cell FROM cells",
)
def hopf_cell_of_rotation(spark, sf_dir):
    turn = v.rotvec_matrix("rx", "ry", "rz")
    return _order_rotations(spark, sf_dir).select("o_orderkey", v.shared(turn, gaussian.hopf_cell).alias("cell"))


# Tilt at the centre of each cell of a table.
_TILT_SQL = (
    "hc AS (SELECT *, cell % 64 AS mm, (cell // 64) % 16 AS qq, (cell // 1024) % 16 AS pp, cell // 16384 AS face FROM {src}), "
    "ha AS (SELECT *, tan(pi() / 4 * (2 * (pp + 0.5::DOUBLE) / 16 - 1)) AS ua, tan(pi() / 4 * (2 * (qq + 0.5::DOUBLE) / 16 - 1)) AS ub, "
    "CASE WHEN face % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM hc), "
    "hs AS (SELECT *, sqrt(ua*ua + ub*ub + 1) AS nn, CASE face // 2 WHEN 0 THEN sg ELSE ua END AS hx, "
    "CASE face // 2 WHEN 0 THEN ua WHEN 1 THEN sg ELSE ub END AS hy, CASE face // 2 WHEN 2 THEN sg ELSE ub END AS hz FROM ha), "
    "hq AS (SELECT *, acos(hz / nn) / 2 AS ht, atan2(hy, hx) AS az, pi() * (mm + 0.5::DOUBLE) / 64 AS tu FROM hs), "
    "tilt AS (SELECT *, 1 - 2 * ((cos(ht) * sin(tu)) ** 2 + (sin(ht) * cos(az + tu)) ** 2) AS r33 FROM hq)"
)
_LATTICE_SQL = (
    "lat AS (SELECT a.v AS i, b.v AS j, c.v AS k FROM (SELECT unnest(range(-20, 21)) AS v) a, (SELECT unnest(range(-20, 21)) AS v) b, "
    "(SELECT unnest(range(-20, 21)) AS v) c WHERE i*i + j*j + k*k < 400 AND 3*k*k > i*i + j*j)"
)
# Mean, precision and peak of the stacking density.
_DEVIATIONS_SQL = (
    "sqrt(i*i + j*j + k*k) * 0.25::DOUBLE - 3.778988652846167::DOUBLE AS a, "
    "acos(abs(k) / sqrt(i*i + j*j + k*k)) - 0.3359170155526752::DOUBLE AS b, acos(least(1, abs(r33))) - 0.21710309041293038::DOUBLE AS c"
)
_DENSITY_SQL = (
    "exp(-0.5::DOUBLE * (13.055035569772702::DOUBLE * a * a "
    "+ 31.531026898594526::DOUBLE * b * b + 35.02664194314763::DOUBLE * c * c + 2 * (-9.829936278368704::DOUBLE * a * b "
    "- 7.388302029768115::DOUBLE * a * c - 5.996886272605505::DOUBLE * b * c))) / 0.17639457343866755::DOUBLE"
)
_FILTERS_SQL = "filters(filter, cutoff, tilt30, disp45) AS (VALUES " + ", ".join(
    f"('{n}', {gaussian.cutoff(n)!r}::DOUBLE, {str(tilt).upper()}, {str(disp).upper()})"
    for n in gaussian.filter_names()
    for _, tilt, disp in (gaussian.parse_name(n),)
) + ")"


# Turns small enough for the rings to stay near parallel.
_SMALL_QUAT_SQL = _QUAT_SQL.replace(
    "FROM rv)", "FROM (SELECT o_orderkey, rx * 0.4::DOUBLE AS rx, ry * 0.4::DOUBLE AS ry, rz * 0.4::DOUBLE AS rz FROM rv))"
)


@query(
    "stacking_filter_sizes",
    f"WITH {_SMALL_QUAT_SQL}, {_CELL_SQL.format(src='qt')}, distinct_cells AS (SELECT DISTINCT cell FROM cells), "
    f"{_TILT_SQL.format(src='distinct_cells')}, {_LATTICE_SQL}, {_FILTERS_SQL}, "
    "keys AS (SELECT i*i + j*j AS side, k*k AS k2, any_value(i) AS i, any_value(j) AS j, any_value(k) AS k, count(*) AS n FROM lat GROUP BY side, k2), "
    f"dev AS (SELECT cell, r33, side, k2, n, {_DEVIATIONS_SQL} FROM tilt, keys WHERE abs(r33) > 0.5), "
    f"scored AS (SELECT *, {_DENSITY_SQL} AS score FROM dev) "
    "SELECT filter, cell, CAST(sum(n) AS INTEGER) AS size FROM scored JOIN filters ON score >= cutoff "
    "AND (NOT tilt30 OR 4 * r33 * r33 > 3) AND (NOT disp45 OR k2 > side) GROUP BY filter, cell",
)
def stacking_filter_sizes(spark, sf_dir):
    turn = v.rotvec_matrix(*[F.col(c) * 0.4 for c in ("rx", "ry", "rz")])
    cells = _order_rotations(spark, sf_dir).select(v.shared(turn, gaussian.hopf_cell).alias("cell"))
    return filter_cache.sizes(stage(anchoring.cell_tilts_of(cells), "cells"))


# ---------------------------------------------------------------- anchor

_FRAME = [0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6]
_CENTRE = [1.25, -2.5, 0.75]
_HEXAGON = [[1.4 * math.cos(n * math.pi / 3), 1.4 * math.sin(n * math.pi / 3), 0.0] for n in range(6)]
_FILTER = "rrm70"
# A nucleotide ring per region: the reference hexagon, turned and moved.
_RING_TURN = {"rx": "r_regionkey * 0.2D - 0.3D", "ry": "r_regionkey * 0.15D + 0.1D", "rz": "r_regionkey * 0.05D"}
_RING_PLACE = ["0.5D + r_regionkey * 0.1D", "-0.25D", "1.0D - r_regionkey * 0.2D"]


def _ring_conformers(spark, sf_dir):
    """Conformers of two other atoms and the six of the ring."""
    turn = v.rotvec_matrix(*[F.expr(e) for e in _RING_TURN.values()])
    place = [F.expr(e) for e in _RING_PLACE]

    def ring(m):
        atoms = [[c + p for c, p in zip(v.rotate([F.lit(x) for x in atom], m), place)] for atom in _HEXAGON]
        return F.array(*[F.array(*atom) for atom in ([F.lit(0.0)] * 3, [F.lit(9.0)] * 3, *atoms)])

    return t.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("conformer"), v.shared(turn, ring).alias("coords"))


def _matrix_sql(q, prefix):
    """Columns of the rotation matrix of a quaternion (w, x, y, z)."""
    w, x, y, z = q
    entries = (
        f"1 - 2*({y}*{y} + {z}*{z})", f"2*({x}*{y} - {w}*{z})", f"2*({x}*{z} + {w}*{y})", f"2*({x}*{y} + {w}*{z})",
        f"1 - 2*({x}*{x} + {z}*{z})", f"2*({y}*{z} - {w}*{x})", f"2*({x}*{z} - {w}*{y})", f"2*({y}*{z} + {w}*{x})",
        f"1 - 2*({x}*{x} + {y}*{y})",
    )
    return ", ".join(f"{e} AS {prefix}{n}" for n, e in enumerate(entries))


_RING_SQL = (
    "ringv AS (SELECT r_regionkey AS conformer, r_regionkey * 0.2::DOUBLE - 0.3::DOUBLE AS rx, r_regionkey * 0.15::DOUBLE + 0.1::DOUBLE AS ry, "
    "r_regionkey * 0.05::DOUBLE AS rz, 0.5::DOUBLE + r_regionkey * 0.1::DOUBLE AS c0, -0.25::DOUBLE AS c1, "
    "1.0::DOUBLE - r_regionkey * 0.2::DOUBLE AS c2 FROM region), "
    "ringq AS (SELECT *, cos(h / 2) AS w, rx / h * sin(h / 2) AS x, ry / h * sin(h / 2) AS y, rz / h * sin(h / 2) AS z "
    "FROM (SELECT *, sqrt(rx*rx + ry*ry + rz*rz) AS h FROM ringv)), "
    f"ringm AS (SELECT conformer, c0, c1, c2, {_matrix_sql('wxyz', 'g')} FROM ringq)"
)
# Entry (i, j) of ring * rotamer, and of that times the transposed frame.
_RING_TURNED = ", ".join(
    f"g{3 * i}*m{j} + g{3 * i + 1}*m{3 + j} + g{3 * i + 2}*m{6 + j} AS p{3 * i + j}" for i in range(3) for j in range(3)
)
_RELATIVE = ", ".join(
    " + ".join(f"({_FRAME[3 * j + k]})*p{3 * i + k}" for k in range(3)) + f" AS {'abcdefghi'[3 * i + j]}"
    for i in range(3)
    for j in range(3)
)


@query(
    "anchor",
    f"WITH {_QUAT_SQL}, {_RING_SQL}, "
    "keyed AS (SELECT *, rs[o_orderkey % len(rs) + 1] AS conformer FROM qt, "
    "(SELECT list(r_regionkey ORDER BY r_regionkey) AS rs FROM region)), "
    f"mat AS (SELECT o_orderkey, conformer, {_matrix_sql('wxyz', 'm')} FROM keyed), "
    f"rm AS (SELECT mat.*, c0, c1, c2, {_RING_TURNED} FROM mat JOIN ringm USING (conformer)), "
    "rel AS (SELECT o_orderkey, conformer, 1.25 - (c0*m0 + c1*m3 + c2*m6) AS o0, -2.5 - (c0*m1 + c1*m4 + c2*m7) AS o1, "
    f"0.75 - (c0*m2 + c1*m5 + c2*m8) AS o2, {_RELATIVE} FROM rm), "
    "rq AS (SELECT o_orderkey, conformer, o0, o1, o2, CASE WHEN a + e + i > 0 THEN [1 + a + e + i, h - f, c - g, d - b] "
    "WHEN a >= e AND a >= i THEN [h - f, 1 + a - e - i, b + d, c + g] WHEN e >= i THEN [c - g, b + d, 1 - a + e - i, f + h] "
    "ELSE [d - b, c + g, f + h, 1 - a - e + i] END AS q FROM rel), "
    "rn AS (SELECT o_orderkey, conformer, o0, o1, o2, q[1] AS w, q[2] AS x, q[3] AS y, q[4] AS z FROM rq), "
    f"{_CELL_SQL.format(src='rn')}, {_TILT_SQL.format(src='cells')}, {_LATTICE_SQL}, "
    f"acc AS (SELECT o_orderkey, conformer, o0, o1, o2, lat.i, lat.j, lat.k, {_DEVIATIONS_SQL} "
    "FROM (SELECT o_orderkey, conformer, o0, o1, o2, r33 FROM tilt) q, lat WHERE abs(acos(least(1, abs(r33))) - 0.21710309041293038::DOUBLE) < 0.3), "
    f"hit AS (SELECT o_orderkey, conformer, o0, o1, o2, i * 0.25::DOUBLE AS x, j * 0.25::DOUBLE AS y, k * 0.25::DOUBLE AS z FROM acc WHERE {_DENSITY_SQL} >= 2.04198::DOUBLE), "
    f"cnt AS (SELECT o_orderkey, conformer, o0, o1, o2, round_even((o0 + 0.36*x - 0.8*y + 0.48*z) / {G}::DOUBLE, 0) AS gx, "
    f"round_even((o1 + 0.48*x + 0.6*y + 0.64*z) / {G}::DOUBLE, 0) AS gy, round_even((o2 - 0.8*x + 0.6*z) / {G}::DOUBLE, 0) AS gz, count(*) AS n FROM hit GROUP BY ALL), "
    f"ctr AS (SELECT *, gx * {G}::DOUBLE - o0 AS e0, gy * {G}::DOUBLE - o1 AS e1, gz * {G}::DOUBLE - o2 AS e2 FROM cnt), "
    "ph AS (SELECT *, (0.36*e0 + 0.48*e1 - 0.8*e2) * 4 AS p0, (-0.8*e0 + 0.6*e1) * 4 AS p1, (0.48*e0 + 0.64*e1 + 0.6*e2) * 4 AS p2 FROM ctr), "
    "bn AS (SELECT *, least(63, floor((p0 - floor(p0)) * 64)) AS b0, least(63, floor((p1 - floor(p1)) * 64)) AS b1, least(63, floor((p2 - floor(p2)) * 64)) AS b2 FROM ph), "
    "nb AS (SELECT a.v AS i, b.v AS j, c.v AS k FROM (SELECT unnest(range(-4, 5)) AS v) a, (SELECT unnest(range(-4, 5)) AS v) b, (SELECT unnest(range(-4, 5)) AS v) c), "
    "dl AS (SELECT b0, b1, b2, i - (b0 + 0.5) / 64 AS x, j - (b1 + 0.5) / 64 AS y, k - (b2 + 0.5) / 64 AS z FROM (SELECT DISTINCT b0, b1, b2 FROM bn), nb), "
    f"cp AS (SELECT b0, b1, b2, count(*) FILTER (abs(0.36*x - 0.8*y + 0.48*z) <= {G}::DOUBLE * 2 AND abs(0.48*x + 0.6*y + 0.64*z) <= {G}::DOUBLE * 2 "
    f"AND abs(-0.8*x + 0.6*z) <= {G}::DOUBLE * 2) AS cap FROM dl GROUP BY ALL) "
    "SELECT CAST(conformer AS INTEGER) AS conformer, o_orderkey, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(gz AS INTEGER) AS gz, "
    "CAST(n AS BIGINT) AS count, CAST(cap AS INTEGER) AS capacity FROM bn JOIN cp USING (b0, b1, b2) WHERE n >= cap * (1.0::DOUBLE / 3)",
)
def anchor(spark, sf_dir):
    regions = domain(spark, sf_dir, "region", "r_regionkey")
    turns = _order_rotations(spark, sf_dir).select(
        F.get(F.lit(regions), (F.col("o_orderkey") % len(regions)).cast("int")).cast("int").alias("conformer"),
        "o_orderkey",
        v.rotvec_matrix("rx", "ry", "rz").alias("m"),
    )
    shapes = anchoring.ring_shapes(_ring_conformers(spark, sf_dir), list(range(2, 8)), _HEXAGON)
    cells = anchoring.candidate_cells(
        turns, shapes, _FILTER, _FRAME, _CENTRE, keys=["conformer", "o_orderkey"]
    )
    return cells.where(F.col("count") >= F.col("capacity") * F.lit(1 / 3))


# ---------------------------------------------------------------- rebuilt poses

_RING_GRID = {"gx": "o_orderkey % 7 - 3", "gy": "o_custkey % 5 - 6", "gz": "(o_orderkey div 7) % 9 - 3"}


def _ring_jobs(spark, sf_dir):
    """Jobs of orders, some with poses that the library lacks, and published coordinates,
    some absent or moved by a hundredth."""
    regions, nations = domain(spark, sf_dir, "region", "r_regionkey"), domain(spark, sf_dir, "nation", "n_nationkey")
    key = F.col("o_orderkey")
    poses = t.read(spark, sf_dir, "orders").select(
        key.alias("pose_id"),
        F.get(F.lit(regions), (key % len(regions)).cast("int")).cast("int").alias("conformer"),
        F.get(F.lit(nations), (F.col("o_custkey") % len(nations)).cast("int")).cast("int").alias("rotamer"),
        *[F.expr(e).cast("int").alias(g) for g, e in _RING_GRID.items()],
    )
    shapes = _ring_conformers(spark, sf_dir)
    vectors = rotvecs(spark, sf_dir).drop("conformer").distinct().withColumn("conformer", F.explode(F.lit(regions)))
    turns = library.rotamers_from_rotvec(vectors.withColumn("conformer", F.col("conformer").cast("int")))
    moved = F.transform("xyz", lambda a: F.array(F.get(a, F.lit(0)) + 0.01, F.get(a, F.lit(1)), F.get(a, F.lit(2))))
    placed = library.pose_coordinates(poses, shapes, turns).where("pose_id % 71 <> 0")
    published = placed.select(
        F.col("pose_id").alias("job"), F.when(F.col("pose_id") % 50 == 0, moved).otherwise(F.col("xyz")).alias("xyz")
    )
    far = F.when(F.col("pose_id") % 61 == 0, 1000).otherwise(0), F.when(F.col("pose_id") % 67 == 0, 1000).otherwise(0)
    jobs = poses.select(
        F.col("pose_id").alias("job"), (F.col("conformer") + far[0]).alias("conformer"), (F.col("rotamer") + far[1]).alias("rotamer"),
        *_RING_GRID, F.lit(0).alias("nucleotide"),
    )
    return jobs, published, shapes, turns


_JOBS_SQL = (
    f"WITH {_RING_SQL}, keyed AS (SELECT o_orderkey AS job, o_custkey, rs[o_orderkey % len(rs) + 1] AS conformer, ns[o_custkey % len(ns) + 1] AS rotamer, "
    "o_orderkey % 7 - 3 AS gx, o_custkey % 5 - 6 AS gy, (o_orderkey // 7) % 9 - 3 AS gz FROM orders, "
    "(SELECT list(r_regionkey ORDER BY r_regionkey) AS rs FROM region), (SELECT list(n_nationkey ORDER BY n_nationkey) AS ns FROM nation)), "
    "said AS (SELECT *, CASE WHEN job % 61 = 0 THEN 'conformer ' || (conformer + 1000) || ' is not in the library' WHEN job % 67 = 0 THEN "
    "'rotamer ' || (rotamer + 1000) || ' of conformer ' || conformer || ' is not in the library' WHEN job % 71 = 0 THEN 'no published coordinates' "
    "WHEN job % 50 = 0 THEN 'reconstructed pose RMSD 0.010000 exceeds 0.002' END AS error FROM keyed), "
    "turnv AS (SELECT n_nationkey AS rotamer, n_nationkey * 0.07::DOUBLE - 0.5::DOUBLE AS rx, n_regionkey * 0.11::DOUBLE + 0.1::DOUBLE AS ry, "
    "n_nationkey * 0.05::DOUBLE AS rz FROM nation), "
    "turnq AS (SELECT rotamer, cos(h / 2) AS w, rx / h * sin(h / 2) AS x, ry / h * sin(h / 2) AS y, rz / h * sin(h / 2) AS z "
    "FROM (SELECT *, sqrt(rx*rx + ry*ry + rz*rz) AS h FROM turnv)), "
    f"turnm AS (SELECT rotamer, {_matrix_sql('wxyz', 'm')} FROM turnq), "
    f"rm AS (SELECT said.job, gx, gy, gz, turnm.*, c0, c1, c2, {_RING_TURNED} FROM said JOIN ringm USING (conformer) JOIN turnm USING (rotamer) WHERE error IS NULL), "
    f"rel AS (SELECT job, {_RELATIVE}, "
    + ", ".join(f"c0*m{k} + c1*m{3 + k} + c2*m{6 + k} + {g} * {G}::DOUBLE - ({_CENTRE[k]}) AS e{k}" for k, g in enumerate(("gx", "gy", "gz")))
    + " FROM rm), "
    "loc AS (SELECT job, i AS r33, " + ", ".join(
        " + ".join(f"({_FRAME[3 * k + j]})*e{j}" for j in range(3)) + f" AS {n}" for k, n in enumerate("xyz")
    ) + " FROM rel), "
    "des AS (SELECT job, sqrt(x*x + y*y + z*z) AS d, acos(abs(z) / sqrt(x*x + y*y + z*z)) AS phi, acos(least(1, abs(r33))) AS theta FROM loc), "
    # The same form as of lattice points, from the deviations of the descriptors.
    "sc AS (SELECT *, d - 3.778988652846167::DOUBLE AS a, phi - 0.3359170155526752::DOUBLE AS b, theta - 0.21710309041293038::DOUBLE AS c FROM des), "
    f"scored AS (SELECT job, d, phi, theta, {_DENSITY_SQL} AS score FROM sc), {_FILTERS_SQL}, "
    "w AS (SELECT n.filter, b.filter AS wide FROM filters n JOIN filters b ON n.filter <> b.filter "
    "AND n.cutoff >= b.cutoff AND (n.tilt30 OR NOT b.tilt30) AND (n.disp45 OR NOT b.disp45)), "
    "depth AS (SELECT f.filter, count(w.wide) AS depth FROM filters f LEFT JOIN w USING (filter) GROUP BY f.filter), "
    "v AS (SELECT job, filter, coalesce(d < 5 AND phi < radians(60) AND (NOT tilt30 OR theta < radians(30)) "
    "AND (NOT disp45 OR phi < radians(45)) AND score >= cutoff, false) AS ok FROM scored, filters), "
    "r AS (SELECT v.*, depth FROM v JOIN depth USING (filter) WHERE NOT ok AND NOT EXISTS (SELECT 1 FROM w JOIN v o "
    "ON o.filter = w.wide AND o.job = v.job WHERE w.filter = v.filter AND NOT o.ok)), "
    "imp AS (SELECT v.job, v.filter, max_by(r.filter, (r.depth, r.filter)) AS implied_by FROM v JOIN w USING (filter) "
    "JOIN r ON r.filter = w.wide AND r.job = v.job GROUP BY v.job, v.filter) "
    "SELECT v.job, v.filter, CASE WHEN imp.filter IS NOT NULL THEN 'implied' WHEN v.ok THEN 'accepted' ELSE 'rejected' END AS state, "
    "imp.implied_by, NULL::VARCHAR AS error FROM v LEFT JOIN imp ON imp.job = v.job AND imp.filter = v.filter "
    "UNION ALL SELECT job, NULL, 'error', NULL, error FROM said WHERE error IS NOT NULL"
)


@query("stacking_check_of_rebuilt_poses", _JOBS_SQL)
def stacking_check_of_rebuilt_poses(spark, sf_dir):
    jobs, published, shapes, turns = _ring_jobs(spark, sf_dir)
    ring = list(range(2, 8))
    return rebuild.check_rebuilt(jobs, published, shapes, turns, [ring, ring], [_HEXAGON, _HEXAGON], _FRAME, _CENTRE)


# ---------------------------------------------------------------- chains in space


# Two atoms a nucleotide for the poses of chains, one conformer and one rotamer a nation.
_CHAIN_ATOMS = [(0.4, 1.1, -0.7), (-0.9, 0.3, 0.8), (1.3, -0.6, 0.2), (-0.5, -1.2, 0.6)]
_CHAIN_REFERENCE = [[3.0, 1.0, 0.5], [4.5, -0.5, 1.0], [6.0, 0.5, 2.0], [7.5, -1.0, 1.5]]


def _chain_library(spark, sf_dir):
    """Conformers and rotamers of every nation key."""
    nations = t.read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    atoms = [F.array(F.lit(x) + key * 0.03, F.lit(y) - key * 0.02, F.lit(z) * (key % 5 + 1.0)) for x, y, z in _CHAIN_ATOMS]
    shapes = nations.select(key.cast("int").alias("conformer"), F.array(*atoms).alias("coords"))
    keys = F.explode(F.lit(domain(spark, sf_dir, "nation", "n_nationkey"))).alias("c")
    turns = nations.select(key, keys).select(
        F.col("c").cast("int").alias("conformer"),
        key.cast("int").alias("rotamer"),
        (key * 0.07 - 0.5).alias("rx"),
        (F.col("c") * 0.03 + 0.1).alias("ry"),
        (key * 0.05).alias("rz"),
    )
    return shapes, library.rotamers_from_rotvec(turns)


def _numbered(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    return layers, chains.number_chains(chains.path_table(layers), layers.names)


def _numbered_poses(spark, sf_dir):
    """Numbered chains with their poses."""
    layers = _layers(spark, sf_dir)
    return layers, chains.number_posed_chains(chains.posed_path_table(layers), len(layers.names))


def _turned(layers, measure):
    """``(layer, conformer, rotamer, first, second)`` of what ``measure`` gives for the rotations of each layer at the origin."""
    values = None
    for position, poses in enumerate(layers.poses):
        used = stage(poses.select("conformer", "rotamer").distinct(), "rotations")
        at_origin = used.select("*", *[F.lit(0).alias(g) for g in ("gx", "gy", "gz")], F.monotonically_increasing_id().alias("pose_id"))
        found = measure(with_bound(at_origin, row_bound(used)), "conformer", "rotamer")
        found = found.select(F.lit(position).alias("layer"), "conformer", "rotamer", "first", "second")
        values = found if values is None else values.unionByName(found)
    return stage(values, "turned")


def _by_layer(layers, measure):
    """``(layer, node, first, second)`` of what ``measure`` gives for the poses of each layer."""
    values = None
    for position, nodes in enumerate(layers.nodes):
        poses = with_bound(nodes.withColumnRenamed("node", "pose_id"), row_bound(nodes))
        found = measure(poses).select(F.lit(position).alias("layer"), F.col("pose_id").alias("node"), "first", "second")
        values = found if values is None else values.unionByName(found)
    return stage(values, "chain-values")


_CHAIN_LIB_SQL = (
    "ca(a, ax, ay, az, qx, qy, qz) AS (VALUES " + ", ".join(
        f"({n}, " + ", ".join(f"{float(x)!r}::DOUBLE" for x in (*atom, *ref)) + ")"
        for n, (atom, ref) in enumerate(zip(_CHAIN_ATOMS, _CHAIN_REFERENCE))
    ) + "), "
    "catoms AS (SELECT n_nationkey AS conformer, a, ax + n_nationkey * 0.03::DOUBLE AS x, ay - n_nationkey * 0.02::DOUBLE AS y, "
    "az * (n_nationkey % 5 + 1.0::DOUBLE) AS z, qx, qy, qz FROM nation, ca), "
    "cv AS (SELECT c.n_nationkey AS conformer, r.n_nationkey AS rotamer, r.n_nationkey * 0.07::DOUBLE - 0.5::DOUBLE AS rx, "
    "c.n_nationkey * 0.03::DOUBLE + 0.1::DOUBLE AS ry, r.n_nationkey * 0.05::DOUBLE AS rz FROM nation c, nation r), "
    "cq AS (SELECT conformer, rotamer, cos(h / 2) AS w, rx / h * sin(h / 2) AS x, ry / h * sin(h / 2) AS y, rz / h * sin(h / 2) AS z "
    "FROM (SELECT *, sqrt(rx*rx + ry*ry + rz*rz) AS h FROM cv)), "
    f"cm AS (SELECT conformer, rotamer, {_matrix_sql('wxyz', 'm')} FROM cq), "
    "cturned AS MATERIALIZED (SELECT conformer, rotamer, a, qx, qy, qz, x*m0 + y*m3 + z*m6 AS x, x*m1 + y*m4 + z*m7 AS y, x*m2 + y*m5 + z*m8 AS z "
    "FROM catoms JOIN cm USING (conformer)), "
    + ", ".join(
        f"v{n} AS MATERIALIZED (SELECT node, a, qx, qy, qz, x + gx * {G}::DOUBLE AS x, y + gy * {G}::DOUBLE AS y, z + gz * {G}::DOUBLE AS z "
        f"FROM (SELECT DISTINCT node, conformer, rotamer, gx, gy, gz FROM n{n} JOIN {pool} USING (pose_id)) JOIN cturned USING (conformer, rotamer))"
        for n, pool in ((1, "customers"), (2, "order_pool"), (3, "lines"))
    )
)
_CHAIN_SQL = f"{_CHAINS}, {_NUMBERED.replace(' AS (', ' AS MATERIALIZED (', 1)}, {_CHAIN_LIB_SQL}"
_NUCLEOTIDE_RMSD = ", ".join(
    f"round_even(sqrt(sum((x - qx) ** 2 + (y - qy) ** 2 + (z - qz) ** 2) FILTER (a // 2 = {n}) / 2.0), 3) AS {name}"
    for n, name in enumerate(("first", "second"))
)


@query(
    "chain_rmsd",
    f"{_CHAIN_SQL}, " + ", ".join(f"r{n} AS MATERIALIZED (SELECT node, {_NUCLEOTIDE_RMSD} FROM v{n} GROUP BY node)" for n in (1, 2, 3))
    + " SELECT chain, round_even(sqrt((r1.first ** 2 + ((r1.second + r2.first) / 2) ** 2 + ((r2.second + r3.first) / 2) ** 2 "
    "+ r3.second ** 2) / 4), 3) AS chain_rmsd FROM numbered JOIN r1 ON r1.node = frag1 JOIN r2 ON r2.node = frag2 JOIN r3 ON r3.node = frag3",
)
def chain_rmsd(spark, sf_dir):
    layers, numbered = _numbered(spark, sf_dir)
    shapes, turns = _chain_library(spark, sf_dir)
    values = _by_layer(layers, lambda poses: rmsd.ensemble_rmsd(poses, shapes, turns, _CHAIN_REFERENCE, 2))
    return rmsd.chain_rmsd(numbered, layers.names, values)


_SHARED = "round((p.{c} + q.{c}) / 2, 6) AS {c}"


@query(
    "chain_coordinates",
    f"{_CHAIN_SQL} SELECT chain, 0 AS nucleotide, CAST(a AS INTEGER) AS atom, " + ", ".join(f"round({c}, 6) AS {c}" for c in "xyz")
    + " FROM numbered JOIN v1 ON node = frag1 WHERE a < 2 "
    + "".join(
        f"UNION ALL SELECT chain, {n}, CAST(q.a AS INTEGER), " + ", ".join(_SHARED.format(c=c) for c in "xyz")
        + f" FROM numbered JOIN v{n} p ON p.node = frag{n} JOIN v{n + 1} q ON q.node = frag{n + 1} AND q.a = p.a - 2 "
        for n in (1, 2)
    )
    + "UNION ALL SELECT chain, 3, CAST(a - 2 AS INTEGER), " + ", ".join(f"round({c}, 6) AS {c}" for c in "xyz")
    + " FROM numbered JOIN v3 ON node = frag3 WHERE a >= 2",
)
def chain_coordinates(spark, sf_dir):
    layers, numbered = _numbered_poses(spark, sf_dir)
    coords = rmsd.chain_coordinates(numbered, _turned(layers, _halves(spark, sf_dir)), len(layers.names))
    atoms = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda a: F.slice("xyz", a * 3 + 1, F.lit(3)))
    return coords.select("chain", "nucleotide", F.posexplode(atoms).alias("atom", "p")).select(
        "chain", "nucleotide", "atom", *[F.round(F.get("p", F.lit(k)), 6).alias(n) for k, n in enumerate("xyz")]
    )


CHAIN_NEAR = 0.4


def _halves(spark, sf_dir):
    """Placed atoms of the two nucleotides of a pose, flat."""
    shapes, turns = _chain_library(spark, sf_dir)

    def measure(poses, *kept):
        placed = library.pose_coordinates(poses, shapes, turns)
        return placed.select(
            "pose_id", *kept, F.flatten(F.slice("xyz", 1, 2)).alias("first"), F.flatten(F.slice("xyz", 3, 2)).alias("second")
        )

    return measure


_CHAIN_FLAT = ", ".join(
    f"l{n} AS MATERIALIZED (SELECT node, list([x, y, z] ORDER BY a) AS p FROM v{n} GROUP BY node)" for n in (1, 2, 3)
)


def _mean_sql(a, b):
    return "[" + ", ".join(f"({a}[{k}] + {b}[{k}]) / 2" for k in (1, 2, 3)) + "]"


@query(
    "chain_pairs_below_rmsd",
    f"{_CHAIN_SQL}, {_CHAIN_FLAT}, "
    "c AS MATERIALIZED (SELECT chain, flatten([l1.p[1], l1.p[2], "
    + ", ".join(_mean_sql(f"l{n}.p[{a + 2}]", f"l{n + 1}.p[{a}]") for n in (1, 2) for a in (1, 2))
    + ", l3.p[3], l3.p[4]]) AS x FROM numbered JOIN l1 ON l1.node = frag1 JOIN l2 ON l2.node = frag2 JOIN l3 ON l3.node = frag3), "
    # Eight atoms: the first one differs by less than sqrt(8) times the limit.
    "near AS (SELECT unnest(range(-1, 2)) AS d), "
    "k AS MATERIALIZED (SELECT chain, x, CAST(floor(x[1] / 1.2) AS BIGINT) AS k1, CAST(floor(x[2] / 1.2) AS BIGINT) AS k2, CAST(floor(x[3] / 1.2) AS BIGINT) AS k3 FROM c), "
    "m AS (SELECT a.chain AS i, b.chain AS j, sqrt(list_sum(list_transform(range(1, 25), lambda n: (a.x[n] - b.x[n]) ** 2)) / 8.0) AS d "
    "FROM (SELECT k.*, k1 + p.d AS n1, k2 + q.d AS n2, k3 + r.d AS n3 FROM k, near p, near q, near r) a "
    "JOIN k b ON b.k1 = a.n1 AND b.k2 = a.n2 AND b.k3 = a.n3 AND a.chain < b.chain) "
    f"SELECT i, j, round(d, 6) AS rmsd FROM m WHERE d < {CHAIN_NEAR}::DOUBLE",
)
def chain_pairs_below_rmsd(spark, sf_dir):
    layers, numbered = _numbered_poses(spark, sf_dir)
    pairs = rmsd.chain_pairs_below(numbered, _turned(layers, _halves(spark, sf_dir)), len(layers.names), CHAIN_NEAR)
    return pairs.select("i", "j", F.round("rmsd", 6).alias("rmsd"))


# ---------------------------------------------------------------- mutation


@query(
    "mutate_adenine_to_guanine",
    f"WITH e AS (SELECT vec_id, list_transform(range(22), lambda a: [{PADDED}[a * 3 + 1]::DOUBLE + a, "
    f"{PADDED}[a * 3 + 2]::DOUBLE, {PADDED}[a * 3 + 3]::DOUBLE - (a % 4)]) AS c FROM embeddings), "
    "f AS (SELECT vec_id, c, list_transform(range(1, 4), lambda k: c[12][k] - c[9][k]) AS x, "
    "list_transform(range(1, 4), lambda k: c[14][k] - c[9][k]) AS p FROM e), "
    "g AS (SELECT *, [x[2]*p[3] - x[3]*p[2], x[3]*p[1] - x[1]*p[3], x[1]*p[2] - x[2]*p[1]] AS z FROM f), "
    "h AS (SELECT *, [z[2]*x[3] - z[3]*x[2], z[3]*x[1] - z[1]*x[3], z[1]*x[2] - z[2]*x[1]] AS y FROM g) "
    "SELECT vec_id, " + ", ".join(
        f"round(c[9][{k}] + 4.66517696::DOUBLE * x[{k}] / sqrt(list_sum(list_transform(x, lambda q: q * q))) "
        f"- 0.69231318::DOUBLE * y[{k}] / sqrt(list_sum(list_transform(y, lambda q: q * q))), 6) AS {n}"
        for k, n in ((1, "x"), (2, "y"), (3, "z"))
    ) + ", CAST(23 AS INTEGER) AS atoms FROM h",
)
def mutate_adenine_to_guanine(spark, sf_dir):
    atoms = F.transform(
        F.sequence(F.lit(0), F.lit(21)),
        lambda a: F.array(
            F.get(padded(), a * 3).cast("double") + a,
            F.get(padded(), a * 3 + 1).cast("double"),
            F.get(padded(), a * 3 + 2).cast("double") - a % 4,
        ),
    )
    changed = t.read(spark, sf_dir, "embeddings").select("vec_id", atoms.alias("a")).select(
        "vec_id", nucleotides.mutate(F.col("a"), "A", "G", centre=False).alias("g")
    )
    new = F.get("g", F.lit(nucleotides.G_PLACE))
    return changed.select(
        "vec_id",
        *[F.round(F.get(new, F.lit(k)), 6).alias(n) for k, n in enumerate("xyz")],
        F.size("g").alias("atoms"),
    )
