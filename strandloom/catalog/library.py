"""Queries over the fragment library, ranges of it, ring stacking and chain ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.catalog import tables as t
from strandloom.catalog.geometry import LIB, PADDED, conformers, padded, rotamers
from strandloom.catalog.relational import _CHAINS, _NUMBERED, _below_zero, _layers, _parents
from strandloom.functions import stacking
from strandloom.operators import chains, library, lineage, pool, select
from strandloom.staging import row_bound

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def _atoms(table):
    """One row per atom, rounded for comparison."""
    rows = table.select(*[c for c in table.columns if c != "coords"], F.posexplode("coords").alias("atom", "c"))
    return rows.select(
        *[c for c in rows.columns if c != "c"], *[F.round(F.get("c", F.lit(k)), 9).alias(n) for k, n in enumerate("xyz")]
    )


_XYZ = "round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z"


@query(
    "library_conformer_range",
    f"WITH {LIB} SELECT CAST(conformer AS INTEGER) AS conformer, CAST(atom AS INTEGER) AS atom, {_XYZ} FROM atoms WHERE conformer BETWEEN 2 AND 6",
)
def library_conformer_range(spark, sf_dir):
    """Conformers 3 to 7, counted from one."""
    shapes = conformers(spark, sf_dir)
    size = shapes.agg(F.max("conformer")).first()[0] + 1
    return _atoms(select.conformer_range(shapes, first_last=(3, 7), size=size))


@query(
    "library_rotamer_range",
    f"WITH {LIB} SELECT CAST(conformer AS INTEGER) AS conformer, CAST(rotamer AS INTEGER) AS rotamer, round(m0, 9) AS m0, round(m5, 9) AS m5 "
    "FROM rot WHERE rotamer BETWEEN 4 AND 11",
)
def library_rotamer_range(spark, sf_dir):
    """Rotamers 5 to 12 of every conformer, counted from one."""
    chosen = select.rotamer_range(rotamers(spark, sf_dir), 5, 12)
    return chosen.select("conformer", "rotamer", *[F.round(F.get("m", F.lit(k)), 9).alias(f"m{k}") for k in (0, 5)])


@query(
    "library_single_conformer",
    f"WITH {LIB} SELECT CAST(conformer AS INTEGER) AS conformer, CAST(atom AS INTEGER) AS atom, {_XYZ} FROM atoms WHERE conformer = 3",
)
def library_single_conformer(spark, sf_dir):
    shapes = conformers(spark, sf_dir)
    size = shapes.agg(F.max("conformer")).first()[0] + 1
    return _atoms(select.conformer_range(shapes, conformer=4, size=size))


@query(
    "library_base_atoms",
    f"WITH {LIB} SELECT CAST(conformer AS INTEGER) AS conformer, CAST((atom - 11) // 2 AS INTEGER) AS atom, {_XYZ} FROM atoms WHERE atom >= 11 AND atom % 2 = 1",
)
def library_base_atoms(spark, sf_dir):
    """Base atoms, which have two-letter names, of the second nucleotide."""
    template = [(f"C{n % 10}" if n % 2 else f"C{n % 10}'", n // 11) for n in range(22)]
    chosen = library.atom_subset(conformers(spark, sf_dir), template, nucleotides=[False, True], only_base=True)
    return _atoms(chosen)


@query(
    "library_without_origins",
    f"WITH {LIB} SELECT CAST(conformer AS INTEGER) AS conformer, conformer % 3 = 1 AS replaced, CAST(atom AS INTEGER) AS atom, "
    "round(CASE WHEN conformer % 3 = 1 THEN -y ELSE x END, 9) AS x, round(CASE WHEN conformer % 3 = 1 THEN x ELSE y END, 9) AS y, round(z, 9) AS z "
    "FROM atoms WHERE NOT (conformer % 3 = 1 AND conformer % 2 = 0)",
)
def library_without_origins(spark, sf_dir):
    """Conformers of one origin get their replacement, a quarter turn, or go as extensions."""
    turned = F.transform("coords", lambda a: F.array(-F.get(a, F.lit(1)), F.get(a, F.lit(0)), F.get(a, F.lit(2))))
    given = conformers(spark, sf_dir).select(
        "conformer",
        "coords",
        F.concat(F.lit("S"), (F.col("conformer") % 3).cast("string")).alias("origin"),
        turned.alias("replacement"),
        (F.col("conformer") % 2 == 0).alias("extension"),
    )
    return _atoms(library.exclude_origins(given, ["s1 "]).select("conformer", "replaced", "coords"))


@query(
    "lineage_pruned_to_parents",
    f"WITH {t.ORDERS}, {t.LINES} SELECT l.pose_id, o.pose_id AS parent_id FROM lines l JOIN order_pool o ON o.source_id = l.source_id WHERE o.score < 0",
)
def lineage_pruned_to_parents(spark, sf_dir):
    orders, lines = t.orders(spark, sf_dir), t.lines(spark, sf_dir)
    keys = _below_zero(orders).select(F.col("parent_id").alias("pose_id"))
    return lineage.prune(_parents(lines, orders, "source_id"), keys)


@query(
    "scores_in_request_order",
    f"WITH {t.ORDERS} SELECT o_orderkey AS request_pos, score FROM orders JOIN order_pool ON source_id = o_orderkey",
)
def scores_in_request_order(spark, sf_dir):
    """Scores of a selection back in the order in which it was asked for."""
    orders = t.orders(spark, sf_dir)
    asked = orders.select(F.col("source_id").alias("request_pos"), "pose_id")
    return pool.scatter(orders.select("pose_id", "score"), asked, "score")


@query(
    "chain_range",
    f"{_CHAINS}, {_NUMBERED} SELECT chain, frag1, frag2, frag3 FROM numbered "
    "WHERE chain BETWEEN (SELECT count(*) FROM paths) // 3 + 1 AND 2 * (SELECT count(*) FROM paths) // 3",
)
def chain_range(spark, sf_dir):
    """The second third of the chains: the range is the operator."""
    layers = _layers(spark, sf_dir)
    numbered = chains.number_chains(chains.enumerate_chains(layers), layers.names)
    total = row_bound(numbered)
    return chains.chain_range(numbered, total // 3 + 1, 2 * total // 3, total)


def _ring_sql(name, first, atoms):
    """Centre, scatter and unit normal of a ring cut out of an embedding."""
    moments = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return (
        f"{name}_a AS (SELECT vec_id, n, {PADDED}[{first} + 3 * n + 1]::DOUBLE AS x, {PADDED}[{first} + 3 * n + 2]::DOUBLE AS y, "
        f"{PADDED}[{first} + 3 * n + 3]::DOUBLE AS z FROM embeddings, range({atoms}) AS r(n)), "
        f"{name}_c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {name}_a GROUP BY vec_id), "
        f"{name}_d AS (SELECT vec_id, n, x - cx AS x, y - cy AS y, z - cz AS z FROM {name}_a JOIN {name}_c USING (vec_id)), "
        f"{name}_m AS (SELECT vec_id, " + ", ".join(f"sum({a} * {b}) AS {a}{b}" for a, b in moments) + ", "
        + ", ".join(f"max({c}) FILTER (n = {k}) AS {c}{k}" for c in "xyz" for k in range(3)) + f" FROM {name}_d GROUP BY vec_id), "
        f"{name}_q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {name}_m), "
        f"{name}_p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM {name}_q), "
        f"{name}_l AS (SELECT *, q + 2 * p * cos(acos(least(greatest(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) "
        f"+ xz * (xy * yz - (yy - q) * xz)) / p ** 3 / 2, -1), 1)) / 3 + 2 * pi() / 3) AS l FROM {name}_p), "
        f"{name}_v AS (SELECT *, list_sort([[(xy * yz - xz * (yy - l)), (xz * xy - (xx - l) * yz), ((xx - l) * (yy - l) - xy * xy)], "
        f"[(xy * (zz - l) - xz * yz), (xz * xz - (xx - l) * (zz - l)), ((xx - l) * yz - xy * xz)], "
        f"[((yy - l) * (zz - l) - yz * yz), (yz * xz - xy * (zz - l)), (xy * yz - (yy - l) * xz)]]) AS vs, "
        f"[(y1 - y0) * (z2 - z1) - (z1 - z0) * (y2 - y1), (z1 - z0) * (x2 - x1) - (x1 - x0) * (z2 - z1), (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1)] AS t FROM {name}_l), "
        f"{name}_w AS (SELECT *, list_sort(list_transform(vs, lambda v: {{'n': v[1] ** 2 + v[2] ** 2 + v[3] ** 2, 'v': v}}), 'DESC')[1] AS w FROM {name}_v), "
        f"{name} AS (SELECT vec_id, x0, y0, z0, list_transform(w.v, lambda c: c * sign(w.v[1] * t[1] + w.v[2] * t[2] + w.v[3] * t[3]) / sqrt(w.n)) AS n FROM {name}_w)"
    )


@query(
    "stacking_angle_and_dihedral",
    f"WITH {_ring_sql('pro', 0, 6)}, {_ring_sql('nuc', 18, 9)}, "
    "j AS (SELECT p.vec_id, p.n AS n, u.n AS m, p.x0 AS px, p.y0 AS py, p.z0 AS pz, u.x0 AS ux, u.y0 AS uy, u.z0 AS uz FROM pro p JOIN nuc u USING (vec_id)), "
    "f AS (SELECT *, ux - h * n[1] AS fx, uy - h * n[2] AS fy, uz - h * n[3] AS fz FROM (SELECT *, ux * n[1] + uy * n[2] + uz * n[3] AS h FROM j)), "
    "y AS (SELECT *, n[2] * pz - n[3] * py AS yx, n[3] * px - n[1] * pz AS yy, n[1] * py - n[2] * px AS yz FROM f) "
    "SELECT vec_id, round(acos(least(abs(n[1] * m[1] + n[2] * m[2] + n[3] * m[3]), 1)), 6) AS angle, "
    "round(atan2((fx * yx + fy * yy + fz * yz) / sqrt(yx ** 2 + yy ** 2 + yz ** 2), (fx * px + fy * py + fz * pz) / sqrt(px ** 2 + py ** 2 + pz ** 2)), 6) AS dihedral FROM y",
)
def stacking_angle_and_dihedral(spark, sf_dir):
    """Six atoms of an embedding are the protein ring, the next nine the nucleotide ring."""
    values = F.transform(padded(), lambda x: x.cast("double"))
    rows = t.read(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice(values, 1, 18).alias("p"), F.slice(values, 19, 27).alias("n")
    )
    found = stacking.stacking_angle_dihedral(rows, "p", "n")
    return found.select("vec_id", F.round("angle", 6).alias("angle"), F.round("dihedral", 6).alias("dihedral"))
