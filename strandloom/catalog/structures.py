"""Queries over structures, records, beads, energies and grid balls."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.catalog import tables as t
from strandloom.catalog.geometry import DOCK, LIB, PADDED, G, conformers, dock_pool, padded, rotamers
from strandloom.constants import POSE
from strandloom.operators import energy, grow, library, pool, structure
from strandloom.sources import pdb
from strandloom.staging import row_bound

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query(
    "pool_row_range",
    f"WITH {t.ORDERS} SELECT pose_id, conformer, rotamer, gx, gy, gz FROM order_pool "
    "WHERE pose_id >= (SELECT count(*) FROM orders) // 3 AND pose_id < 2 * (SELECT count(*) FROM orders) // 3",
)
def pool_row_range(spark, sf_dir):
    """Second of three chunks: the range is the operator."""
    orders = t.orders(spark, sf_dir)
    first, last = pool.chunk_range(row_bound(orders), 2, 3)
    return pool.pose_range(orders, first, last).select("pose_id", *POSE)


@query("score_concat", f"WITH {t.ORDERS} SELECT pose_id, score FROM order_pool")
def score_concat(spark, sf_dir):
    orders = t.orders(spark, sf_dir)
    rows = row_bound(orders)
    chunks = [
        pool.pose_range(orders, *pool.chunk_range(rows, part, 3)).select("pose_id", "score")
        for part in (1, 2, 3)
    ]
    return pool.score_concat(chunks, rows)


# Fifty orders are one structure, each order a residue with two atoms.
_GAP = "(o_totalprice / 250000.0::DOUBLE)"


@query(
    "structure_dinucleotides",
    "WITH n AS (SELECT o_orderkey // 50 AS structure, o_orderkey % 50 + 1 AS resid, "
    f"substring('ACGU', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS base, o_orderkey % 50 * 2.0::DOUBLE AS px, {_GAP} AS py FROM orders) "
    "SELECT a.structure, CAST(a.resid AS INTEGER) AS fragment, a.base || b.base AS sequence, a.px AS x1, b.py AS y2 FROM n a JOIN n b "
    "ON b.structure = a.structure AND b.resid = a.resid + 1 WHERE sqrt((a.px + 1.5 - b.px) ** 2 + (a.py + 0.75 - b.py) ** 2) <= 1.2 * 11 / 6",
)
def structure_dinucleotides(spark, sf_dir):
    orders = t.read(spark, sf_dir, "orders")
    x, y = F.expr("o_orderkey % 50 * 2.0D"), F.col("o_totalprice") / 250000.0
    atoms = F.array(
        F.struct(F.lit(" P").alias("name"), F.lit(1).alias("index"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z")),
        F.struct(F.lit(" O3*").alias("name"), F.lit(2).alias("index"), (x + 1.5).alias("x"), (y + 0.75).alias("y"), F.lit(0.0).alias("z")),
    )
    table = orders.select(
        F.expr("o_orderkey div 50").alias("structure"),
        F.expr("cast(o_orderkey % 50 + 1 as int)").alias("resid"),
        F.expr("concat('R', substring('ACGU', cast(o_custkey % 4 + 1 as int), 1))").alias("resname"),
        F.explode(atoms).alias("a"),
    ).select("structure", "resid", "resname", "a.*")
    places = [(base, name, place) for base in "ACGU" for place, name in enumerate(("P", "O3'"))]
    template = spark.createDataFrame(places, "base string, name string, place int")
    found = structure.dinucleotides(structure.nucleotides(table, template))
    entry = lambda n, k: F.get(F.get("coords", F.lit(n)), F.lit(k))
    return found.select(
        "structure", "fragment", "sequence", entry(0, 0).alias("x1"), entry(2, 1).alias("y2")
    )


# As above, with three exact decimals.
_TEXT_SQL = " || chr(10) || ".join(
    f"printf('ATOM  %5d {name} %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00         A {name.strip()[0]}  ', {n}, {r}.base, {resid}, "
    f"{r}.px + {dx}::DOUBLE, {r}.py + {dy}::DOUBLE, 0.0::DOUBLE)"
    for n, (name, r, resid, dx, dy) in enumerate(
        ((" P  ", "a", 1, 0.0, 0.0), (" O3''", "a", 1, 1.5, 0.75), (" P  ", "b", 2, 0.0, 0.0), (" O3''", "b", 2, 1.5, 0.75)), start=1
    )
)


@query(
    "reference_fragment_texts",
    "WITH n AS (SELECT o_orderkey // 50 AS structure, o_orderkey % 50 + 1 AS resid, substring('ACGU', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS base, "
    "o_orderkey % 50 * 2.0::DOUBLE AS px, floor(o_totalprice / 250.0::DOUBLE) / 1000.0::DOUBLE AS py FROM orders) "
    "SELECT a.structure, 'frag-' || a.resid || '-' || a.base || b.base || '-refe.pdb' AS name, "
    f"{_TEXT_SQL} || chr(10) AS text FROM n a JOIN n b ON b.structure = a.structure AND b.resid = a.resid + 1 "
    "WHERE sqrt((a.px + 1.5 - b.px) ** 2 + (a.py + 0.75 - b.py) ** 2) <= 1.2 * 11 / 6",
)
def reference_fragment_texts(spark, sf_dir):
    x, y = F.expr("o_orderkey % 50 * 2.0D"), F.floor(F.col("o_totalprice") / 250.0) / 1000.0
    atoms = F.array(
        F.struct(F.lit(" P").alias("name"), F.lit(1).alias("index"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z")),
        F.struct(F.lit(" O3*").alias("name"), F.lit(2).alias("index"), (x + 1.5).alias("x"), (y + 0.75).alias("y"), F.lit(0.0).alias("z")),
    )
    table = t.read(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 50").alias("structure"),
        F.expr("cast(o_orderkey % 50 + 1 as int)").alias("resid"),
        F.expr("substring('ACGU', cast(o_custkey % 4 + 1 as int), 1)").alias("resname"),
        F.explode(atoms).alias("a"),
    ).select("structure", "resid", "resname", "a.*")
    single = [(base, name, place) for base in "ACGU" for place, name in enumerate(("P", "O3'"))]
    nucs = structure.nucleotides(table, spark.createDataFrame(single, "base string, name string, place int"))
    rows = [
        (a + b, place, "", name, " ", (a, b)[place // 2], "A", place + 1, " ", place // 2 + 1, 1.0, 0.0, "A", name[0])
        for a in "ACGU" for b in "ACGU" for place, name in enumerate(("P", "O3'") * 2)
    ]
    template = spark.createDataFrame(
        rows,
        "sequence string, place int, hetero string, name string, altloc string, resname string, chain string, index int, "
        "icode string, resid int, occupancy double, bfactor double, segid string, element string",
    )
    return pdb.fragment_texts(structure.dinucleotides(nucs), template).select("structure", "name", "text")


# One atom per line item, with exact three-decimal coordinates.
_ATOM = {
    "index": "l_linenumber",
    "resid": "l_orderkey % 9000 + 1",
    "x": "l_quantity * 1.5{d} - 30.0{d}",
    "y": "floor(l_extendedprice / 10.0{d}) / 100.0{d}",
    "z": "l_partkey % 999 - 0.5{d}",
}
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _record_atoms(spark, sf_dir):
    e = {k: F.expr(v.format(d="D")) for k, v in _ATOM.items()}
    return t.read(spark, sf_dir, "lineitem").select(
        *_KEYS,
        F.lit("").alias("hetero"),
        F.lit("N1").alias("name"),
        F.lit(" ").alias("altloc"),
        F.expr("element_at(array('A', 'C', 'G', 'U'), cast(l_suppkey % 4 + 1 as int))").alias("resname"),
        F.lit("B").alias("chain"),
        e["index"].cast("int").alias("index"),
        F.lit(" ").alias("icode"),
        e["resid"].cast("int").alias("resid"),
        e["x"].alias("x"),
        e["y"].alias("y"),
        e["z"].alias("z"),
        F.lit(1.0).alias("occupancy"),
        F.lit(0.0).alias("bfactor"),
        F.lit("B").alias("segid"),
        F.lit("N").alias("element"),
    )


@query(
    "structure_record_lines",
    f"SELECT {', '.join(_KEYS)}, printf('ATOM  %5d  N1    %1s B%4d    %8.3f%8.3f%8.3f  1.00  0.00         B N  ', l_linenumber, "
    "['A', 'C', 'G', 'U'][l_suppkey % 4 + 1], l_orderkey % 9000 + 1, l_quantity * 1.5::DOUBLE - 30.0::DOUBLE, "
    "floor(l_extendedprice / 10.0::DOUBLE) / 100.0::DOUBLE, l_partkey % 999 - 0.5::DOUBLE) AS line FROM lineitem",
)
def structure_record_lines(spark, sf_dir):
    return _record_atoms(spark, sf_dir).select(*_KEYS, pdb.record().alias("line"))


@query(
    "structure_records_parsed_back",
    f"SELECT {', '.join(_KEYS)}, 'N1' AS name, ['A', 'C', 'G', 'U'][l_suppkey % 4 + 1] AS resname, CAST(l_orderkey % 9000 + 1 AS INTEGER) AS resid, "
    "l_quantity * 1.5::DOUBLE - 30.0::DOUBLE AS x, floor(l_extendedprice / 10.0::DOUBLE) / 100.0::DOUBLE AS y, "
    "l_partkey % 999 - 0.5::DOUBLE AS z FROM lineitem",
)
def structure_records_parsed_back(spark, sf_dir):
    lines = _record_atoms(spark, sf_dir).select(*_KEYS, pdb.record().alias("value"))
    return pdb.parse_records(lines).select(*_KEYS, "name", "resname", "resid", "x", "y", "z")


@query(
    "bead_reduction",
    f"WITH a AS (SELECT vec_id, n // 3 AS atom, n % 3 AS k, e FROM (SELECT vec_id, unnest({PADDED})::DOUBLE AS e, "
    f"generate_subscripts({PADDED}, 1) - 1 AS n FROM embeddings)) SELECT vec_id, CAST(atom // 3 AS INTEGER) AS bead, "
    "round(avg(e) FILTER (k = 0), 9) AS x, round(avg(e) FILTER (k = 1), 9) AS y, round(avg(e) FILTER (k = 2), 9) AS z "
    "FROM a GROUP BY vec_id, atom // 3",
)
def bead_reduction(spark, sf_dir):
    atoms = (
        t.read(spark, sf_dir, "embeddings")
        .select("vec_id", padded().alias("values"), F.explode(F.sequence(F.lit(0), F.lit(21))).alias("n"))
        .select(
            "vec_id",
            F.lit("RES").alias("resname"),
            F.format_string("A%d", "n").alias("name"),
            *[F.get("values", F.col("n") * 3 + k).cast("double").alias(c) for k, c in enumerate("xyz")],
        )
    )
    beads = spark.createDataFrame(
        [("RES", n // 3, 30 + n // 3, f"A{n}", min(3, 22 - n // 3 * 3)) for n in range(22)],
        "resname string, bead int, atom_type int, name string, bead_atoms int",
    )
    reduced = library.reduce_to_beads(atoms, beads, ["vec_id"])
    return reduced.select("vec_id", "bead", *[F.round(c, 9).alias(c) for c in "xyz"])


@query(
    "reduced_library",
    f"WITH {LIB} SELECT CAST(conformer AS INTEGER) AS conformer, CAST(atom // 3 AS INTEGER) AS bead, CAST(30 + atom // 3 AS INTEGER) AS atom_type, "
    "round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM atoms GROUP BY conformer, atom // 3",
)
def reduced_library(spark, sf_dir):
    template = spark.createDataFrame([(n, 1, "RES", f"A{n}") for n in range(22)], "place int, resid int, resname string, name string")
    beads = spark.createDataFrame(
        [("RES", n // 3, 30 + n // 3, f"A{n}", min(3, 22 - n // 3 * 3)) for n in range(22)],
        "resname string, bead int, atom_type int, name string, bead_atoms int",
    )
    found = library.reduced_library(conformers(spark, sf_dir), template, beads)
    rows = found.select("conformer", "atom_types", F.posexplode("coords").alias("bead", "p"))
    return rows.select(
        "conformer", "bead", F.get("atom_types", F.col("bead")).alias("atom_type"),
        *[F.round(F.get("p", F.lit(k)), 9).alias(c) for k, c in enumerate("xyz")],
    )


@query(
    "pose_record_lines",
    f"WITH {LIB}, {DOCK} SELECT p.pose_id, CAST(t.atom + 1 AS INTEGER) AS atom, printf('ATOM  %5d  N1    A B%4d    %8.3f%8.3f%8.3f  1.00  0.00         B N  ', "
    f"t.atom + 1, t.atom // 11 + 1, t.x + p.gx * {G}::DOUBLE, t.y + p.gy * {G}::DOUBLE, t.z + p.gz * {G}::DOUBLE) AS line "
    "FROM dock p JOIN turned t ON t.conformer = p.conformer AND t.rotamer = p.rotamer",
)
def pose_record_lines(spark, sf_dir):
    """Poses as structure records, a model each."""
    placed = library.pose_coordinates(
        dock_pool(spark, sf_dir), conformers(spark, sf_dir), rotamers(spark, sf_dir)
    )
    rows = [(n, "", "N1", " ", "A", "B", n + 1, " ", n // 11 + 1, 1.0, 0.0, "B", "N") for n in range(22)]
    template = spark.createDataFrame(
        rows,
        "place int, hetero string, name string, altloc string, resname string, chain string, index int, "
        "icode string, resid int, occupancy double, bfactor double, segid string, element string",
    )
    atoms = pdb.pose_atoms(placed.select("pose_id", "xyz"), template)
    return atoms.select("pose_id", F.col("index").alias("atom"), pdb.record().alias("line"))


_CUTOFF = 6.0


@query(
    "pair_energy_with_receptor",
    f"WITH {LIB}, {DOCK}, rec AS (SELECT s_suppkey % 17 - 8.0::DOUBLE + s_suppkey // 100 * 40 AS x, s_nationkey * 0.5::DOUBLE - 6.0::DOUBLE AS y, "
    "s_acctbal / 1000.0::DOUBLE AS z, CAST(s_suppkey % 3 AS INTEGER) AS type FROM supplier), "
    f"pa AS (SELECT p.pose_id, t.x + p.gx * {G}::DOUBLE + p.pose_id // 15000 * 40 AS x, t.y + p.gy * {G}::DOUBLE AS y, t.z + p.gz * {G}::DOUBLE AS z, "
    "CAST(t.atom % 2 AS INTEGER) AS type FROM dock p JOIN turned t ON t.conformer = p.conformer AND t.rotamer = p.rotamer), "
    "pr AS (SELECT pose_id, (pa.x - rec.x) ** 2 + (pa.y - rec.y) ** 2 + (pa.z - rec.z) ** 2 AS d2, pa.type AS a, rec.type AS b FROM pa, rec), "
    f"en AS (SELECT pose_id, sum((a + b + 1) * 0.5::DOUBLE / (d2 + 4)) AS score FROM pr WHERE d2 < {_CUTOFF}::DOUBLE ** 2 GROUP BY pose_id) "
    "SELECT d.pose_id, round(coalesce(score, 0), 6) AS score FROM dock d LEFT JOIN en USING (pose_id)",
)
def pair_energy_with_receptor(spark, sf_dir):
    scored = energy.score_poses(_typed_poses(spark, sf_dir), _receptor(spark, sf_dir), _kernel, _CUTOFF)
    return scored.select("pose_id", F.round("score", 6).alias("score"))


def _receptor(spark, sf_dir):
    return t.read(spark, sf_dir, "supplier").select(
        F.expr("s_suppkey % 17 - 8.0D + s_suppkey div 100 * 40").alias("x"),
        F.expr("s_nationkey * 0.5D - 6.0D").alias("y"),
        F.expr("s_acctbal / 1000.0D").alias("z"),
        F.expr("cast(s_suppkey % 3 as int)").alias("type"),
    )


def _typed_poses(spark, sf_dir):
    placed = library.pose_coordinates(
        dock_pool(spark, sf_dir), conformers(spark, sf_dir), rotamers(spark, sf_dir)
    )
    # A hundred atoms and fifteen thousand poses share a place, whatever the table's size.
    moved = F.transform(
        "xyz", lambda a: F.array(F.get(a, F.lit(0)) + F.expr("pose_id div 15000 * 40"), F.get(a, F.lit(1)), F.get(a, F.lit(2)))
    )
    return placed.select("pose_id", moved.alias("xyz"), F.lit([n % 2 for n in range(22)]).alias("types"))


def _kernel(square, a, b):
    return (a + b + 1) * 0.5 / (square + 4.0)


@query(
    "pair_energy_with_row_errors",
    SQL["pair_energy_with_receptor"].replace(
        "SELECT d.pose_id, round(coalesce(score, 0), 6) AS score FROM dock d LEFT JOIN en USING (pose_id)",
        "e AS (SELECT pose_id, CASE WHEN pose_id % 97 = 0 THEN '22 coordinates but 21 types' WHEN pose_id % 101 = 0 THEN "
        "'coordinates are not numbers' WHEN pose_id % 103 = 0 THEN 'unknown atom type 7' END AS error FROM dock) "
        "SELECT pose_id, CASE WHEN error IS NULL THEN round(coalesce(score, 0), 6) END AS score, error FROM e LEFT JOIN en USING (pose_id)",
    ).replace("GROUP BY pose_id) e AS", "GROUP BY pose_id), e AS"),
)
def pair_energy_with_row_errors(spark, sf_dir):
    """Some poses lack a type, have a coordinate that is no number, or an unknown type."""
    poses = _typed_poses(spark, sf_dir)
    broken = F.transform("xyz", lambda a, n: F.when(n == 3, F.array(F.lit(float("nan")), F.get(a, F.lit(1)), F.get(a, F.lit(2)))).otherwise(a))
    poses = poses.withColumns(
        {
            "xyz": F.when(F.col("pose_id") % 101 == 0, broken).otherwise(F.col("xyz")),
            "types": F.when(F.col("pose_id") % 97 == 0, F.slice("types", 1, 21))
            .when(F.col("pose_id") % 103 == 0, F.transform("types", lambda x, n: F.when(n == 5, 7).otherwise(x)))
            .otherwise(F.col("types")),
        }
    )
    # Beyond the bound of a broadcast the join is split; here the bound is none.
    scored = energy.score_each(poses, _receptor(spark, sf_dir), _kernel, _CUTOFF, types=[0, 1, 2], max_cells=0)
    return scored.select("pose_id", F.round("score", 6).alias("score"), "error")


@query(
    "grid_points_in_ball",
    "WITH c AS (SELECT c_custkey, c_acctbal / 1000.0::DOUBLE AS x, c_custkey % 7 * 0.31::DOUBLE AS y, c_nationkey * 0.17::DOUBLE AS z, "
    "0.9::DOUBLE + c_custkey % 5 * 0.35::DOUBLE AS r FROM customer), o AS (SELECT unnest(range(-4, 5)) AS v) "
    "SELECT c_custkey, CAST(round_even(x, 0) + a.v AS INTEGER) AS gx, CAST(round_even(y, 0) + b.v AS INTEGER) AS gy, "
    "CAST(round_even(z, 0) + d.v AS INTEGER) AS gz FROM c, o a, o b, o d WHERE (round_even(x, 0) + a.v - x) ** 2 "
    "+ (round_even(y, 0) + b.v - y) ** 2 + (round_even(z, 0) + d.v - z) ** 2 < r * r",
)
def grid_points_in_ball(spark, sf_dir):
    centres = t.read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("c_acctbal / 1000.0D").alias("x"),
        F.expr("c_custkey % 7 * 0.31D").alias("y"),
        F.expr("c_nationkey * 0.17D").alias("z"),
        F.expr("0.9D + c_custkey % 5 * 0.35D").alias("r"),
    )
    points = grow.discrete_ball(centres, ["x", "y", "z"], F.col("r"))
    return points.select("c_custkey", *[F.col(g).cast("int").alias(g) for g in ("gx", "gy", "gz")])
