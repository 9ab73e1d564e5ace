"""Fragment library: conformers, rotamers, exclusion by origin and bead reduction.

``conformers(conformer, coords array<array<double>>)`` and
``rotamers(conformer, rotamer, m array<double>)`` with nine matrix entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.constants import GRID_SPACING
from strandloom.functions import vectors as v
from strandloom.functions.superpose import with_superposed_rmsd
from strandloom.operators.pool import pose_range as poses_of_range
from strandloom.operators.pool import select_poses
from strandloom.staging import bounded_broadcast, present, row_bound, skew_join, spread, with_bound

MAX_SENT_ATOMS = 100_000  # template or bead rows sent to every task


def rotamers_from_rotvec(rotvecs: DataFrame) -> DataFrame:
    """Rotation matrices of ``(conformer, rotamer, rx, ry, rz)``.

    Placing acts on row vectors with this very matrix.
    """
    return rotvecs.select("conformer", "rotamer", v.rotvec_matrix("rx", "ry", "rz").alias("m"))


def atom_subset(conformers: DataFrame, template: list[tuple[str, int]], *,
                nucleotides: list[bool] | None = None, only_base: bool = False) -> DataFrame:
    """Keep the atoms of chosen nucleotides, or base atoms (two-letter names) only.

    ``template`` lists (atom name, nucleotide number) in coordinate order.  The
    coordinates are not centred again.
    """
    keep = [
        n
        for n, (name, nucleotide) in enumerate(template)
        if (nucleotides is None or nucleotides[nucleotide])
        and (not only_base or len(name) == 2)
    ]
    picked = F.array(*[F.get("coords", F.lit(n)) for n in keep])
    return conformers.withColumn("coords", picked)


def exclude_origins(conformers: DataFrame, codes: list[str] | None) -> DataFrame:
    """Conformers without those that come from the given structures.

    ``(conformer, coords, origin, replacement, extension)``: an excluded primary
    conformer takes its replacement coordinates, an excluded extension is dropped.
    """
    if not codes:
        return conformers.select("conformer", "coords", F.lit(False).alias("replaced"))
    excluded = F.lower("origin").isin([c.strip().lower() for c in codes])
    return conformers.where(~(excluded & F.col("extension"))).select(
        "conformer",
        F.when(excluded, F.col("replacement")).otherwise(F.col("coords")).alias("coords"),
        F.coalesce(excluded, F.lit(False)).alias("replaced"),
    )


def conformer_mapping(conformers: DataFrame) -> DataFrame:
    """Position of each remaining conformer; at most 65,536 rows."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("conformer")) - 1
    return conformers.select("conformer", place.alias("position"))


def update_crmsds(crmsds: DataFrame, lower: DataFrame, upper: DataFrame) -> DataFrame:
    """cRMSD pairs after exclusion.

    Pairs with a dropped conformer go; pairs with a replaced one are computed anew
    from the coordinates of the shared nucleotide.  ``crmsds`` lists the pairs, so
    coordinates are joined to it by key and no pair is invented.
    """
    pairs = crmsds.join(
        lower.select(F.col("conformer").alias("lower"), F.col("coords").alias("_cl"), F.col("replaced").alias("_rl")),
        "lower",
    ).join(
        upper.select(F.col("conformer").alias("upper"), F.col("coords").alias("_cu"), F.col("replaced").alias("_ru")),
        "upper",
    )
    stale = F.col("_rl") | F.col("_ru")
    kept = pairs.where(~stale).select("lower", "upper", "crmsd")
    fresh = with_superposed_rmsd(pairs.where(stale).select("lower", "upper", "_cl", "_cu"), "_cl", "_cu", "crmsd")
    return kept.unionByName(fresh.select("lower", "upper", "crmsd"))


def placed(pool: DataFrame, conformers: DataFrame, rotamers: DataFrame) -> DataFrame:
    """Pool with its library rows: adds ``coords`` and ``m``.

    Conformer and rotamer numbers are library keys, so both joins are many to one;
    a pool full of one conformer is split over tasks.
    """
    rows = row_bound(pool)
    shape = [c for c in conformers.columns if c != "conformer"]
    with_shape = skew_join(pool, conformers, ["conformer"], "left_outer", left_rows=rows, right_rows=0)
    turned = skew_join(
        with_shape, rotamers, ["conformer", "rotamer"], "left_outer", left_rows=rows, right_rows=0, counted=pool
    )
    checked = {c: present(F.col(c), "pose refers to a missing conformer") for c in shape}
    return turned.withColumns({**checked, "m": present(F.col("m"), "pose refers to a missing rotamer")})


def place_atom(atom: Column, m: Column, grid: list[Column]) -> list[Column]:
    turned = v.rotate(atom, m)
    return [turned[k] + grid[k] * F.lit(GRID_SPACING) for k in range(3)]


def pose_coordinates(pool: DataFrame, conformers: DataFrame, rotamers: DataFrame) -> DataFrame:
    """Atom coordinates of every pose: ``xyz`` array of [x, y, z]."""
    grid = [F.col(g) for g in ("gx", "gy", "gz")]
    rows = row_bound(pool)
    pool = with_bound(spread(pool, rows, *[c for c in ("pose_id",) if c in pool.columns]), rows)
    found = (
        placed(pool, conformers, rotamers)
        .withColumn(
            "xyz",
            F.transform("coords", lambda a: F.array(*place_atom(a, F.col("m"), grid))),
        )
        .drop("coords", "m")
    )
    return with_bound(found, rows)


def converted_poses(
    pool: DataFrame,
    rotvecs: DataFrame,
    *,
    pose_range: tuple[int, int] | None = None,
    requests: DataFrame | None = None,
) -> DataFrame:
    """External form of a pool: inverse rotation vector, translation and conformer.

    ``pose_range`` takes FIRST..LAST, 1-based and inclusive, ``requests`` the poses of
    ``(request_pos, pose_id)`` with their copies; at most one of the two.
    """
    if pose_range is not None and requests is not None:
        raise ValueError("give a range or an index of poses, not both")
    rows, kept = row_bound(pool), ["pose_id"]
    if pose_range is not None:
        if pose_range[1] > pool.count():
            raise ValueError(f"pose range LAST={pose_range[1]} exceeds the number of poses")
        pool = with_bound(poses_of_range(pool, *pose_range), rows)
    if requests is not None:
        pool, kept = select_poses(pool, requests), ["request_pos", "pose_id"]
        rows = row_bound(requests)
    joined = skew_join(pool, rotvecs, ["conformer", "rotamer"], "left_outer", left_rows=rows, right_rows=0)
    joined = joined.withColumn("rx", present(F.col("rx"), "pose refers to a missing rotamer"))
    return joined.select(
        *kept,
        "conformer",
        *[(-F.col(c)).alias(c) for c in ("rx", "ry", "rz")],
        *[(F.col(g) * F.lit(GRID_SPACING)).alias(n) for g, n in (("gx", "x"), ("gy", "y"), ("gz", "z"))],
    )


def reduce_to_beads(atoms: DataFrame, beads: DataFrame, keys: list[str]) -> DataFrame:
    """Coarse beads: the mean of their atoms.

    ``atoms(keys, resname, name, x, y, z)``; ``beads(resname, bead, atom_type, name,
    bead_atoms)`` lists every atom of a bead with the number it must have.
    """
    joined = atoms.join(bounded_broadcast(beads, MAX_SENT_ATOMS), ["resname", "name"])
    grouped = joined.groupBy(*keys, "resname", "bead", "atom_type", "bead_atoms").agg(
        F.count_distinct("name").alias("_n"), *[F.avg(c).alias(c) for c in "xyz"]
    )
    whole = F.when(F.col("_n") == F.col("bead_atoms"), F.col("x")).otherwise(
        F.raise_error(F.concat(F.lit("bead lacks atoms in residue "), F.col("resname")))
    )
    return grouped.withColumn("x", whole).drop("_n", "bead_atoms")


def atom_types(template: DataFrame) -> DataFrame:
    """``(place, atom_type)`` of a coarse template, whose occupancies are the types."""
    kind = F.col("occupancy")
    whole = F.when(kind == F.floor(kind), kind.cast("int")).otherwise(F.raise_error(F.lit("an occupancy is no atom type")))
    return template.select("place", whole.alias("atom_type"))


def reduced_library(conformers: DataFrame, template: DataFrame, beads: DataFrame) -> DataFrame:
    """Coarse conformers: ``(conformer, coords, atom_types)``, beads by residue and number.

    ``template(place, resid, resname, name)`` names the atom at each place of ``coords``;
    exclusion of structures comes before (see ``exclude_origins``).
    """
    rows = conformers.select("conformer", F.posexplode("coords").alias("place", "c"))
    named = rows.join(bounded_broadcast(template.select("place", "resid", "resname", "name"), MAX_SENT_ATOMS), "place", "left")
    known = present(F.col("name"), "an atom is not in the template")
    atoms = named.select(
        "conformer", "resid", "resname", known.alias("name"), *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate("xyz")]
    )
    found = reduce_to_beads(atoms, beads, ["conformer", "resid"])
    # A conformer has no more beads than its template has atoms.
    ordered = F.sort_array(F.collect_list(F.struct("resid", "bead", "atom_type", F.array("x", "y", "z").alias("p"))))
    return found.groupBy("conformer").agg(ordered.alias("b")).select(
        "conformer", F.transform("b", lambda x: x.p).alias("coords"), F.transform("b", lambda x: x.atom_type).alias("atom_types")
    )
