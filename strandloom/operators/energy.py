"""Pair energies of poses with a receptor, for any pair kernel.

The kernel is a column expression of the squared distance and the two atom types;
the one below is the textbook 8-6 form with user-supplied parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.staging import bounded_broadcast, row_bound, skew_join, spread, stage

# A receptor is one structure; coordinate files number at most 99,999 atoms.
MAX_RECEPTOR_CELLS = 8 * 99_999


def lennard_jones_8_6(square: Column, epsilon: Column, sigma: Column) -> Column:
    s2 = sigma * sigma / square
    s6 = s2 * s2 * s2
    return epsilon * (s6 * s2 - s6)


def pose_errors(types: list[int] | None) -> Column:
    """Why a pose ``(xyz, types)`` cannot be scored, or null."""
    odd = F.exists("xyz", lambda a: F.size(a) != 3) | F.exists(
        F.flatten("xyz"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    )
    error = (
        F.when(F.col("xyz").isNull() | F.col("types").isNull(), F.lit("no atoms"))
        .when(F.size("xyz") != F.size("types"), F.format_string("%d coordinates but %d types", F.size("xyz"), F.size("types")))
        .when(odd, F.lit("coordinates are not numbers"))
    )
    if types is None:
        return error.when(F.exists("types", lambda t: t.isNull()), F.lit("unknown atom type null"))
    strange = F.filter("types", lambda t: t.isNull() | ~t.isin(types))
    text = F.coalesce(F.get(strange, F.lit(0)).cast("string"), F.lit("null"))
    return error.when(F.size(strange) > 0, F.concat(F.lit("unknown atom type "), text))


def score_each(
    poses: DataFrame,
    receptor: DataFrame,
    kernel: Callable[[Column, Column, Column], Column],
    cutoff: float,
    *,
    types: list[int] | None = None,
    max_cells: int = MAX_RECEPTOR_CELLS,
) -> DataFrame:
    """``(pose_id, score, error)``: kernel sum over atom pairs nearer than ``cutoff``.

    ``poses(pose_id, xyz, types)`` holds [x, y, z] arrays and atom types,
    ``receptor(x, y, z, type)`` the atoms.  Receptor atoms are listed in the at most
    eight cells their cutoff ball touches, so each pose atom looks into one cell.
    A pose without neighbours scores zero.  A pose that cannot be scored, or whose energy
    is no number, has an error instead of a score, and the others go on; ``types`` lists
    the known atom types.

    Beyond ``max_cells`` listed receptor atoms both sides are written, and cells where very
    many atoms lie are split.
    """
    width = 2.0 * cutoff
    cells = receptor.select(*[F.col(c).alias(f"r{c}") for c in "xyz"], F.col("type").alias("_rt"))
    for c in "xyz":
        touched = F.sequence(
            F.floor((F.col(f"r{c}") - cutoff) / width), F.floor((F.col(f"r{c}") + cutoff) / width)
        )
        cells = cells.withColumn(f"_{c}", F.explode(touched))
    small = bounded_broadcast(cells, max_cells)
    # The atoms of a pose stay in its task, so the partial sums leave one row per pose
    # for the shuffle.  Poses are few beside their atom pairs; texts of errors would make
    # the sums of all pairs sort, so they are kept apart.
    if hasattr(poses, "_row_bound"):
        poses = spread(poses, row_bound(poses), "pose_id")
    found = poses.select("pose_id", "xyz", "types", pose_errors(types).alias("error"))
    zipped = F.when(F.col("error").isNull(), F.arrays_zip("xyz", "types"))
    atoms = (
        found.select("pose_id", F.explode(zipped).alias("a"))
        .select(
            "pose_id",
            *[F.get("a.xyz", F.lit(k)).alias(f"p{c}") for k, c in enumerate("xyz")],
            F.col("a.types").alias("_pt"),
        )
        .withColumns({f"_{c}": F.floor(F.col(f"p{c}") / width) for c in "xyz"})
    )
    gap = [F.col(f"p{c}") - F.col(f"r{c}") for c in "xyz"]
    square = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
    value = F.when(F.col("_d2") < cutoff * cutoff, kernel(F.col("_d2"), F.col("_pt"), F.col("_rt"))).otherwise(0.0)
    if small is not cells:
        met = atoms.join(small, ["_x", "_y", "_z"])
    else:
        met = skew_join(stage(atoms, "pose-atoms"), stage(cells, "receptor-cells"), ["_x", "_y", "_z"])
    sums = met.withColumn("_d2", square).groupBy("pose_id").agg(F.sum(value).alias("score"))
    # One row per pose from either side: its error, or no neighbour yet.
    every = found.select("pose_id", "error", F.lit(0.0).alias("score"))
    summed = (
        every.unionByName(sums.withColumn("error", F.lit(None).cast("string")))
        .groupBy("pose_id")
        .agg(F.max("error").alias("error"), F.sum("score").alias("score"))
    )
    number = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    error = F.coalesce("error", F.when(~number, F.lit("energy is not a number")))
    return summed.withColumn("error", error).select("pose_id", F.when(F.col("error").isNull(), F.col("score")).alias("score"), "error")


def score_poses(
    poses: DataFrame,
    receptor: DataFrame,
    kernel: Callable[[Column, Column, Column], Column],
    cutoff: float,
) -> DataFrame:
    """``(pose_id, score)`` as ``score_each``; a pose that cannot be scored is an error."""
    scored = score_each(poses, receptor, kernel, cutoff)
    failed = F.raise_error(F.concat(F.lit("pose "), F.col("pose_id").cast("string"), F.lit(": "), F.col("error")))
    return scored.select("pose_id", F.when(F.col("error").isNull(), F.col("score")).otherwise(failed).alias("score"))
