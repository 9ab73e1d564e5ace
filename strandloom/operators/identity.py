"""Set operations on pools, with the map from every input row to its output row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.constants import BUCKET, POSE
from strandloom.operators.pool import organize
from strandloom.staging import row_bound, skew_join, with_bound


def _map(pool: DataFrame, output: DataFrame) -> DataFrame:
    """``(parent_id, pose_id)``: one row per input row that survived."""
    source = pool.select(F.col("pose_id").alias("parent_id"), *POSE)
    target = output.select("pose_id", *POSE)
    rows = row_bound(pool)
    joined = skew_join(source, target, POSE, left_rows=rows, right_rows=row_bound(output))
    return with_bound(joined.select("parent_id", "pose_id"), rows)


def intersect_pools(
    one: DataFrame, two: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """INTERSECT DISTINCT of two pools, and the map from each of them.

    A pool with itself is its distinct poses, with the same map twice.
    """
    if one is two:
        output, rows = deduplicate(one)
        return output, rows, rows
    # Each side is deduplicated map-side before it is shuffled.
    shared = one.select(*POSE).intersect(two.select(*POSE))
    output = organize(shared, [], spill=True, label="identity")
    return output, _map(one, output), _map(two, output)


def deduplicate(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct poses of one pool, and one map row per input row."""
    output = organize(pool.select(*POSE).distinct(), [], spill=True, label="distinct")
    return output, _map(pool, output)


def manifest(one: DataFrame, two: DataFrame, output: DataFrame) -> DataFrame:
    """Totals of a two-pool identity.

    ``kept_poses_*`` counts the poses in buckets that both pools occupy.
    """
    buckets = one.select(*BUCKET).intersect(two.select(*BUCKET))

    def total(name: str, pool: DataFrame) -> DataFrame:
        return pool.agg(F.count("*").alias("poses")).select(F.lit(name).alias("measure"), "poses")

    rows = total("identity_poses", output)
    for side, pool in (("one", one), ("two", two)):
        kept = pool.join(buckets, BUCKET, "left_semi")
        rows = rows.unionByName(total(f"input_poses_{side}", pool))
        rows = rows.unionByName(total(f"kept_poses_{side}", kept))
    return rows


def occurrences(pool: DataFrame) -> DataFrame:
    """Multiplicity and first id of every distinct pose."""
    return pool.groupBy(*POSE).agg(
        F.count("*").alias("poses"), F.min("pose_id").alias("first_id")
    )
