"""Pools: canonical order, dense ids, buckets, scans and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.constants import (
    BUCKET,
    BUCKET_SIZE,
    MAX_GRID,
    MAX_INDEX,
    MIN_GRID,
    OFFSET,
    POSE,
)
from strandloom.operators.digest import ordered_digest
from strandloom.staging import dense_ids, present, row_bound, skew_join, stage


def checked(column: Column, low: int, high: int, name: str) -> Column:
    """The value, or an error when it does not fit its stored field."""
    return F.when(column.between(low, high), column.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"{name} out of range: "), column.cast("string")))
    )


def pose_columns(conformer, rotamer, gx, gy, gz) -> list[Column]:
    """Range-checked pose fields under their standard names."""
    return [
        checked(conformer, 0, MAX_INDEX, "conformer").alias("conformer"),
        checked(rotamer, 0, MAX_INDEX, "rotamer").alias("rotamer"),
        *[
            checked(g, MIN_GRID, MAX_GRID, name).alias(name)
            for g, name in ((gx, "gx"), (gy, "gy"), (gz, "gz"))
        ],
    ]


def split_grid(grid: Column, bucket_size: int = BUCKET_SIZE) -> tuple[Column, Column]:
    """Bucket and offset of a grid coordinate; grid = bucket * size + offset."""
    bucket = F.floor((grid + F.lit(bucket_size // 2)) / F.lit(float(bucket_size))).cast("int")
    return bucket, (grid - bucket * bucket_size).cast("int")


def join_grid(bucket: Column, offset: Column, bucket_size: int = BUCKET_SIZE) -> Column:
    return (offset + bucket * bucket_size).cast("int")


def with_buckets(pool: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    columns = {}
    for grid, bucket, offset in zip(("gx", "gy", "gz"), BUCKET, OFFSET):
        columns[bucket], columns[offset] = split_grid(F.col(grid), bucket_size)
    return pool.withColumns(columns)


def bucket_order(bucket_size: int = BUCKET_SIZE) -> Column:
    """One number that sorts like the buckets, then the offsets, of grids of 16 bits."""
    parts = [split_grid(F.col(g), bucket_size) for g in ("gx", "gy", "gz")]
    buckets = (MAX_GRID - MIN_GRID) // bucket_size + 3
    place = F.lit(0).cast("bigint")
    for bucket, _ in parts:
        place = place * buckets + (bucket - MIN_GRID // bucket_size + 1)
    for _, offset in parts:
        place = place * bucket_size + (offset + bucket_size // 2)
    return place


def organize(
    poses: DataFrame,
    tie: list[str],
    *,
    bucket_size: int = BUCKET_SIZE,
    spill: bool = False,
    label: str = "pool",
    columns: list[str] | None = None,
) -> DataFrame:
    """Canonical pool: rows in (bucket, offset, conformer, rotamer, tie) order.

    ``tie`` must make the order total for rows that differ; it also lets a pose
    that fills a large share of the pool be split over tasks.  ``spill`` writes
    the unordered rows first, so that costly producers run once, not a second
    time for the range sample.  Only ``columns`` and the id are kept, if given; without
    buckets and offsets among them, one number that sorts alike takes their place.
    """
    if spill:
        poses = stage(poses, f"{label}-unordered")
    if columns is not None and not set(columns) & {*BUCKET, *OFFSET}:
        placed = poses.withColumn("_place", bucket_order(bucket_size))
        return dense_ids(placed, ["_place", "conformer", "rotamer"] + tie, "pose_id", label, columns)
    order = BUCKET + OFFSET + ["conformer", "rotamer"] + tie
    return dense_ids(with_buckets(poses, bucket_size), order, "pose_id", label, columns)


def bucket_counts(pool: DataFrame) -> DataFrame:
    """Poses per bucket and offset."""
    return pool.groupBy(*BUCKET, *OFFSET).agg(F.count("*").alias("poses"))


def bucket_starts(pool: DataFrame) -> DataFrame:
    """Per bucket: poses, distinct offsets and the first pose id.

    Pose ids follow bucket order, so the exclusive running total of the counts is
    simply the least id in the bucket.
    """
    return pool.groupBy(*BUCKET).agg(
        F.count("*").alias("poses"),
        F.count_distinct(*[F.col(c) for c in OFFSET]).alias("offsets"),
        F.min("pose_id").alias("first_id"),
    )


def pose_range(pool: DataFrame, first: int, last: int) -> DataFrame:
    """Rows FIRST..LAST, 1-based and inclusive."""
    if first < 1:
        raise ValueError("pose range must start at 1 or later")
    if last < first:
        raise ValueError("pose range LAST must not be below FIRST")
    return pool.where(F.col("pose_id").between(first - 1, last - 1))


def chunk_range(total: int, part: int, parts: int) -> tuple[int, int]:
    """1-based inclusive rows of chunk ``part`` of ``parts``."""
    if not 1 <= part <= parts:
        raise ValueError(f"chunk {part} is not in 1..{parts}")
    return total * (part - 1) // parts + 1, total * part // parts


def select_poses(
    pool: DataFrame,
    requests: DataFrame,
    *,
    base: int = 0,
) -> DataFrame:
    """Poses of an organized pool asked for in ``requests(request_pos, pose_id)``.

    Repeated requests are kept.

    The result carries ``request_pos``: the order array of the selection.
    """
    if base not in (0, 1):
        raise ValueError("base must be 0 or 1")
    total = pool.count()  # from the footers of a written pool
    wanted = requests.withColumn("pose_id", F.col("pose_id") - F.lit(base))
    wanted = wanted.withColumn(
        "pose_id",
        F.when(F.col("pose_id").between(0, total - 1), F.col("pose_id")).otherwise(
            F.raise_error(F.concat(F.lit("pose id out of range: "), F.col("pose_id").cast("string")))
        ),
    )
    return skew_join(wanted, pool, ["pose_id"], right_rows=total)


def scatter(values: DataFrame, order_array: DataFrame, value: str) -> DataFrame:
    """Re-key a measure of a selection to request positions, for any order array.

    A request without a value is an error.
    """
    known = values.select("pose_id", value, F.lit(True).alias("_there"))
    found = skew_join(order_array, known, ["pose_id"], "left_outer", right_rows=0)
    checked = present(F.col("_there"), "a request has no value")
    return found.select(F.when(checked, F.col("request_pos")).alias("request_pos"), value)


def fingerprint(pool: DataFrame) -> DataFrame:
    """Identity of a pool: number of poses, and digest of their records in order."""
    found = ordered_digest(pool, POSE)
    return found.select(F.col("rows").alias("poses"), "digest")


def same_pool(left: DataFrame, right: DataFrame) -> bool:
    return fingerprint(left).first() == fingerprint(right).first()


def score_concat(chunks: list[DataFrame], poses: int) -> DataFrame:
    """UNION ALL of score chunks that must cover ids 0..poses-1 exactly once."""
    types = {chunk.schema["score"].dataType.simpleString() for chunk in chunks}
    if len(types) != 1:
        raise ValueError(f"score chunks differ in type: {sorted(types)}")
    whole = chunks[0]
    for chunk in chunks[1:]:
        whole = whole.unionByName(chunk)
    seen = whole.agg(
        F.count("*").alias("n"),
        F.count_distinct("pose_id").alias("d"),
        F.min("pose_id").alias("lo"),
        F.max("pose_id").alias("hi"),
    ).first()
    if seen.n != poses or seen.d != poses or (poses and (seen.lo, seen.hi) != (0, poses - 1)):
        raise ValueError(f"score chunks cover {seen.d} of {poses} poses in {seen.n} rows")
    return whole


def score_add(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of two scores of the same pool; both must cover the same ids."""
    total = left.withColumnRenamed("score", "_l").join(
        right.withColumnRenamed("score", "_r"), "pose_id", "full_outer"
    )
    return total.select(
        "pose_id",
        F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("scores differ in length")))
        .otherwise(F.col("_l") + F.col("_r"))
        .alias("score"),
    )


def conformer_runs(pool: DataFrame) -> DataFrame:
    """Distinct conformers with their row counts."""
    return pool.groupBy("conformer").agg(F.count("*").alias("poses"))


def run_starts(counts: DataFrame, key: str = "conformer") -> DataFrame:
    """Exclusive running total over at most 65,536 conformers."""
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("poses").over(order), F.lit(0)))
