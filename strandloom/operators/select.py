"""Predicates, masks and filters over pools.

Acceptance is strict: a pose passes when its value is *below* the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.constants import POSE
from strandloom.operators.pool import fingerprint, organize
from strandloom.staging import dense_ids, present, task_count

COPY_BLOCK = 100_000  # copies of one id that one task writes


def require_aligned(pool_rows: int, measure_rows: int) -> None:
    if pool_rows != measure_rows:
        raise ValueError(f"{measure_rows} values for {pool_rows} poses")


def mask(scores: DataFrame, threshold: float) -> DataFrame:
    """Ids that pass; NaN never passes."""
    return scores.where((F.col("score") < threshold) & ~F.isnan("score")).select("pose_id")


def mask_encoding(rows: int, selected: int) -> str:
    """The smaller of the two stored forms: one byte per pose, or an id list."""
    width = 1 if rows <= 1 << 8 else 2 if rows <= 1 << 16 else 4 if rows <= 1 << 32 else 8
    return "index" if selected * width < rows else "boolean"


def filter_by_score(pool: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Passing poses, re-numbered, with the id they had as ``parent_id``."""
    require_aligned(pool.count(), scores.count())
    # Equal numbers and a score for every pose leave no score of another pool.
    scored = pool.join(scores.select("pose_id", "score", F.lit(True).alias("_scored")), "pose_id", "left")
    # Rows without a score pass the predicate, so that the join keeps them, and fail after it.
    passing = scored.where(F.col("_scored").isNull() | ((F.col("score") < threshold) & ~F.isnan("score")))
    return renumber(passing.withColumn("gx", F.when(present(F.col("_scored"), "a pose has no score"), F.col("gx"))))


def filter_by_mask(pool: DataFrame, selector: DataFrame) -> DataFrame:
    """Poses whose id is in the selector, each once."""
    return renumber(pool.join(selector, "pose_id", "left_semi"))


def filter_by_index(pool: DataFrame, index: DataFrame) -> DataFrame:
    """Poses named by an id list; an id listed twice gives two rows.

    Listed ids are counted before they meet the pool, so a hot id is one row there.
    Its copies are written out in blocks that are dealt to different tasks.
    """
    counts = index.groupBy("pose_id").agg(F.count("*").alias("_n"))
    found = counts.join(pool.select("pose_id", *POSE, F.lit(True).alias("_there")), "pose_id", "left")
    last = F.floor((F.col("_n") - 1) / F.lit(COPY_BLOCK)).cast("bigint")
    there = present(F.col("_there"), "a listed pose is not in the pool")
    blocks = found.withColumn("gx", F.when(there, F.col("gx"))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    dealt = blocks.repartition(task_count(pool.sparkSession), "pose_id", "_block")
    first = F.col("_block") * COPY_BLOCK
    copies = dealt.withColumn(
        "_copy", F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("_n")) - 1))
    )
    kept = copies.select(F.col("pose_id").alias("parent_id"), *POSE, "_copy")
    return organize(kept, ["parent_id", "_copy"], label="filtered").drop("_copy")


def renumber(selected: DataFrame) -> DataFrame:
    """New canonical pool of already organized rows, keeping the old id.

    The old ids already follow the canonical order, so they break every tie.
    """
    kept = selected.select(F.col("pose_id").alias("parent_id"), *POSE)
    return organize(kept, ["parent_id"], label="filtered")


def select_by_rmsd(rmsds: DataFrame, threshold: float, *, preserve_order: bool = False) -> DataFrame:
    """Requests for the poses below ``threshold``, best first unless order is kept.

    Returns ``(request_pos, pose_id, rmsd)``; equal RMSDs keep pool order.
    """
    order = ["pose_id"] if preserve_order else ["rmsd", "pose_id"]
    return dense_ids(
        rmsds.where((F.col("rmsd") < threshold) & ~F.isnan("rmsd")), order, "request_pos", "by-rmsd"
    )


def common_conformer_masks(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of each pool whose conformer occurs in both pools.

    Conformers are 16-bit, so the shared set has at most 65,536 rows.
    """
    shared = F.broadcast(
        one.select("conformer").intersect(two.select("conformer"))
    )
    return (
        one.join(shared, "conformer", "left_semi").select("pose_id"),
        two.join(shared, "conformer", "left_semi").select("pose_id"),
    )


def apply_mask(pool: DataFrame, selector: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Apply one side of a mask pair, checking the pool it was made for."""
    if expected is not None and fingerprint(pool).first() != expected.first():
        raise ValueError("the mask was made for another pool")
    return filter_by_mask(pool, selector)


def all_ranges_below(energies: list[DataFrame], threshold: float) -> DataFrame:
    """Ids below the threshold in *every* energy; energies are never summed."""
    kept = mask(energies[0], threshold)
    for energy in energies[1:]:
        kept = kept.join(mask(energy, threshold), "pose_id", "left_semi")
    return kept


def conformer_range(
    conformers: DataFrame,
    *,
    first_last: Sequence[int] | None = None,
    conformer: int | None = None,
    size: int,
) -> DataFrame:
    """Library conformers picked by 1-based number or inclusive range."""
    if conformer is not None:
        if not 1 <= conformer <= size:
            raise ValueError(f"conformer {conformer} is not in 1..{size}")
        chosen = conformers.where(F.col("conformer") == conformer - 1)
    elif first_last is None:
        chosen = conformers
    else:
        first, last = first_last
        if not 1 <= first <= last <= size:
            raise ValueError(f"conformer range {first}..{last} is not in 1..{size}")
        chosen = conformers.where(F.col("conformer").between(first - 1, last - 1))
    if chosen.isEmpty():
        raise ValueError("no conformer is available after exclusions")
    return chosen


def rotamer_range(rotamers: DataFrame, first: int, last: int) -> DataFrame:
    """Rotamers FIRST..LAST (1-based) of every conformer; LAST must fit them all."""
    if not 1 <= first <= last:
        raise ValueError("rotamer range must satisfy 1 <= FIRST <= LAST")
    shortest = (
        rotamers.groupBy("conformer").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    )
    if shortest is None or last > shortest:
        raise ValueError(f"rotamer range LAST={last} exceeds the shortest list ({shortest})")
    return rotamers.where(F.col("rotamer").between(first - 1, last - 1))


def sample_library(ids: DataFrame, column: str, count: int, seed: int) -> DataFrame:
    """Seeded draw of ``count`` library indices without replacement.

    Library indices are 16-bit, so the whole draw is at most 65,536 numbers.
    """
    values = np.sort([row[0] for row in ids.select(column).distinct().collect()])
    if count > len(values):
        raise ValueError(f"cannot draw {count} of {len(values)}")
    drawn = np.sort(np.random.default_rng(seed).choice(values, count, replace=False))
    return ids.where(F.col(column).isin([int(v) for v in drawn]))
