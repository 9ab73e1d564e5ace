"""Composition of per-row lineage between pools.

A *relation* has one row ``(pose_id, parent_id)`` per derivation.  Growing and
filtering give functions (one parent per pose); identity gives many-to-many maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.staging import HOT_ROWS, has_hot_keys, present, require_empty, row_bound, skew_join, stage, with_bound


def relation(pool: DataFrame) -> DataFrame:
    return with_bound(pool.select("pose_id", "parent_id"), getattr(pool, "_row_bound", None))


def compose(child: DataFrame, parent: DataFrame, *, strict: bool = False) -> DataFrame:
    """Lineage of ``child`` through ``parent``: child.parent_id = parent.pose_id.

    ``strict`` makes a parent id that ``parent`` lacks an error, seen by the join
    itself unless ``parent`` holds hot keys.
    """
    rows, known = row_bound(child), row_bound(parent)
    # Written, so that looking for hot keys does not run what makes them.
    child, parent = (stage(relation(r), "lineage") if n >= HOT_ROWS else r for r, n in ((child, rows), (parent, known)))
    if known >= HOT_ROWS and not has_hot_keys(parent, ["pose_id"], known):
        known = 0
    inline = strict and known < HOT_ROWS
    if strict and not inline:
        require_parents(child, parent)
    composed = skew_join(
        child.select("pose_id", F.col("parent_id").alias("_via")),
        parent.select(F.col("pose_id").alias("_via"), "parent_id"),
        ["_via"],
        "left_outer" if inline else "inner",
        left_rows=rows,
        right_rows=known,
    ).select("pose_id", "parent_id")
    if inline:
        composed = composed.withColumn(
            "parent_id", present(F.col("parent_id"), "lineage refers to a missing parent")
        )
    return composed


def prune(rel: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a big relation whose parent is in a small key set."""
    rows = row_bound(rel)
    if rows >= HOT_ROWS:  # written, so that looking for hot keys does not run what makes them
        rel = stage(rel, "lineage")
    return skew_join(rel, keys.select(F.col("pose_id").alias("parent_id")), ["parent_id"], "left_semi", left_rows=rows)


def require_parents(child: DataFrame, parent: DataFrame) -> None:
    """Every parent id of ``child`` must exist in ``parent``."""
    missing = (
        child.select("parent_id")
        .distinct()
        .join(parent.select(F.col("pose_id").alias("parent_id")), "parent_id", "left_anti")
    )
    require_empty(missing, "lineage refers to a missing parent")


def compose_route(route: list[DataFrame], *, strict: bool = False) -> DataFrame:
    """Fold a route of relations, youngest first, into one relation."""
    result = relation(route[0])
    for number, step in enumerate(route[1:], start=1):
        result = compose(result, step, strict=strict)
        if number < len(route) - 1:
            # Written, so that a long route is neither planned nor counted twice.
            result = stage(result, "route")
    return result


def propagate(route: list[DataFrame], *, functional: bool) -> DataFrame:
    """Materialized lineage to an ancestor pool; a map is reduced to distinct rows."""
    composed = compose_route(route, strict=True)
    if not functional:
        composed = composed.distinct()
    return stage(
        composed.select(F.col("parent_id").alias("grow_source"), F.col("pose_id").alias("pose")),
        "propagated",
    )


def link_edges(low_route: list[DataFrame], high_route: list[DataFrame]) -> DataFrame:
    """Edges between two representatives that share an ancestor pool.

    Either route may be empty when that representative *is* the shared pool.
    Edges keep their multiplicity.
    """
    sides = []
    for route, name in ((low_route, "low"), (high_route, "high")):
        if route:
            rel = compose_route(route, strict=True)
            sides.append(rel.select(F.col("parent_id").alias("_join"), F.col("pose_id").alias(name)))
        else:
            sides.append(None)
    low, high = sides
    if low is None and high is None:
        raise ValueError("two representatives cannot be the same pool")
    if low is None:
        return high.select(F.col("_join").alias("low"), "high")
    if high is None:
        return low.select("low", F.col("_join").alias("high"))
    return skew_join(low, high, ["_join"]).select("low", "high")
