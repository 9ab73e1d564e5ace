"""Stored stacking filters: accept rows of every Hopf cell, with a manifest that is checked.

A cache is a folder with ``cells`` (Parquet, one row per accepting cell: its bitmaps and the
number of accepted translations) and ``manifest`` (one row: cutoff, counts, least margins and
a digest of the rows in order of their cells).  It is written only if no score or tilt lies so
near its limit that rounding could decide it, and read only if all of the manifest holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import gaussian
from strandloom.operators.digest import ordered_digest
from strandloom.staging import with_bound


class FilterCacheError(ValueError):
    """A stored filter that must not be used."""


def margins(spark: SparkSession, name: str) -> dict[str, float]:
    """Least distances of any score from the cutoff and of any tilt from its limit."""
    tilts = gaussian.cell_tilts(spark)
    scored = gaussian.audit(gaussian.scored_keys(tilts, name), name).first()
    every = tilts.agg(F.min(F.abs(F.col("r33") * F.col("r33") * 4.0 - 3.0)).alias("gap")).first()
    return {"min_rel_margin": scored.min_rel_margin, "min_tilt_gap": every.gap}


def _manifest(cells: DataFrame, name: str, audit: dict[str, float]) -> DataFrame:
    bounded = with_bound(cells, gaussian.HOPF_CELLS)
    digest = ordered_digest(bounded.withColumn("rows_as", F.to_json("accepted")), ["rows_as", "size"], "cell")
    counts = cells.agg(
        F.count("*").alias("cells"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("pairs"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
    )
    fixed = [F.lit(name).alias("name"), F.lit(repr(gaussian.cutoff(name))).alias("cutoff")]
    listed = [F.lit(float(audit[k])).alias(k) for k in sorted(audit)]
    # Two tables of one row each.
    return counts.join(F.broadcast(digest.select("digest"))).select(*fixed, "cells", "pairs", "largest", *listed, "digest")


def write(spark: SparkSession, name: str, path: str, least: float = gaussian.AUDIT_MARGIN) -> dict:
    """Build the filter over all cells and store it in ``path``; gives the manifest."""
    audit = margins(spark, name)
    if min(audit.values()) < least:
        raise FilterCacheError(f"{name} would depend on rounding: {audit}")
    rows = gaussian.accept_rows(gaussian.cell_tilts(spark), name)
    rows.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("errorifexists").parquet(f"{path}/cells")
    stored = spark.read.parquet(f"{path}/cells")
    manifest = _manifest(stored, name, audit)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest.first().asDict()


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Accept rows ``(cell, accepted, size)`` of a stored filter, after checking them all."""
    schema = "name string, cutoff string, cells long, pairs long, largest int, min_rel_margin double, min_tilt_gap double, digest string"
    found = spark.read.schema(schema).json(f"{path}/manifest").limit(2).collect()
    if len(found) != 1:
        raise FilterCacheError(f"{path} has no single manifest")
    said = found[0].asDict()
    audit = {k: said[k] for k in ("min_rel_margin", "min_tilt_gap")}
    if min(audit.values()) < gaussian.AUDIT_MARGIN:
        raise FilterCacheError(f"{path} was built too near its limits: {audit}")
    cells = spark.read.parquet(f"{path}/cells")
    is_so = _manifest(cells, name, audit).first().asDict()
    wrong = sorted(k for k in is_so if is_so[k] != said.get(k))
    if wrong:
        raise FilterCacheError(f"{path} does not hold its manifest: {', '.join(wrong)}")
    return with_bound(cells, said["cells"])


def sizes(cells: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(filter, cell, size)``: accepted translations of the distinct ``cells``, by filter."""
    out = None
    for name in names or gaussian.filter_names():
        part = gaussian.accept_rows(cells, name).select(F.lit(name).alias("filter"), "cell", "size")
        out = part if out is None else out.unionByName(part)
    return out
