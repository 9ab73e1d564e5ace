"""Best fits of a reference structure by library poses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.constants import GRID_SPACING
from strandloom.functions import vectors as v
from strandloom.functions.decimals import above_cent_column
from strandloom.functions.nucleotides import overlaps
from strandloom.functions.superpose import with_superposed_rmsd
from strandloom.operators.library import place_atom
from strandloom.staging import bounded_broadcast, present, row_bound, skew_join

# Conformers of about 1 kB each: at most 50 MB are broadcast.
MAX_SENT_CONFORMERS = 50_000
HOT_FITS = 200_000  # fragments or library rows of one key that are split over tasks


def best_conformers(fragments: DataFrame, conformers: DataFrame) -> DataFrame:
    """Per fragment the conformer that superposes best; the lowest number wins ties.

    ``fragments(fragment, sequence, coords)``, ``conformers(sequence, conformer,
    coords)``.  Every fragment meets the whole library of its sequence; a library that
    is small enough is sent to the fragments, a larger one meets them in blocks of both.
    """
    library = conformers.select("sequence", "conformer", F.col("coords").alias("_c"))
    sent = bounded_broadcast(library, MAX_SENT_CONFORMERS)
    wanted = fragments.select("fragment", "sequence", F.col("coords").alias("_r"))
    if sent is library:
        pairs = skew_join(wanted, library, ["sequence"], hot_rows=HOT_FITS)
    else:
        pairs = wanted.join(sent, "sequence")
    scored = with_superposed_rmsd(pairs, "_c", "_r", "crmsd")
    best = F.min(F.struct("crmsd", "conformer")).alias("b")
    return scored.groupBy("fragment", "sequence").agg(best).select("fragment", "sequence", "b.*")


def best_poses(fragments: DataFrame, conformers: DataFrame, rotamers: DataFrame) -> DataFrame:
    """Per fragment with a chosen ``conformer`` the best rotamer and grid point.

    The grid point is the rounded difference of the centroids; the RMSD follows from
    moments of conformer and reference, so no coordinates meet the rotamers.
    """
    rows = row_bound(fragments)
    shaped = skew_join(
        fragments.select("fragment", "conformer", F.col("coords").alias("_r")),
        conformers.select("conformer", "coords"),
        ["conformer"],
        "left_outer",
        left_rows=rows,
        right_rows=0,
    ).withColumn("coords", present(F.col("coords"), "a fragment names a missing conformer"))
    shaped = shaped.withColumn("r_mean", v.centroid(F.col("_r"))).withColumn(
        "c_mean", v.centroid(F.col("coords"))
    )
    shaped = shaped.withColumn("_rc", v.centred(F.col("_r"), F.col("r_mean"))).withColumn(
        "_cc", v.centred(F.col("coords"), F.col("c_mean"))
    )
    moments = shaped.select(
        "fragment",
        "conformer",
        "r_mean",
        "c_mean",
        F.size("_r").alias("atoms"),
        (v.square_sum(F.col("_rc")) + v.square_sum(F.col("_cc"))).alias("scatter"),
        v.cross_moment(F.col("_cc"), F.col("_rc")).alias("cross"),
    )
    turned = v.rotate(F.col("c_mean"), F.col("m"))
    gap = [v.component(F.col("r_mean"), k) - turned[k] for k in range(3)]
    rotation = F.greatest(
        F.col("scatter") - v.dot(F.col("cross"), F.col("m"), 9) * 2.0, F.lit(0.0)
    )
    turned_fits = skew_join(
        moments, rotamers, ["conformer"], left_rows=rows, right_rows=row_bound(rotamers), hot_rows=HOT_FITS
    )
    rows = turned_fits.select(
        "fragment",
        "conformer",
        "rotamer",
        (rotation / F.col("atoms")).alias("rotated"),
        *[g.alias(f"d{k}") for k, g in enumerate(gap)],
    )
    rows = rows.withColumns(
        {g: F.rint(F.col(f"d{k}") / GRID_SPACING).cast("int") for k, g in enumerate(("gx", "gy", "gz"))}
    )
    left = [F.col(g) * GRID_SPACING - F.col(f"d{k}") for k, g in enumerate(("gx", "gy", "gz"))]
    rows = rows.withColumn("rmsd", F.sqrt(F.col("rotated") + v.dot(left, left)))
    best = F.min(F.struct("rmsd", "rotamer", "gx", "gy", "gz")).alias("b")
    return rows.groupBy("fragment", "conformer").agg(best).select("fragment", "conformer", "b.*")


def base_rmsds(fits: DataFrame) -> DataFrame:
    """Overlap RMSDs of both nucleotides of each fit with the reference.

    ``fits(fragment, sequence, split, ref, coords, m, gx, gy, gz)``: the first ``split``
    atoms are the first nucleotide.
    """
    grid = [F.col(g) for g in ("gx", "gy", "gz")]
    placed = fits.withColumn(
        "_world", F.transform("coords", lambda a: F.array(*place_atom(a, F.col("m"), grid)))
    )
    squares = F.zip_with(
        "_world",
        "ref",
        lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d),
    )
    placed = placed.withColumn("_d", squares)

    def part(values):
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))

    rest = F.size("_d") - F.col("split")
    return placed.select(
        "fragment",
        "sequence",
        part(F.slice("_d", F.lit(1), F.col("split"))).alias("nucleotide1_ovrmsd"),
        part(F.slice("_d", F.col("split") + 1, rest)).alias("nucleotide2_ovrmsd"),
    )


def adjacent_pairs(fits: DataFrame) -> DataFrame:
    """Fits of neighbouring fragments side by side; their sequences must overlap."""
    columns = [c for c in fits.columns if c != "fragment"]
    low = fits.select(
        F.col("fragment").alias("down"), *[F.col(c).alias(f"down_{c}") for c in columns]
    )
    high = fits.select(
        F.col("fragment").alias("up"),
        (F.col("fragment") - 1).alias("down"),
        *[F.col(c).alias(f"up_{c}") for c in columns],
    )
    sequence = F.concat("down_sequence", F.expr("substring(up_sequence, 2)"))
    return low.join(high, "down").withColumn(
        "sequence",
        F.when(overlaps(F.col("down_sequence"), F.col("up_sequence")), sequence).otherwise(
            F.raise_error(F.concat(F.lit("fragments do not overlap at "), F.col("up").cast("string")))
        ),
    )


def pair_rmsds(pairs: DataFrame) -> DataFrame:
    """Overlap and conformer RMSD of the nucleotide that neighbours share.

    ``pairs`` carries for both sides the nucleotide's library coordinates
    (``*_coords``), rotation (``*_m``) and grid point.
    """

    def world(side):
        grid = [F.col(f"{side}_{g}") for g in ("gx", "gy", "gz")]
        return F.transform(
            f"{side}_coords", lambda a: F.array(*place_atom(a, F.col(f"{side}_m"), grid))
        )

    gaps = F.zip_with(
        world("down"),
        world("up"),
        lambda x, y: sum(
            ((F.get(x, F.lit(k)) - F.get(y, F.lit(k))) * (F.get(x, F.lit(k)) - F.get(y, F.lit(k))) for k in (1, 2)),
            (F.get(x, F.lit(0)) - F.get(y, F.lit(0))) * (F.get(x, F.lit(0)) - F.get(y, F.lit(0))),
        ),
    )
    overlap = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size("down_coords"))
    scored = pairs.select("down", "up", "sequence", overlap.alias("ovrmsd"), "down_coords", "up_coords")
    return with_superposed_rmsd(scored, "down_coords", "up_coords", "crmsd").drop("down_coords", "up_coords")


def thresholds(pairs: DataFrame) -> DataFrame:
    """Two-decimal thresholds strictly above the best-fit RMSDs of each pair."""
    return pairs.select(
        "down",
        "up",
        "sequence",
        above_cent_column(F.col("ovrmsd")).alias("ovrmsd"),
        above_cent_column(F.col("crmsd")).alias("crmsd"),
    )
