"""Rebuild check: library poses against published coordinates, then all stacking filters.

A job names a library pose and a nucleotide.  The pose is built anew and compared with the
coordinates published for it; the ring of the published coordinates gives the descriptors.
A job that fails anywhere is kept with the reason, and the others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.constants import MAX_REBUILD_RMSD
from strandloom.functions import vectors as v
from strandloom.functions.superpose import plane_rotation
from strandloom.operators.anchor import check_filters, ring_descriptors
from strandloom.operators.library import place_atom
from strandloom.staging import row_bound, skew_join, stage


def prepared(
    jobs: DataFrame,
    published: DataFrame,
    conformers: DataFrame,
    rotamers: DataFrame,
    ring_atoms: list[list[int]],
    references: list[list[list[float]]],
    frame: list[float],
    centre: list[float],
) -> DataFrame:
    """``(job, d, phi, theta, score, error)`` of every job; descriptors are null with an error.

    ``jobs`` has ``job``, a pose and ``nucleotide`` (0 or 1); ``published`` has ``job`` and
    ``xyz``, an array of [x, y, z].  ``ring_atoms`` and ``references`` list, per nucleotide,
    the places of the ring's atoms and the reference ring.  ``frame`` and ``centre`` place
    the protein ring.
    """
    rows = row_bound(jobs)
    joined = skew_join(jobs, conformers.select("conformer", "coords"), ["conformer"], "left_outer", left_rows=rows, right_rows=0)
    joined = skew_join(
        joined, rotamers.select("conformer", "rotamer", "m"), ["conformer", "rotamer"], "left_outer", left_rows=rows, right_rows=0,
        counted=jobs,
    )
    joined = joined.join(published.select("job", "xyz"), "job", "left")
    grid = [F.col(g) for g in ("gx", "gy", "gz")]
    gap = F.zip_with(
        "coords",
        "xyz",
        lambda a, p: sum(
            ((c - F.get(p, F.lit(k))) * (c - F.get(p, F.lit(k))) for k, c in enumerate(place_atom(a, F.col("m"), grid))), F.lit(0.0)
        ),
    )
    rmsd = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size("coords"))
    joined = joined.withColumn(
        "rebuild_rmsd", F.when(F.col("m").isNotNull() & (F.size("coords") == F.size("xyz")), rmsd)
    )
    error = (
        F.when(~F.col("nucleotide").isin(0, 1) | F.col("nucleotide").isNull(), F.lit("nucleotide is neither first nor second"))
        .when(F.col("coords").isNull(), F.format_string("conformer %s is not in the library", "conformer"))
        .when(F.col("m").isNull(), F.format_string("rotamer %s of conformer %s is not in the library", "rotamer", "conformer"))
        .when(F.col("xyz").isNull(), F.lit("no published coordinates"))
        .when(
            F.size("coords") != F.size("xyz"),
            F.format_string("%d published atoms for a pose of %d", F.size("xyz"), F.size("coords")),
        )
        .when(F.col("rebuild_rmsd").isNull() | F.isnan("rebuild_rmsd"), F.lit("coordinates are not numbers"))
        .when(
            F.col("rebuild_rmsd") > MAX_REBUILD_RMSD,
            F.format_string(f"reconstructed pose RMSD %.6f exceeds {MAX_REBUILD_RMSD}", "rebuild_rmsd"),
        )
    )

    def of_nucleotide(values):
        return F.when(F.col("nucleotide") == 0, values[0]).otherwise(values[1])

    ring = of_nucleotide([F.array(*[F.get("xyz", F.lit(n)) for n in atoms]) for atoms in ring_atoms])
    reference = of_nucleotide([F.lit([float(x) for atom in r for x in atom]) for r in references])
    joined = joined.withColumn("error", error).withColumn("ring", F.when(F.col("error").isNull(), ring))
    turned = joined.withColumn("to_reference", plane_rotation(F.flatten("ring"), reference))
    degenerate = F.when(F.col("error").isNull() & F.col("to_reference").isNull(), F.lit("ring has no plane"))
    turned = turned.select("job", F.coalesce("error", degenerate).alias("error"), "to_reference", v.centroid(F.col("ring")).alias("ring_centre"))
    return ring_descriptors(turned, frame, centre).select(
        "job", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("d", "phi", "theta", "score")], "error"
    )


def check_rebuilt(*args, filters: list[str] | None = None) -> DataFrame:
    """``(job, filter, state, implied_by, error)``; arguments as for ``prepared``.

    A job with an error has one row, without a filter and with state ``error``.
    """
    ready = stage(prepared(*args), "rebuilt")
    none = F.lit(None).cast("string")
    good = check_filters(ready.where("error is null"), filters).withColumn("error", none)
    bad = ready.where("error is not null").select(
        "job", none.alias("filter"), F.lit("error").alias("state"), none.alias("implied_by"), "error"
    )
    return good.unionByName(bad)
