"""Fragment library files: conformer coordinates, rotamer lists, cRMSD matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.nucleotides import mutate, representative
from strandloom.operators.library import exclude_origins
from strandloom.sources.arrays import read_arrays
from strandloom.staging import row_bound, stage


def read_conformers(spark: SparkSession, path: str) -> DataFrame:
    """``(conformer, coords)`` of an array of conformers by atoms by three."""
    rows = read_arrays(spark, path, "flat")
    atoms = F.transform(
        F.sequence(F.lit(0), (F.size("flat") / 3).cast("int") - 1),
        lambda n: F.transform(F.slice(F.col("flat"), n * 3 + 1, F.lit(3)), lambda x: x.cast("double")),
    )
    whole = F.when(F.size("flat") % 3 == 0, atoms).otherwise(F.raise_error(F.lit("coordinates are not triples")))
    return rows.select(F.col("row").cast("int").alias("conformer"), whole.alias("coords"))


def read_rotamers(spark: SparkSession, vectors: str, ends: str) -> DataFrame:
    """``(conformer, rotamer, rx, ry, rz)`` of rotation vectors and the end index of each
    conformer's list; every vector has to belong to one list."""
    found = stage(read_arrays(spark, vectors, "v"), "rotamers")
    last = stage(read_arrays(spark, ends, "stop"), "rotamer-ends")
    before = last.select((F.col("row") + 1).alias("row"), F.col("stop").alias("first"))
    lists = last.join(before, "row", "left").select(
        F.col("row").cast("int").alias("conformer"),
        F.coalesce("first", F.lit(0)).cast("bigint").alias("first"),
        F.col("stop").cast("bigint").alias("stop"),
    )
    ordered = F.when(F.col("stop") >= F.col("first"), F.col("stop")).otherwise(
        F.raise_error(F.lit("end indices go down"))
    )
    lists = lists.withColumn("stop", ordered).where("stop > first")
    places = lists.select(
        "conformer", "first", F.explode(F.sequence("first", F.col("stop") - 1)).alias("row")
    )
    joined = found.join(places, "row", "full_outer")
    whole = F.when(F.col("v").isNull() | F.col("conformer").isNull(), F.raise_error(F.lit("vectors and end indices differ")))
    return joined.select(
        whole.otherwise(F.col("conformer")).alias("conformer"),
        (F.col("row") - F.col("first")).cast("int").alias("rotamer"),
        *[F.get("v", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("rx", "ry", "rz"))],
    )


def load_library(
    spark: SparkSession,
    sequence: str,
    conformers: str,
    rotamers: tuple[str, str],
    *,
    replacements: str | None = None,
    extensions: str | None = None,
    extension_rotamers: tuple[str, str] | None = None,
    origins: DataFrame | None = None,
    exclude: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Conformers ``(conformer, coords, replaced)`` and rotamers of a sequence, from files.

    Sequences share the files of their representative, whose letters stand for ``{}`` in
    the paths; coordinates are then mutated and centred again.  Extensions go on with the
    numbers of the conformers.  ``origins(conformer, origin)`` names the structure each
    conformer comes from: those of ``exclude`` take their replacement, or are dropped with
    their rotamers if they are extensions.
    """
    base = representative(sequence)
    shapes = stage(read_conformers(spark, conformers.format(base)), "conformers")
    turns = [read_rotamers(spark, *[p.format(base) for p in rotamers])]
    size = row_bound(shapes)
    shapes = shapes.withColumn("extension", F.lit(False))
    if extensions:
        more = read_conformers(spark, extensions.format(base)).withColumn("conformer", F.col("conformer") + size)
        shapes = shapes.unionByName(more.withColumn("extension", F.lit(True)))
        if extension_rotamers:
            added = read_rotamers(spark, *[p.format(base) for p in extension_rotamers])
            turns.append(added.withColumn("conformer", F.col("conformer") + size))
    none = F.lit(None).cast("array<array<double>>")
    if replacements:
        found = read_conformers(spark, replacements.format(base)).withColumnRenamed("coords", "replacement")
        shapes = shapes.join(found, "conformer", "left")
    else:
        shapes = shapes.withColumn("replacement", none)
    if origins is None and exclude:
        raise ValueError("to exclude structures, the origins of conformers are needed")
    shapes = shapes.join(origins, "conformer", "left") if origins is not None else shapes.withColumn("origin", F.lit(None).cast("string"))
    kept = exclude_origins(shapes, exclude)
    whole = F.when(F.col("coords").isNull(), F.raise_error(F.lit("an excluded conformer has no replacement"))).otherwise(F.col("coords"))
    kept = kept.select("conformer", mutate(whole, base, sequence).alias("coords"), "replaced")
    every = turns[0] if len(turns) == 1 else turns[0].unionByName(turns[1])
    return kept, every.join(kept.select("conformer"), "conformer", "left_semi")


def read_crmsds(spark: SparkSession, path: str) -> DataFrame:
    """``(lower, upper, crmsd)`` of a matrix, one row per pair."""
    rows = read_arrays(spark, path, "values")
    return rows.select(F.col("row").cast("int").alias("lower"), F.posexplode("values").alias("upper", "crmsd")).withColumn(
        "crmsd", F.col("crmsd").cast("double")
    )
