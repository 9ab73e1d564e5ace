"""Reference structures: template order, contiguous fragments, backbone continuity.

``atoms(structure, chain, resid, resname, name, index, x, y, z)`` may hold many
structures; each is handled within its own key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.constants import MAX_BACKBONE_BOND
from strandloom.functions.nucleotides import base_of
from strandloom.operators.library import MAX_SENT_ATOMS
from strandloom.staging import bounded_broadcast, require_empty


def require_single_chain(atoms: DataFrame) -> None:
    chains = atoms.groupBy("structure").agg(F.count_distinct("chain").alias("chains"))
    require_empty(chains.where("chains > 1"), "structure has several chains")


def _refused(column, when, message):
    """The column, or an error for rows of which ``when`` holds; part of the same pass."""
    return F.when(when, F.raise_error(F.lit(message))).otherwise(column)


def nucleotides(atoms: DataFrame, template: DataFrame, *, ignore_missing: bool = False,
                ignore_unknown: bool = False) -> DataFrame:
    """``(structure, resid, base, position, xyz, bond3, bond5)`` of complete nucleotides.

    ``template(base, name, place)`` lists the atoms of each base in library order.
    ``position`` numbers complete nucleotides from 1; residue ids have 16 bits, so a
    structure has at most 65,536 of them.
    """
    name = F.regexp_replace(F.trim("name"), r"\*", "'")
    based = atoms.withColumn("base", base_of(F.col("resname"))).withColumn("name", name)
    if not ignore_unknown:
        based = based.withColumn("base", _refused(F.col("base"), F.col("base").isNull(), "unknown base"))
    template = bounded_broadcast(template, MAX_SENT_ATOMS)
    sizes = template.groupBy("base").agg(F.count("*").alias("atoms"))
    # A structure is small, so one exchange by structure serves the grouping, the numbering
    # and what follows by fragment.
    found = (
        based.select("structure", "resid", "base", "name", "x", "y", "z")
        .join(template, ["base", "name"])
        .repartition("structure")
        .groupBy("structure", "resid", "base")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "x", "y", "z"))).alias("_a"),
            F.size(F.collect_set("place")).alias("_distinct"),
            F.max(F.when(F.col("name") == "O3'", F.struct("x", "y", "z"))).alias("bond3"),
            F.max(F.when(F.col("name") == "P", F.struct("x", "y", "z"))).alias("bond5"),
        )
        .join(sizes, "base")
    )
    twice = F.size("_a") > F.col("_distinct")
    whole = _refused(F.col("_distinct") == F.col("atoms"), twice, "duplicate atom")
    if not ignore_missing:
        whole = _refused(F.lit(True), ~whole, "nucleotide lacks atoms")
    order = Window.partitionBy("structure").orderBy("resid")
    return found.where(whole).select(
        "structure",
        "resid",
        "base",
        F.row_number().over(order).alias("position"),
        F.transform("_a", lambda a: F.array(*[a[c].cast("double") for c in "xyz"])).alias("xyz"),
        "bond3",
        "bond5",
    )


def continuous(left, right):
    """O3' of one residue lies within a bond of P of the next."""
    gap = [left[c] - right[c] for c in "xyz"]
    return F.coalesce(
        F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) <= MAX_BACKBONE_BOND,
        F.lit(False),
    )


def dinucleotides(nucs: DataFrame) -> DataFrame:
    """Fragments of two neighbours with consecutive residues and an unbroken backbone.

    Each nucleotide looks at the next one of its structure, so none is made twice.
    """
    order = Window.partitionBy("structure").orderBy("position")
    after = F.lead(F.struct("position", "resid", "base", "xyz", "bond5")).over(order)
    return (
        nucs.where("structure is not null")
        .withColumn("_next", after)
        .where(
            (F.col("_next.position") == F.col("position") + 1)
            & (F.col("_next.resid") == F.col("resid") + 1)
            & continuous(F.col("bond3"), F.col("_next.bond5"))
        )
        .select(
            "structure",
            F.col("position").alias("fragment"),
            "resid",
            F.concat("base", "_next.base").alias("sequence"),
            F.concat("xyz", "_next.xyz").alias("coords"),
        )
    )


def sequences(nucs: DataFrame) -> DataFrame:
    """Base sequence of each structure, in residue order."""
    ordered = F.sort_array(F.collect_list(F.struct("resid", "base")))
    return nucs.groupBy("structure").agg(
        F.array_join(F.transform(ordered, lambda n: n["base"]), "").alias("sequence")
    )
