"""PDB text: atoms from records, records from atoms.

``atoms`` columns: model, hetero, name, altloc, resname, chain, index, icode, resid,
x, y, z, occupancy, bfactor, segid, element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.nucleotides import base_of
from strandloom.staging import bounded_broadcast

# Record columns (name, first column from 1, width, type).
_FIELDS = (
    ("hetero", 1, 6, "string"),
    ("index", 7, 5, "int"),
    ("name", 13, 4, "string"),
    ("altloc", 17, 1, "string"),
    ("resname", 18, 3, "string"),
    ("chain", 22, 1, "string"),
    ("resid", 23, 4, "int"),
    ("icode", 27, 1, "string"),
    ("x", 31, 8, "double"),
    ("y", 39, 8, "double"),
    ("z", 47, 8, "double"),
    ("occupancy", 55, 6, "double"),
    ("segid", 73, 4, "string"),
    ("element", 77, 2, "string"),
)
# Fixed value: one record, as a format.
_RECORD = "%s%5d %-4s%s%3s %s%4d%s   %8.3f%8.3f%8.3f%6.2f%6.2f      %4s%2s  "
# Fixed value: largest atom number of a record.
MAX_ATOMS = 99_999
# Atoms of the 5'-terminal phosphate.
_PHOSPHATE = ("P", "O1P", "O2P")
_FORMAT = "\nMODEL "  # models are read as records of their own


def parse_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Atoms of ATOM and HETATM records; other columns of ``lines`` are kept.

    A missing or negative occupancy is 0; the B factor is not read and is 0.
    """
    text = F.col(line)
    columns = {}
    for name, first, width, kind in _FIELDS:
        piece = F.trim(F.substring(text, first, width))
        columns[name] = piece if kind == "string" else F.when(piece != "", piece.cast(kind))
    atoms = lines.where(text.startswith("ATOM  ") | text.startswith("HETATM")).withColumns(columns)
    return atoms.withColumns(
        {
            "hetero": F.when(F.col("hetero") == "HETATM", "H").otherwise(""),
            "occupancy": F.greatest(F.coalesce("occupancy", F.lit(0.0)), F.lit(0.0)),
            "bfactor": F.lit(0.0),
        }
    ).drop(line)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of all files under ``path`` with ``file`` and ``model``.

    Each MODEL block is one record of the scan, so large ensembles are split; a file
    without MODEL records is model 1.
    """
    blocks = (
        spark.read.option("lineSep", _FORMAT)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    number = F.regexp_extract("value", r"^(?:MODEL)?\s*(\d+)\s*(?:\n|$)", 1)
    models = blocks.withColumn("model", F.when(number != "", number.cast("int")).otherwise(F.lit(1)))
    lines = models.select("file", "model", F.explode(F.split("value", "\r?\n")).alias("value"))
    return parse_records(lines)


def record(atom: str | None = None) -> Column:
    """One record line of the atom columns."""

    def c(name):
        return F.col(f"{atom}.{name}" if atom else name)

    def one(name):
        return F.rpad(F.substring(F.coalesce(c(name), F.lit("")), 1, 1), 1, " ")

    padded = F.when(c("name").startswith("H"), c("name")).otherwise(F.concat(F.lit(" "), c("name")))
    return F.format_string(
        _RECORD,
        F.when(F.trim(c("hetero")) == "", "ATOM  ").otherwise("HETATM"),
        c("index") % 100000,
        padded,
        one("altloc"),
        c("resname"),
        one("chain"),
        c("resid"),
        one("icode"),
        c("x"),
        c("y"),
        c("z"),
        F.least(F.greatest(c("occupancy"), F.lit(0.0)), F.lit(100.0)),
        F.least(c("bfactor"), F.lit(100.0)),
        c("segid"),
        c("element"),
    )


def model_lines(atoms: DataFrame, *, ter_at_end: bool = False) -> DataFrame:
    """``(model, place, part, value)`` lines of every model, in order.

    TER separates chains and jumps in residue numbers.  A model has at most 99,999
    atoms, which bounds the window over one model.
    """
    order = Window.partitionBy("model").orderBy("index")
    jump = (F.lag("chain").over(order) != F.col("chain")) | (
        ~(F.col("resid") - F.lag("resid").over(order)).isin(0, 1)
    )
    marked = atoms.withColumn("_jump", F.coalesce(jump, F.lit(False)))
    lines = marked.select(
        "model",
        F.col("index").cast("bigint").alias("place"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.when(F.col("_jump"), "TER").alias("value")),
                F.struct(F.lit(1).alias("part"), record().alias("value")),
            )
        ).alias("l"),
    ).select("model", "place", "l.*").where("value IS NOT NULL")
    models = atoms.groupBy("model").agg(F.max("index").cast("bigint").alias("last"))
    ends = [("MODEL", -1), ("TER", 1), ("ENDMDL", 2)]
    if not ter_at_end:
        ends.pop(1)
    head = F.format_string("MODEL %d", "model")
    frame = models.select(
        "model",
        F.explode(
            F.array(
                *[
                    F.struct(
                        (F.lit(-1).cast("bigint") if word == "MODEL" else F.col("last") + step).alias("place"),
                        F.lit(0).alias("part"),
                        (head if word == "MODEL" else F.lit(word)).alias("value"),
                    )
                    for word, step in ends
                ]
            )
        ).alias("l"),
    ).select("model", "l.*")
    return lines.unionByName(frame)


def write_models(atoms: DataFrame, path: str, *, ter_at_end: bool = False) -> None:
    """Multi-model text; part files in model order, whole models together."""
    lines = model_lines(atoms, ter_at_end=ter_at_end)
    (
        lines.repartitionByRange("model")
        .sortWithinPartitions("model", "place", "part")
        .select("value")
        .write.text(path)
    )


def pose_atoms(placed: DataFrame, template: DataFrame) -> DataFrame:
    """Atom rows of poses, ready for ``record`` and ``write_models``; a pose is a model.

    ``placed(pose_id, xyz)`` as ``library.pose_coordinates`` gives it; ``template(place,
    ...)`` has the other atom columns of each place.  Both need the same atoms.
    """
    rows = placed.select("pose_id", F.size("xyz").alias("_n"), F.posexplode("xyz").alias("place", "_c"))
    known = template.withColumn("_atoms", F.count("*").over(Window.partitionBy(F.lit(1))))  # one molecule
    joined = rows.join(bounded_broadcast(known, MAX_ATOMS), "place", "left")
    fits = F.col("_n") == F.coalesce("_atoms", F.lit(-1))
    model = F.when(fits, F.col("pose_id") + 1).otherwise(F.raise_error(F.lit("pose and template differ in atoms")))
    xyz = {c: F.get("_c", F.lit(k)) for k, c in enumerate("xyz")}
    return joined.withColumns({"model": model, **xyz}).drop("_n", "_c", "_atoms", "place")


def fragment_texts(fragments: DataFrame, template: DataFrame) -> DataFrame:
    """``(structure, fragment, sequence, name, text)``: a record file per reference fragment.

    ``fragments(structure, fragment, sequence, coords)`` as ``structure.dinucleotides`` gives
    them; ``template(sequence, place, ...)`` has the other atom columns of each dinucleotide.
    """
    rows = fragments.select(
        "structure", "fragment", "sequence", F.size("coords").alias("_n"), F.posexplode("coords").alias("place", "_c")
    )
    sizes = template.groupBy("sequence").agg(F.count("*").alias("_atoms"))
    # Sixteen dinucleotides of some forty atoms.
    known = bounded_broadcast(template.join(F.broadcast(sizes), "sequence"), MAX_ATOMS)
    joined = rows.join(known, ["sequence", "place"], "left")
    fits = F.col("_n") == F.coalesce("_atoms", F.lit(-1))
    x = F.when(fits, F.get("_c", F.lit(0))).otherwise(F.raise_error(F.lit("fragment and template differ in atoms")))
    atoms = joined.withColumns({"x": x, "y": F.get("_c", F.lit(1)), "z": F.get("_c", F.lit(2))})
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", record().alias("line")))), lambda r: r.line)
    whole = atoms.groupBy("structure", "fragment", "sequence").agg(F.array_join(lines, "\n").alias("text"))
    return whole.select(
        "structure",
        "fragment",
        "sequence",
        F.format_string("frag-%s-%s-refe.pdb", "fragment", "sequence").alias("name"),
        F.concat("text", F.lit("\n")).alias("text"),
    )


def complex_models(protein: DataFrame, rna: DataFrame) -> DataFrame:
    """Docking ensemble: the protein as chain A in every model, then RNA as chain B.

    HETATM records and the 5'-terminal phosphate are dropped, base names are one
    letter, and atoms are numbered anew within each model.
    """
    first = F.min("resid").over(Window.partitionBy("model"))
    strand = (
        rna.withColumn("_first", first)
        .where(~((F.col("resid") == F.col("_first")) & F.trim("name").isin(*_PHOSPHATE)))
        .drop("_first")
        .withColumn("resname", F.coalesce(base_of(F.col("resname")), F.raise_error(F.lit("not an RNA residue name"))))
    )
    models = rna.select("model").distinct()
    # One protein is repeated for each model; it is sent to the models, not the reverse.
    body = protein.where(F.trim("hetero") == "").withColumn("_one", F.lit(1)).drop("model")
    body = (
        models.withColumn("_one", F.lit(1))
        .join(bounded_broadcast(body, MAX_ATOMS), "_one")
        .drop("_one")
    )

    def clean(atoms, chain):
        return atoms.withColumns(
            {"chain": F.lit(chain), "segid": F.lit(f"{chain}   "), "occupancy": F.lit(1.0), "bfactor": F.lit(0.0)}
        )

    both = clean(body, "A").unionByName(clean(strand, "B"), allowMissingColumns=True)
    order = Window.partitionBy("model").orderBy("chain", "index")
    return both.withColumn("index", F.row_number().over(order))
