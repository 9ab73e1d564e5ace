"""Token ids on disk: ids ranked by frequency in a byte-aligned variable-length coding.

The format is a folder of Parquet tables, written by Spark so that lost tasks are done
again and any store will do:

``vocabulary``  ``rank``, ``id``, ``n``: the ids that occur, the most frequent first.
``encoded``     ids of each document in input order and counts of each task's ids, while the
                other two are made.
``shards``      one row per block of documents in ascending doc_id order: ``shard`` and
                ``block``, ``before`` (ids ahead of the block in its shard), ``doc_ids``
                and ``lengths`` of its documents, ``control`` and ``data``.

A rank takes one to four bytes of ``data``, low byte first.  Its two bits in ``control``
hold the number of bytes less one; four ranks share a control byte, the first in the low
bits.  Frequent ids have small ranks, so most take one byte.  Decoding looks each control
byte up in a table of four lengths and gathers the bytes of all ranks at once.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

from strandloom.llm.bpe import Recent, byte_letters, pieces_of, uncollected
from strandloom.llm.common import kept, map_batches, texts
from strandloom.staging import shared_dir

BLOCK_IDS = 1_000_000
TEXTS = 1000  # texts cut at a time
JOINED = 20_000  # pieces that the library gets as one text
HELD = 1_000_000  # pieces remembered per Python worker, and as many older ones; up to 350 MB
HELD_CHARS = 1 << 24  # characters of these pieces
TAIL = re.compile(r"(.*[^\W\d_])([.,!?*%&$#|]+)\Z", re.S)
# White space next to other white space, unless it is two line feeds.
RUNS = re.compile(r"\s(?:\s(?<!\n\n)|\n\n(?<=\n\n\n))")
# An ASCII text without these has no such place.
ASCII_RUNS = ("  ", "\n ", " \n", "\n\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
# Letters of any version of Unicode, behind the line feed that may open a piece.
WORD = re.compile("\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u0523]+")
# Number of bytes of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    kept = np.arange(4)[None, :] <= extra[:, None]
    return control.sum(1, dtype=np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of ``pack``."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for j in (1, 2, 3):
        more = np.flatnonzero(lengths > j)
        if not len(more):
            break
        out[more] |= raw[starts[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


class LibraryEncoder:
    """The tokenizers library over pieces of text, each different piece encoded once.

    A piece is what follows a space, or a line feed with what follows it.  Ids come as
    bytes of little-endian integers, of two bytes unless an id needs four.
    """

    def __init__(self, content: str, end_id: int = 0):
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        added = self.library.get_added_tokens_decoder().values()
        split = self.library.pre_tokenizer
        byte_level = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
        # Texts stay whole if a cut between pieces might change their ids.
        self.whole = (
            not byte_level
            or self.library.normalizer is not None
            or any(re.search(r"\s", t.content) or TAIL.match(t.content) for t in added)
            or any(t.lstrip or t.rstrip or t.single_word for t in added)
        )
        self.size = max(self.size, end_id + 1)
        self.dtype = "<u4" if self.size > 1 << 16 else "<u2"
        self.known = Recent()
        self.chars = 0  # of the pieces in ``known``
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.words = None
        if self.line is not None and not self.whole and not any(WORD.fullmatch(t.content) for t in added):
            self._words_alone()

    def _words_alone(self) -> None:
        """The same model behind a split at line feeds, for words already cut and spelt in letters of bytes."""
        letters = {byte: letter for letter, byte in byte_letters().items()}
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        self.spelt = letters | {10: "\n"}
        self.line_word = letters[10] + "\n"
        # Ids that open a piece: a line feed's, and those whose token begins with a space.
        self.opens = np.zeros(self.size, bool)
        self.opens[self.line] = True
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            self.opens[number] |= token[0] == letters[32]

    def _encode(self, many: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(many, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _keep(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray, ends: list[int]) -> None:
        raw, width = ids.tobytes(), ids.itemsize
        slices = map(slice, (width * starts).tolist(), (width * np.array(ends)).tolist())
        self.known.update(zip(pieces, map(raw.__getitem__, slices)))

    def _learn_words(self, words: list[str]) -> None:
        """Encode pieces that are one word of letters, many in one text."""
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            text = "\n".join([" " + p if p[0] != "\n" else p[1:] for p in part])
            spelt = text.encode().decode("latin-1").translate(self.spelt)
            if any(p[0] == "\n" for p in part):
                spelt = "\n".join(
                    [self.line_word + w if p[0] == "\n" else w for p, w in zip(part, spelt.split("\n"))]
                )
            found = self.words.encode_batch_fast([spelt], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            self._keep(part, ids, starts, [*starts[1:].tolist(), len(ids)])

    def _learn_plain(self, pieces: list[str]) -> None:
        """Encode pieces that hold no line feed but a first one and do not end in white space.

        They go to the library many at a time, between line feeds, which are words of
        their own and have an id that no other word holds.
        """
        line = np.array([self.line], self.dtype).tobytes()
        for k in range(0, len(pieces), JOINED):
            part = pieces[k : k + JOINED]
            text = "\n".join([" " + p if p[0] != "\n" else p[1:] for p in part])
            ids = np.frombuffer(self._encode([text])[0], self.dtype)
            ends = np.flatnonzero(ids == self.line)
            self._keep(part, ids, np.concatenate([[0], ends + 1]), [*ends.tolist(), len(ids)])
            self.known.update((p, line + self.known[p]) for p in part if p[0] == "\n")

    @uncollected()
    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces not known yet.

        Marks behind a letter are words of their own, so most pieces need only the part
        before them.
        """
        cut = {p: m.groups() for p in pieces if not p[-1:].isalpha() and (m := TAIL.match(p))}
        heads = {h for h, _ in cut.values()}
        heads.update(pieces.difference(cut))
        heads = self.known.missing(heads)
        self.chars += sum(map(len, heads)) + sum(map(len, cut))
        words, plain, odd = [], [], []
        for p in heads:
            if self.words and (p.isascii() and p.isalpha() or WORD.fullmatch(p)):
                words.append(p)
                continue
            body = p[1:] if p[:1] == "\n" else p
            joins = self.line is not None and body and "\n" not in body and not body[0].isspace() and not body[-1].isspace()
            (plain if joins else odd).append(p)
        self._learn_words(words)
        self._learn_plain(plain)
        self.known.update(zip(odd, self._encode([p if p[:1] in (" ", "\n") else " " + p for p in odd])))
        tails = list({t for _, t in cut.values()})
        marks = dict(zip(tails, self._encode(tails)))
        self.known.update([(p, self.known[h] + marks[t]) for p, (h, t) in cut.items()])

    def _cut(self, text: str) -> tuple[str | None, list[str]]:
        """What stands before the first piece and the pieces; ``None``: the first one got a line feed.

        A piece without white space at its start follows a space.
        """
        runs = any(x in text for x in ASCII_RUNS) if text.isascii() else True
        if self.line is None or runs and RUNS.search(text) or text[:1].isspace() or text[-1:].isspace():
            first, *pieces = pieces_of(text)
            return first, [" " + p if p[:1].isspace() else p for p in pieces]
        return None, ("\n" + text.replace("\n", " \n")).split(" ")

    def encode(self, many: list[str]) -> list[bytes]:
        """Ids of each text."""
        if self.whole:
            return self._encode(many)
        out: list[bytes] = []
        width = np.dtype(self.dtype).itemsize
        for k in range(0, len(many), TEXTS):
            cut = [self._cut(t) for t in many[k : k + TEXTS]]
            if len(self.known) > HELD or self.chars > HELD_CHARS:
                self.known.trim(0)
                self.chars = 0
            known, missing = self.known, set()
            for _, pieces in cut:
                missing.update(pieces)
            self._learn(known.missing(missing))
            heads = iter(self._encode([h for h, _ in cut if h is not None]))
            for head, pieces in cut:
                ids = b"".join(map(known.__getitem__, pieces))
                out.append(ids[width:] if head is None else next(heads) + ids)
        return out


def library(content: str, end_id: int) -> LibraryEncoder:
    """The encoder of a vocabulary, kept for the life of the Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
    return kept(("library", content, end_id), lambda: LibraryEncoder(content, end_id))


def encode(docs: DataFrame, content: str, end_id: int) -> DataFrame:
    """doc_id and ``ids`` (binary, see ``LibraryEncoder``), the end id last.

    Every task adds a row without ``ids``: its different ``tokens`` and how often each came (``n``).
    """
    sent = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        made = library(sent.value, end_id)
        end = np.array([end_id], made.dtype).tobytes()
        total = np.zeros(made.size, np.int64)

        def step(batch: pa.RecordBatch | None) -> dict:
            if batch is None:
                at = np.flatnonzero(total)
                return {"doc_id": [None], "ids": [None], "tokens": [at], "n": [total[at]]}
            ids = [x + end for x in made.encode(texts(batch))]
            total[:] += np.bincount(np.frombuffer(b"".join(ids), made.dtype), minlength=made.size)
            none = [None] * len(ids)
            return {"doc_id": batch.column("doc_id"), "ids": ids, "tokens": none, "n": none}

        return step

    schema = f"doc_id {kind}, ids binary, tokens array<long>, n array<long>"
    return map_batches(docs.select("doc_id", "text"), schema, start, finish=True)


def write(docs: DataFrame, path: str, content: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` and write the format to the folder ``path``.

    Null texts are empty and have the end id only; a null doc_id sorts first; repeated
    rows are written each; a document longer than a block is a block of its own; an empty
    table writes empty tables.  Rows are dealt by ranges of doc_id and of a row number, so
    that one id on many rows does not fall to one task.
    """
    spark = docs.sparkSession
    form = LibraryEncoder(content, end_id)
    size, dtype = form.size, form.dtype
    encoded = encode(docs, content, end_id).withColumn("row", F.monotonically_increasing_id())
    encoded.write.option("compression", "zstd").parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    each = encoded.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "n")).alias("_of"))
    counts = each.groupBy(F.col("_of.tokens").alias("id")).agg(F.sum("_of.n").alias("n"))
    # At most as many rows as the vocabulary has ids.
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1)
    ranked.select("rank", "id", "n").write.parquet(f"{path}/vocabulary")
    held = spark.read.parquet(f"{path}/vocabulary").toArrow()
    rank_of = np.zeros(size, np.uint32)
    rank_of[held.column("id").to_numpy()] = held.column("rank").to_numpy()
    sent = spark.sparkContext.broadcast(rank_of)
    kind = docs.schema["doc_id"].dataType.simpleString()
    to_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)

    def start():
        ids, rows, names, lengths = [], 0, [], []
        block, before = 0, 0

        def flush() -> dict:
            nonlocal ids, rows, names, lengths, block, before
            control, data = pack(sent.value[np.frombuffer(b"".join(ids), dtype)])
            out = {
                "block": [block], "before": [before], "n_ids": [rows],
                "doc_ids": pa.array([names], pa.list_(to_arrow) if to_arrow else None),
                "lengths": [lengths], "control": [control], "data": [data],
            }
            block, before = block + 1, before + rows
            ids, rows, names, lengths = [], 0, [], []
            return out

        def step(batch: pa.RecordBatch | None) -> dict | None:
            nonlocal rows
            made: list[dict] = []
            if batch is None:
                return flush() if names else None
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                n = len(x) // np.dtype(dtype).itemsize
                if names and rows + n > block_ids:
                    made.append(flush())
                ids.append(x)
                names.append(name)
                lengths.append(n)
                rows += n
            if not made:
                return None
            return {k: sum((m[k].to_pylist() if k == "doc_ids" else m[k] for m in made), []) for k in made[0]}

        return step

    rows_of_ids = encoded.where("tokens is null").select("doc_id", "ids", "row")
    ordered = rows_of_ids.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    map_batches(
        ordered,
        f"block int, before long, n_ids long, doc_ids array<{kind}>, lengths array<long>, control binary, data binary",
        start,
        finish=True,
    ).select(F.spark_partition_id().alias("shard"), "*").write.option("compression", "zstd").parquet(f"{path}/shards")
    remove(spark, f"{path}/encoded")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the format: doc_id, start, n_tokens, ids_crc32, read from its files.

    ``start`` counts the ids of all documents before one in ascending doc_id order.
    """
    shards = spark.read.parquet(f"{path}/shards")
    held = spark.read.parquet(f"{path}/vocabulary").select("rank", "id").orderBy("rank").toArrow()
    sent = spark.sparkContext.broadcast(held.column("id").to_numpy().astype(np.uint32))
    # One row per shard, that is per partition of the writer.
    sizes = shards.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    rows = shards.join(F.broadcast(starts), "shard").select(
        (F.col("_ahead") + F.col("before")).alias("start"), "n_ids", "doc_ids", "lengths", "control", "data"
    )

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for row in batch.to_pylist():
                ids = sent.value[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4")
                at = 0
                for name, n in zip(row["doc_ids"], row["lengths"]):
                    out["doc_id"].append(name)
                    out["start"].append(row["start"] + at)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(ids[at : at + n]))
                    at += n
            return out

        return step

    return map_batches(rows, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long", start)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/tokens-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, content: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder in the shared folder and read the files back."""
    path = new_folder(docs.sparkSession)
    write(docs, path, content, end_id)
    return read(docs.sparkSession, path)
