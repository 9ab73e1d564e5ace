"""Repeated passages: windows of neighbouring lines, removed after byte comparison.

Lines end at line feeds and, as paragraphs often are one long line, after sentences.  A
window starts at every line and one ends at every line: the shortest run of two lines or
more that has ``min_bytes`` bytes.  Any passage of two lines or more with that many bytes
is covered by windows inside it, whatever stands around it: a line that no window ending
at it covers lies in the window that starts with the passage.  A line of more than
``line_words`` words is a window of its own.

Window hashes are counted over the whole table.  Only texts of windows that pass a Bloom
filter of the repeated hashes are shuffled; each is then compared with the first occurrence
of its hash byte by byte.  A window that passes by chance is its own first one.  The first occurrence, by doc_id and
place, always stays: whatever goes is the same as something earlier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import bloom
from strandloom.llm.common import fresh, map_batches, texts
from strandloom.staging import row_bound, stage, with_bound

MARK = "\x1e"


@dataclass(frozen=True)
class Settings:
    """Runs of lines of fewer than ``min_bytes`` bytes are no passages, and single lines
    only if they have more than ``line_words`` words.  ``hash_bits`` is for tests of
    collisions."""

    min_bytes: int = 60
    line_words: int = 50
    hash_bits: int = 128


def lines_of(text: str) -> list[str]:
    """The text in lines, each with the white space behind it; together they are the text."""
    if not text:
        return []
    if MARK in text:
        parts = [p for line in text.split("\n") for p in (line, "\n")][:-1]
    else:
        marked = text.replace("\n", "\n" + MARK)
        for end in (". ", "! ", "? "):
            marked = marked.replace(end, end + MARK)
        parts = marked.split(MARK)
    if all(map(str.strip, parts)):
        return parts
    out: list[str] = []
    for p in parts:
        if out and (not p or p.isspace()):
            out[-1] += p
        elif p:
            out.append(p)
    return out


@dataclass
class Chunks:
    """Windows of several texts: lines of all, stripped, first line of each text, and one entry per
    window: its text, lines from ``begin`` to ``end`` (of all lines) and two hashes."""

    lines: list[str]
    base: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def chunks(many: list[str], settings: Settings) -> Chunks:
    """All windows of the texts, each once."""
    lines: list[str] = []
    counts = np.zeros(len(many), np.int64)
    for i, text in enumerate(many):
        own = lines_of(text)
        counts[i] = len(own)
        lines += own
    stripped = list(map(str.strip, lines))
    plain = list(map(str.encode, stripped))
    n = len(plain)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, n)
    size = np.fromiter(map(len, plain), np.int64, n)
    owner = np.repeat(np.arange(len(many)), counts)
    base = np.cumsum(counts) - counts
    low, high = base[owner], (base + counts)[owner]
    at = np.arange(n)
    before = np.concatenate(([0], np.cumsum(size)))
    # From every line on, and up to every line: two lines at least, and enough bytes.
    ends = np.maximum(at + 2, np.searchsorted(before, before[:-1] + settings.min_bytes, "left"))
    starts = np.minimum(at - 1, np.searchsorted(before, before[1:] - settings.min_bytes, "right") - 1)
    forward, backward = ends <= high, starts >= low
    # More than ``line_words`` words have that many bytes and as many spaces between them.
    alone = np.array([i for i in np.flatnonzero(size > 2 * settings.line_words).tolist() if len(lines[i].split()) > settings.line_words], np.int64)
    backward[backward] = ends[starts[backward]] != at[backward] + 1  # the one that starts there may be the same
    begin = np.concatenate((at[forward], starts[backward], alone))
    length = np.concatenate((ends[forward], at[backward] + 1, alone + 1)) - begin
    sums = np.zeros((2, len(begin)), np.uint64)
    for total, factor in zip(sums, (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)):
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(factor)
        here = np.arange(len(begin))
        for j in range(int(length.max(initial=0))):
            here = here[length[here] > j]
            total[here] = (total[here] + mixed[begin[here] + j]) * np.uint64(factor)
    h1, h2 = sums.view(np.int64)
    if settings.hash_bits < 128:
        h1, h2 = h1 & 0, h2 & ((1 << settings.hash_bits) - 1)
    return Chunks(stripped, base, owner[begin], begin, begin + length, h1, h2)


TEXTS = 500  # cut at once


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def _places(c: Chunks) -> np.ndarray:
    """Number of lines of each window and its first line in its text, in one number."""
    return c.end - c.begin << 40 | c.begin - c.base[c.text]


def _hash_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    def start():
        def step(batch: pa.RecordBatch) -> dict | None:
            many, parts = texts(batch), []
            for k in range(0, len(many), TEXTS):
                c = chunks(many[k : k + TEXTS], settings)
                parts.append((c.h1, c.h2))
            h1, h2 = (np.concatenate(x) for x in zip(*parts))
            return {"h1": h1, "h2": h2}

        return step

    return map_batches(docs.select("text"), "h1 long, h2 long", start)


def _text_rows(docs: DataFrame, sent, settings: Settings, kind: str) -> DataFrame:
    """Windows that pass the filter of repeated hashes with their lines.

    Lines stand without the white space around them, so none holds a line feed and feeds
    between them tell them apart.
    """

    def start():
        def step(batch: pa.RecordBatch) -> dict | None:
            out: dict[str, list] = {n: [] for n in ("place", "h1", "h2", "lines")}
            many, owner = texts(batch), []
            for k in range(0, len(many), TEXTS):
                c = chunks(many[k : k + TEXTS], settings)
                hit = np.flatnonzero(sent.value.passes(c.h2))
                out["place"].append(_places(c)[hit])
                out["h1"].append(c.h1[hit])
                out["h2"].append(c.h2[hit])
                owner.append(c.text[hit] + k)
                out["lines"] += ["\n".join(c.lines[a:b]) for a, b in zip(c.begin[hit].tolist(), c.end[hit].tolist())]
            if not out["lines"]:
                return None
            out |= {n: np.concatenate(out[n]) for n in ("place", "h1", "h2")}
            take = pa.array(np.concatenate(owner))
            return out | {"doc_id": batch.column("doc_id").take(take), "key": batch.column("key").take(take)}

        return step

    return map_batches(
        _keyed(docs),
        f"doc_id {kind}, key long, place long, h1 long, h2 long, lines string",
        start,
    )


def removals(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, key, ranges): the windows to remove, for documents that have any.

    ``key`` is a hash of doc_id and text; rows that repeat both are one document.  A window
    is told by its number of lines and its first line, in one number as ``_places`` makes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # A row that repeats doc_id and text makes its chunks repeat, but only as themselves.
    repeated = _hash_rows(docs, settings).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    repeated = stage(repeated.select("h2"), "repeated")
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(repeated, "h2", row_bound(repeated)))
    found = stage(_text_rows(docs, sent, settings, kind), "occurrences")
    # Written, so that the join reads plain exchanges and can split a window that very many have.
    order = F.struct("doc_id", "key", "place", "lines")
    first = found.groupBy("h1", "h2").agg(F.min(order).alias("f"))
    first = stage(first.select("h1", "h2", *[F.col(f"f.{c}").alias(f"f_{c}") for c in ("doc_id", "key", "place", "lines")]), "firsts")
    is_first = F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("key") == F.col("f_key")) & (F.col("place") == F.col("f_place"))
    alike = F.col("lines") == F.col("f_lines")
    compared = found.join(first, ["h1", "h2"]).where(~is_first).select("doc_id", "key", "place", alike.alias("alike"))
    ranges = F.collect_set(F.when(F.col("alike"), F.col("place"))).alias("ranges")
    out = stage(compared.groupBy("doc_id", "key").agg(ranges, F.bool_and("alike").alias("alike")), "removals")
    if out.where("not alike").limit(1).count():
        rest = _collided(found, stage(compared.where("not alike"), "collided"))
        gone = out.select("doc_id", "key", F.explode("ranges").alias("place")).unionByName(rest)
        out = stage(gone.groupBy("doc_id", "key").agg(F.collect_set("place").alias("ranges")), "removals")
    return with_bound(out.select("doc_id", "key", "ranges"), row_bound(out))


def _collided(found: DataFrame, odd: DataFrame) -> DataFrame:
    """Occurrences whose hash is another chunk's: grouped by their lines instead."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("doc_id", "key", "place")]
    rows = found.alias("f").join(odd.alias("o"), same[0] & same[1] & same[2], "left_semi")
    place = F.struct("doc_id", "key", "place")
    firsts = rows.groupBy("lines").agg(F.min(place).alias("first"))
    return rows.join(firsts, "lines").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "key", "place")


def _cut(lines: list[str], places: np.ndarray) -> tuple[str, int]:
    """The text without the windows at ``places``, and how many lines go."""
    begin = places & ((1 << 40) - 1)
    steps = np.bincount(begin, minlength=len(lines) + 1) - np.bincount(begin + (places >> 40), minlength=len(lines) + 1)
    gone = np.cumsum(steps[:-1]) > 0
    return "".join(x for x, g in zip(lines, gone) if not g).strip(), int(gone.sum())


def clean(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``_lines``, ``_removed``, ``_share``.

    ``_share`` is the share of words that stay.  Null and empty texts have no lines and do
    not change; ties cannot occur, as the first occurrence is by doc_id (null first),
    then by a hash and by place; rows that repeat doc_id and text change alike and count
    as one; an empty table gives no rows.  Texts are used whole, however long.  Untouched
    texts keep every byte; others lose white space at their ends.  Columns of the caller
    stay as they are, whatever their names; an added name that is taken gets underscores.
    """
    n_lines, n_removed, share = fresh(docs, "_lines", "_removed", "_share")
    key, known_id, known_key, ranges, maybe = fresh(docs, "_key", "_id", "_k", "_ranges", "_maybe")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    cut = removals(docs, settings)
    cut = cut.select(F.col("doc_id").alias(known_id), F.col("key").alias(known_key), F.col("ranges").alias(ranges))
    # Documents that a Bloom filter of the others' keys stops have nothing to lose and stay in place.
    known = bloom.build(cut.select(F.xxhash64(known_key).alias("hash")), "hash", row_bound(cut))
    keyed = keyed.withColumn(maybe, bloom.may_hold(known, docs.sparkSession, key))
    same = (F.col(key) == F.col(known_key)) & F.col("doc_id").eqNullSafe(F.col(known_id))
    touched = keyed.where(F.col(maybe)).join(cut.hint("merge"), same, "left").select(*docs.columns, ranges)
    untouched = keyed.where(~F.col(maybe)).select(*docs.columns, F.lit(None).cast(cut.schema[ranges].dataType).alias(ranges))
    joined = touched.unionByName(untouched)
    columns = docs.columns
    schema = docs.withColumns(
        {n_lines: F.lit(0).cast("long"), n_removed: F.lit(0).cast("long"), share: F.lit(1.0)}
    ).schema

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            out = {c: batch.column(c) for c in columns}
            changed, lines_in, gone_of, kept_of = [], [], [], []
            old = batch.column("text").to_pylist()
            found = batch.column(ranges)  # null has no values
            ends = found.offsets.to_numpy().tolist()
            places = found.values.to_numpy()
            for text, a, b in zip(old, ends, ends[1:]):
                lines = lines_of(text or "")
                lines_in.append(len(lines))
                if a == b:
                    changed.append(text)
                    gone_of.append(0)
                    kept_of.append(1.0)
                    continue
                new, gone = _cut(lines, places[a:b])
                changed.append(new)
                gone_of.append(gone)
                kept_of.append(len(new.split()) / max(1, len(text.split())))
            return out | {"text": changed, n_lines: lines_in, n_removed: gone_of, share: kept_of}

        return step

    return map_batches(joined, schema, start)


def drop_repeated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cleaned documents with the columns of ``docs``, without those that keep no word."""
    share = fresh(docs, "_share")[0]
    return clean(docs, settings).where(F.col(share) > 0).select(*docs.columns)


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_lines, n_removed, share_kept and text_sha256 of the cleaned text."""
    return clean(docs.select("doc_id", "text"), settings).select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_removed").alias("n_removed"),
        F.col("_share").alias("share_kept"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
