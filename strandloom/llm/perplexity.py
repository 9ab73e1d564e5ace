"""Quality classifier: perplexity under a modified Kneser-Ney n-gram model of trusted text.

The units are UTF-8 bytes, so n-grams of any language are exact integers and none is out of
vocabulary.  Texts lose repeated white space and the values of their digits.

*Model.*  Tasks count the n-grams of the trusted text and the counts are summed by key.
Lower orders count distinct left extensions; discounts come from the counts of counts of
each order; probabilities are interpolated down to the uniform byte by joins of each order
with its contexts and with the order below.

*Scoring.*  The count tables are cut into shards by the two bytes before the last one, so
that a byte's whole back-off chain lies in one shard.  A shard has at most ``shard_rows``
entries (one pair of bytes may exceed that by its own entries), so it can be sent to every
task whatever the size of the model; the orders up to two, at most 65,792 entries, go with
each.  Every shard makes one pass over the documents, which therefore never move; partial
sums are added per document and block of bytes.

*Decision.*  A few odd words vanish in the average of a long text, so the worst window of
a document decides: all windows of ``WIDTH`` neighbouring blocks are scored.  A tenth of the
trusted documents, by hash, is not trained on.  The limit of a language is a quantile of
the worst windows of these documents; documents above it go.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import bloom
from strandloom.llm.common import kept, map_batches, utf8
from strandloom.staging import bounded_broadcast, stage

PAD = 2  # byte that stands for the start of a text
DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
CHUNK = 500_000  # bytes handled at once inside a task
BLOCK = 8  # bytes whose costs are added up
WIDTH = 3  # blocks of a window
FALLBACK = (0.5, 1.0, 1.5)  # discounts where the counts of counts are degenerate


@dataclass(frozen=True)
class Settings:
    """``order`` (3 to 7) in bytes; a tenth of trusted documents (``held_out`` = 10)
    sets the limits; ``shard_rows`` bounds what is sent to a task.  The limit of a
    language is the ``quantile`` of the worst windows of its held-out documents, or an
    estimate of it where these are too few to show it.
    ``prior`` bytes at the language's middle perplexity are added to the perplexity of a
    document, and what a text lacks of a window counts as such bytes.
    Languages with fewer than ``least`` held-out documents use the limit of all."""

    order: int = 5
    held_out: int = 10
    quantile: float = 0.99
    prior: int = 60
    least: int = 20
    shard_rows: int = 4_000_000


def _chunks(many: list[bytes], order: int):
    """Documents as runs of n-grams: keys, owner of each key, number of documents."""
    pad = bytes([PAD]) * (order - 1)
    parts: list[bytes] = []
    size = 0
    for text in many:
        parts.append(pad + b" ".join(text.translate(DIGITS).split()))
        size += len(parts[-1])
        if size >= CHUNK:
            yield _keys(parts, order)
            parts, size = [], 0
    if parts:
        yield _keys(parts, order)


def _keys(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams that end in a document's own bytes, and their numbers."""
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    keys = np.zeros(max(0, len(flat) - order + 1), np.int64)
    for j in range(order if len(keys) else 0):
        keys |= flat[order - 1 - j : len(flat) - j] << (8 * j)
    sizes = np.array([len(p) - order + 1 for p in parts])
    ends = np.cumsum(sizes + order - 1)
    # The order - 1 windows that cross into the next document are left out.
    keep = np.ones(len(keys), bool)
    for j in range(order - 1):
        keep[(ends[:-1] - 1 - j)[ends[:-1] - 1 - j < len(keys)]] = False
    return keys[keep], sizes


def count_ngrams(texts: DataFrame, order: int) -> DataFrame:
    """(key, n): how often each byte n-gram occurs in ``texts``."""

    def start():
        total: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in total]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in total])).astype(np.int64)

        def step(batch: pa.RecordBatch | None) -> dict | None:
            if batch is not None:
                for keys, _ in _chunks(utf8(batch), order):
                    total.append(np.unique(keys, return_counts=True))
                    if len(total) == 8:
                        total[:] = [merged()]
            full = sum(len(k) for k, _ in total)
            if not full or (batch is not None and full < 1_000_000):
                return None
            keys, n = merged()
            total.clear()
            return {"key": keys, "n": n}

        return step

    made = map_batches(texts.select("text"), "key long, n long", start, finish=True)
    return made.groupBy("key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]).first()
    if min(n[0], n[1], n[2]) == 0:
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    made = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return tuple(d if 0 < d <= i else FALLBACK[i - 1] for i, d in zip((1, 2, 3), made))


def model(texts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (key, value) of n-grams and of their contexts, as logarithms.

    The value of a context is the weight of the order below it.
    """
    counts = {order: stage(count_ngrams(texts, order), "ngrams")}
    for n in range(order - 1, 0, -1):
        lower = F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))
        counts[n] = stage(counts[n + 1].groupBy(lower.alias("key")).agg(F.count("*").alias("n")), "ngrams")
    out = []
    below: DataFrame | None = None
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[n])
        context = F.shiftright("key", 8)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = stage(
            counts[n].groupBy(context.alias("h")).agg(F.sum("n").alias("total"), F.sum(off).alias("off")), "contexts"
        )
        rows = counts[n].withColumn("h", context).join(contexts, "h")
        weight = F.col("off") / F.col("total")
        own = F.greatest(F.col("n") - off, F.lit(0.0)) / F.col("total")
        if below is None:
            p = rows.select("key", (own + weight / 256).alias("p"))
        else:
            lower = F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))
            p = (
                rows.select("key", own.alias("own"), weight.alias("w"), lower.alias("low"))
                .join(below.select(F.col("key").alias("low"), F.col("p").alias("q")), "low")
                .select("key", (F.col("own") + F.col("w") * F.col("q")).alias("p"))
            )
        below = stage(p, "probabilities")
        out.append(
            (
                below.select("key", F.log("p").alias("value")),
                contexts.select(F.col("h").alias("key"), F.log(weight).alias("value")),
            )
        )
    return out


class Table:
    """A hash table of long keys in numpy arrays, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            chosen = todo[free][first]
            self.keys[slots], self.values[slots] = keys[chosen], values[chosen]
            rest = self.keys[at] != keys[todo]
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value (0 if missing) and whether the key is there."""
        at = self._slot(keys)
        held = self.keys[at]
        there = held == keys
        values = np.where(there, self.values[at], np.float32(0))
        todo = np.flatnonzero(~there & (held != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[todo]
            there[todo[hit]] = True
            values[todo[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            todo, at = todo[go], at[go]
        return values, there


class Shard:
    """One shard of the model: scores the n-grams whose middle bytes belong to it."""

    def __init__(self, order: int, number: int, owner: np.ndarray, arrays: list):
        self.order, self.number, self.owner = order, number, owner
        self.tables = [(Table(*p), Table(*c)) for p, c in arrays]

    def blocks(self, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost (negative log probability) of this shard's n-grams in every block of the
        documents, one document after the other, and the number of blocks of each."""
        counts = -(-sizes // BLOCK)
        first = np.repeat(np.cumsum(counts) - counts, sizes)
        own = first + (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // BLOCK
        if self.owner.max():
            mine = self.owner[(keys >> 8) & 0xFFFF] == self.number
            keys, own = keys[mine], own[mine]
        total = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for n in range(self.order, 0, -1):
            short = keys[todo] & ((1 << 8 * n) - 1)
            value, there = self.tables[n - 1][0].find(short)
            total[todo] += value
            todo, short = todo[~there], short[~there]
            if not len(todo):
                break
            total[todo] += self.tables[n - 1][1].find(short >> 8)[0]
        else:
            total[todo] -= np.log(256)
        return np.bincount(own, -total, int(counts.sum())), counts


def worst_windows(blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest cost of ``WIDTH`` neighbouring blocks of each document; of all blocks
    where there are fewer."""
    before = np.concatenate(([0.0], np.cumsum(blocks)))
    ends = np.cumsum(counts)
    out = before[ends] - before[ends - counts]
    long = np.flatnonzero(counts > WIDTH)
    if len(long):
        windows = before[WIDTH:] - before[:-WIDTH]
        # Runs of windows that lie in one document; those across two are left out.
        cuts = np.stack([(ends - counts)[long], ends[long] - WIDTH + 1], 1).ravel()
        out[long] = np.maximum.reduceat(np.append(windows, -np.inf), cuts)[::2]
    return out


def score(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]], settings: Settings) -> DataFrame:
    """doc_id, lang, n_bytes, log_p and worst (cost of the worst window) of every document.

    Null texts are empty.
    """
    order = settings.order
    spark = docs.sparkSession
    entries = None
    for n, pair in enumerate(tables, 1):
        for kind, table in enumerate(pair):
            # The two bytes before an n-gram's last one, which are a context's last two.
            middle = F.shiftright("key", 8 * (1 - kind)).bitwiseAND(F.lit(0xFFFF))
            part = table.select(
                F.lit(n).alias("n"), F.lit(kind).alias("kind"), "key", F.col("value").cast("float").alias("value"),
                (F.lit(-1) if n < 3 else middle.cast("int")).alias("middle"),
            )
            entries = part if entries is None else entries.unionByName(part)
    entries = stage(entries, "model")
    sizes = {r[0]: r[1] for r in entries.groupBy("middle").count().collect()}  # at most 65,537 rows
    owner = np.zeros(1 << 16, np.int64)
    shard, filled = 0, 0
    for m in range(1 << 16):
        here = sizes.get(m, 0)
        if filled and filled + here > settings.shard_rows:
            shard, filled = shard + 1, 0
        owner[m] = shard
        filled += here
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "lang", "text")
    many = shard > 0
    if many:
        rows = stage(rows, "scored")
    total = None
    run = uuid.uuid4().hex
    for s in range(shard + 1):
        members = np.flatnonzero(owner == s)
        low, high = int(members[0]), int(members[-1])  # shards are runs of middles
        held = entries.where(f"middle = -1 or middle between {low} and {high}").drop("middle").toArrow()
        column = {c: held.column(c).to_numpy() for c in held.column_names}
        arrays = []
        for n in range(1, order + 1):
            at = [(column["n"] == n) & (column["kind"] == k) for k in (0, 1)]
            arrays.append(tuple((column["key"][a], column["value"][a]) for a in at))
        sent = spark.sparkContext.broadcast((owner, arrays))

        def start(s=s, sent=sent):
            made = kept((run, s), lambda: Shard(order, s, *sent.value))

            def step(batch: pa.RecordBatch) -> dict:
                costs, counts, sizes = [], [], []
                for keys, own in _chunks(utf8(batch), order):
                    cost, count = made.blocks(keys, own)
                    costs.append(cost)
                    counts.append(count)
                    sizes.append(own)
                out = {
                    "_row": batch.column("_row"),
                    "doc_id": batch.column("doc_id"),
                    "lang": batch.column("lang"),
                    "n_bytes": np.concatenate(sizes).astype(np.int64),
                }
                if many:
                    ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
                    return out | {"costs": pa.ListArray.from_arrays(ends, np.concatenate(costs).astype(np.float32))}
                # No window crosses documents, so chunks are handled one by one.
                return out | {
                    "log_p": -np.concatenate([_sums(c, n) for c, n in zip(costs, counts)]),
                    "worst": np.concatenate([worst_windows(c, n) for c, n in zip(costs, counts)]),
                }

            return step

        kept_columns = "costs array<float>" if many else "log_p double, worst double"
        one = map_batches(rows, f"_row long, doc_id {kind_of}, lang string, n_bytes long, {kept_columns}", start)
        total = one if total is None else total.unionByName(one)
    if many:
        added = F.aggregate(
            F.slice("parts", 2, shard),
            F.transform(F.element_at("parts", 1), lambda x: x.cast("double")),
            lambda have, more: F.zip_with(have, more, lambda x, y: x + y),
        )
        summed = total.groupBy("_row", "doc_id", "lang", "n_bytes").agg(F.collect_list("costs").alias("parts"))
        total = _worst_of(summed.select("doc_id", "lang", "n_bytes", added.alias("costs")), kind_of)
    return total.drop("_row")


def _sums(costs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(counts)), counts), costs, len(counts))


def _worst_of(summed: DataFrame, kind_of: str) -> DataFrame:
    """log_p and worst of documents whose block costs lie in an array."""

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            held = batch.column("costs")
            counts = held.value_lengths().to_numpy().astype(np.int64)
            costs = held.flatten().to_numpy()
            return {n: batch.column(n) for n in ("doc_id", "lang", "n_bytes")} | {
                "log_p": -_sums(costs, counts), "worst": worst_windows(costs, counts),
            }

        return step

    return map_batches(summed, f"doc_id {kind_of}, lang string, n_bytes long, log_p double, worst double", start)


def _limits(scored: DataFrame, settings: Settings) -> DataFrame:
    """middle and limit (log perplexity) of each language and, with null, of all."""
    middle = F.percentile_approx(-F.col("log_p") / F.col("n_bytes"), 0.5, 10_000)
    worst = F.col("worst") / F.least("n_bytes", F.lit(BLOCK * WIDTH))
    found, low, high = (F.percentile_approx(worst, p, 10_000) for p in (settings.quantile, 0.8, 0.95))
    # Fewer documents than this cannot show the quantile: an exponential tail is laid through two lower ones.
    least = round(1 / (1 - settings.quantile))
    tail = high + (high - low) * (math.log(0.05 / (1 - settings.quantile)) / math.log(0.2 / 0.05))
    limit = F.when(F.count("*") < least, F.greatest(found, tail)).otherwise(found)
    columns = [F.count("*").alias("n"), middle.alias("middle"), limit.alias("limit")]
    each = scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(*columns)
    every = scored.agg(*columns).select(F.lit(None).cast("string").alias("lang"), "n", "middle", "limit")
    return each.where(F.col("n") >= settings.least).unionByName(every)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, worst, limit and kept of every document.

    ``perplexity`` is that of the whole text by byte, with the prior; ``worst`` is that of
    the worst window, which may not exceed ``limit``.  Trusted are documents that
    ``labels`` gives quality 1 and no toxicity.  Null and empty texts have nothing to
    score and are kept; repeated rows score alike; a null language is one of its own;
    without trusted text every document is kept and its limit is null.
    """
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(settings.held_out)) == 0
    training = _texts_of(docs, stage(trusted.where(~held & F.col("doc_id").isNotNull()), "trusted"))
    scored = stage(score(docs, model(training, settings.order), settings), "scores")
    sample = scored.join(trusted.where(held), "doc_id", "left_semi")
    limits = stage(_limits(sample, settings), "limits")
    every = limits.where("lang is null").first()
    each = limits.where("lang is not null").select(F.col("lang").alias("_lang"), "middle", "limit")
    key = F.coalesce("lang", F.lit(""))
    rows = scored.join(bounded_broadcast(each, 10_000), key == F.col("_lang"), "left")
    middle = F.coalesce("middle", F.lit(every["middle"]).cast("double"))
    cost = (settings.prior * middle - F.col("log_p")) / (F.col("n_bytes") + settings.prior)
    size = BLOCK * WIDTH
    worst = (F.col("worst") + F.greatest(F.lit(0), size - F.col("n_bytes")) * middle) / size
    return rows.select(
        "doc_id",
        "lang",
        "n_bytes",
        cost.alias("_cost"),
        worst.alias("_worst"),
        F.coalesce("limit", F.lit(every["limit"]).cast("double")).alias("_limit"),
    ).select(
        "doc_id",
        "lang",
        "n_bytes",
        F.exp("_cost").alias("perplexity"),
        F.exp("_worst").alias("worst"),
        F.exp("_limit").alias("limit"),
        (F.col("_limit").isNull() | (F.col("n_bytes") == 0) | (F.col("_worst") <= F.col("_limit"))).alias("kept"),
    )


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents with these ids (no nulls).

    A Bloom filter keeps most other texts out of the shuffle; the join is exact.
    """
    found = bloom.build(ids.select(F.xxhash64("doc_id").alias("hash")), "hash", ids.count())
    near = docs.select("doc_id", "text").where(bloom.may_hold(found, docs.sparkSession, "doc_id"))
    return near.join(ids.hint("merge"), "doc_id", "left_semi")


def drop_rejected(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents the classifier keeps, with the columns of ``docs``.

    Rows without a doc_id stay.
    """
    rejected = classify(docs, labels, settings).where("not kept").select("doc_id").distinct()
    return docs.join(rejected.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
