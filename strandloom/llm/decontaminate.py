"""Benchmark decontamination by a broadcast set of normalised windows.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.  An
item's windows are its runs of ``window`` words; a shorter item is one window.  Hashes of
document windows are looked up in the set of item windows and every hit is verified word
by word.

The set sent to the tasks holds at most ``block_chars`` characters of items: a larger
benchmark is cut into blocks, each scanned in its own pass, and the passes' spans are
merged per document.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import fresh, map_batches, utf8

# Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit to a space.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
BLOCK_CHARS = 32_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Windows:
    """Windows of one block of items: vocabulary, hashes by length, exact table."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        self.window = window
        exact: dict[bytes, set[int]] = {}
        self.names: list[str | None] = []
        numbers: dict[str | None, int] = {}
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 2**63, window, dtype=np.uint64) | np.uint64(1)
        lengths: dict[int, set[int]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            if name not in numbers:
                numbers[name] = len(self.names)
                self.names.append(name)
            array = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32)
            k = min(window, len(array))
            hashes = self.hashes(array, np.arange(len(array) - k + 1), k)
            lengths.setdefault(k, set()).update(hashes.tolist())
            for i in range(len(array) - k + 1):
                exact.setdefault(array[i : i + k].tobytes(), set()).add(numbers[name])
        self.exact = {key: tuple(sorted(v)) for key, v in exact.items()}
        self.sorted = {k: np.array(sorted(v), np.uint64) for k, v in sorted(lengths.items())}

    def hashes(self, array: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out += array[at + j].astype(np.uint64) * self.factors[j]
        return out

    def scan(self, array: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
        """Starts and lengths of verified hits in word numbers (0: no item word), and
        the items of each."""
        places, found = [], []
        known = np.concatenate(([0], np.cumsum(array > 0)))
        for k, hashes in self.sorted.items():
            if len(array) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            own = self.hashes(array, at, k)
            place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for i in at[hashes[place] == own].tolist():
                items = self.exact.get(array[i : i + k].tobytes())
                if items:
                    places.append((i, k))
                    found.append(items)
        return places, found


def _scan_block(rows: DataFrame, items: list, window: int, kind: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def start():
        windows = Windows(sent.value, window)
        get, none = windows.ids.get, repeat(0)

        def step(batch: pa.RecordBatch) -> dict:
            sizes, parts = [], []
            for text in utf8(batch):
                words = words_of(text)
                sizes.append(len(words))
                parts.append(np.fromiter(map(get, words, none), np.int32, len(words)))
                parts.append(np.zeros(1, np.int32))  # no window crosses documents
            flat = np.concatenate(parts)
            begins = np.cumsum([0, *(n + 1 for n in sizes)])[:-1]
            places, found = windows.scan(flat)
            spans: list[list] = [[] for _ in sizes]
            items: list[set] = [set() for _ in sizes]
            for (i, k), names in sorted(zip(places, found)):
                doc = int(np.searchsorted(begins, i, "right")) - 1
                i -= int(begins[doc])
                items[doc].update(names)
                if spans[doc] and i <= spans[doc][-1][1]:
                    spans[doc][-1][1] = max(spans[doc][-1][1], i + k)
                else:
                    spans[doc].append([i, i + k])
            return {
                "_row": batch.column("_row"),
                "doc_id": batch.column("doc_id"),
                "n_words": sizes,
                "spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
                "items": [sorted(windows.names[i] for i in s if windows.names[i] is not None) for s in items],
            }

        return step

    return map_batches(
        rows,
        f"_row long, doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>",
        start,
    )


def scan(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: doc_id, n_words, spans (hit word ranges, merged), items (sorted ids).

    Null and empty texts have no words and no hits, repeated rows are judged alike, an
    item without words has no window.  Hits of an item whose id is null count as hits,
    but the item is not listed.  Tables of no rows give no hits or no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    benchmark = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))
    size = benchmark.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    if blocks == 1:
        rows = docs.select(F.lit(0).cast("long").alias("_row"), "doc_id", "text")
        block = [(r[0], bytes(r[1])) for r in benchmark.where("text is not null").distinct().collect()]
        return _scan_block(rows, block, window, kind).drop("_row")
    # Rows are told apart by a number that the written table fixes.
    from strandloom.staging import stage

    rows = stage(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "scanned")
    return _merged(_scan_blocks(rows, benchmark, window, kind, blocks)).drop("_row")


def _scan_blocks(rows: DataFrame, benchmark: DataFrame, window: int, kind: str, blocks: int) -> DataFrame:
    """What each block finds in each row."""
    part = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        block = [(r[0], bytes(r[1])) for r in benchmark.where((part == b) & F.col("text").isNotNull()).distinct().collect()]
        one = _scan_block(rows, block, window, kind)
        found = one if found is None else found.unionByName(one)
    return found


def _merged(found: DataFrame) -> DataFrame:
    """One row for each scanned one, with the spans and items of all blocks."""
    return (
        found.groupBy("_row", "doc_id", "n_words")
        .agg(
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .withColumn(
            "spans",
            F.aggregate(
                "spans",
                F.expr("cast(array() as array<struct<start:long,end:long>>)"),
                lambda out, s: F.when(
                    (F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]),
                    F.concat(
                        F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                        F.array(
                            F.struct(
                                F.element_at(out, -1)["start"].alias("start"),
                                F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"),
                            )
                        ),
                    ),
                ).otherwise(F.concat(out, F.array(s))),
            ),
        )
    )


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the characters from each span's first to its last word."""
    import re

    found = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text.translate(NORMAL))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : found[a][0]])
        at = found[b - 1][1]
    out.append(text[at:])
    return b"".join(out)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, mode: str = "documents", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents without benchmark passages, with the columns of ``docs``.

    ``documents`` drops every document with a hit, ``spans`` cuts the hit words out.
    A benchmark of more than ``block_chars`` is scanned block by block; the rows are the same.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode}")
    benchmark = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    size = benchmark.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    if size > block_chars:
        return _decontaminate_blocks(docs, items, window, mode, block_chars)
    block = [(r[0], bytes(r[1])) for r in benchmark.where("text is not null").distinct().collect()]
    sent = docs.sparkSession.sparkContext.broadcast(block)
    columns = docs.columns

    def run(batches):
        windows = Windows(sent.value, window)
        get, none = windows.ids.get, repeat(0)
        at = columns.index("text")
        for batch in batches:
            keep, changed = [], []
            for text in utf8(batch):
                words = words_of(text)
                places, _ = windows.scan(np.fromiter(map(get, words, none), np.int32, len(words)))
                keep.append(mode == "spans" or not places)
                if places and mode == "spans":
                    spans: list[list[int]] = []
                    for i, k in sorted(places):
                        if spans and i <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], i + k)
                        else:
                            spans.append([i, i + k])
                    text = remove_spans(text, [(a, b) for a, b in spans])
                changed.append(text)
            if mode == "spans":
                old = batch.column(at)
                new = pa.array([None if o is None else c.decode() for o, c in zip(old.to_pylist(), changed)], old.type)
                batch = pa.RecordBatch.from_arrays(
                    [new if i == at else batch.column(i) for i in range(len(columns))], schema=batch.schema
                )
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _decontaminate_blocks(docs: DataFrame, items: DataFrame, window: int, mode: str, block_chars: int) -> DataFrame:
    """Rows are told apart by their number in a written table, so doc_id may be null or repeat."""
    from strandloom.staging import stage

    kind = docs.schema["doc_id"].dataType.simpleString()
    benchmark = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))
    size = benchmark.agg(F.sum(F.length("text") + 16)).first()[0]
    row, hits = fresh(docs, "_row", "_spans")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminated")
    texts = rows.select(F.col(row).alias("_row"), "doc_id", "text")
    found = _scan_blocks(texts, benchmark, window, kind, -(-size // block_chars))
    merged = _merged(found.where(F.size("spans") > 0))
    hit = stage(merged.select(F.col("_row").alias(row), F.col("spans").alias(hits)), "hits")
    if mode == "documents":
        return rows.join(hit, row, "left_anti").select(*docs.columns)

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            out = {c: batch.column(c) for c in docs_columns}
            changed = []
            old = batch.column("text").to_pylist()
            for o, text, spans in zip(old, utf8(batch), batch.column(hits).to_pylist()):
                if spans:
                    o = remove_spans(text, [(x["start"], x["end"]) for x in spans]).decode()
                changed.append(o)
            return out | {"text": changed}

        return step

    docs_columns = docs.columns
    joined = rows.join(hit, row, "left").select(*docs_columns, hits)
    return map_batches(joined, docs.schema, start)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = scan(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
