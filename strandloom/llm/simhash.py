"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` bits are linked.  Every bit position gets a
random code of ``radius + 1`` bits; for each non-zero vector ``v`` the mask of table ``v``
holds the positions whose code is not orthogonal to ``v``.  The codes of ``radius``
differing positions span at most ``radius`` dimensions, so some ``v`` is orthogonal to them
all: its mask leaves them out, and the pair has equal masked values in that table.  No pair
within the radius is ever missed.

Only distinct fingerprints are hashed, so copies cost nothing.  A bucket of two is a pair
of its own aggregate.  A bucket of up to ``BUCKET`` members is compared in one task, which
returns a spanning star of each of its components and never all pairs.  A larger one is
hashed again with other codes, and what is left after ``LEVELS`` rounds is compared in
pairs of blocks.  Links become components by alternating large and small stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import LOWER, fresh, map_batches, utf8
from strandloom.staging import stage

RADIUS = 4
BUCKET = 2048  # members of a bucket that one task compares: 4 million cheap steps
LEVELS = 3
_POP = np.array([bin(i).count("1") for i in range(65536)], np.uint8)


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """SimHash of the ``size``-word shingles of a text, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(begins), 65536):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(begins[k : k + 65536], ends[k : k + 65536])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t) for t in utf8(batch)], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))}

        return step

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, fp long", start)


def masks(radius: int, level: int) -> list[int]:
    """The bit masks of the covering tables, as signed longs."""
    rng = np.random.default_rng(1000 * level + radius)
    codes = rng.integers(1, 1 << (radius + 1), 64)  # never zero: no bit is left out by all
    out = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i in range(64) if bin(int(codes[i]) & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    x = (a[:, None] ^ b[None, :]).view(np.uint16).reshape(len(a), len(b), 4)
    return _POP[x].sum(-1, dtype=np.uint8) <= radius


def stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) of every component of a bucket that has more than one member."""
    root = np.arange(len(values))
    todo = np.ones(len(values), bool)
    for i in range(len(values)):
        if not todo[i]:
            continue
        todo[i] = False
        front = np.array([i])
        while len(front):
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            hit = np.zeros(len(rest), bool)
            for k in range(0, len(front), 64):
                hit |= _near(values[front[k : k + 64]], values[rest], radius).any(0)
            front = rest[hit]
            todo[front] = False
            root[front] = i
    moved = np.flatnonzero(root != np.arange(len(values)))
    return list(zip(values[moved].tolist(), values[root[moved]].tolist()))


def _stars_by_group(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links within groups of ``keys``; groups are small and follow each other."""
    names = [*keys, "fp"]
    ordered = rows.select(*names).repartition(*keys).sortWithinPartitions(*names)

    def start():
        held: list[np.ndarray] = []

        def flush() -> list[tuple[int, int]]:
            out: list[tuple[int, int]] = []
            if held:
                table = np.concatenate(held)
                held.clear()
                cut = np.flatnonzero((table[1:, :-1] != table[:-1, :-1]).any(1)) + 1
                for part in np.split(table[:, -1], cut):
                    if len(part) > 1:
                        out += stars(np.ascontiguousarray(part), radius)
            return out

        def step(batch: pa.RecordBatch | None) -> dict | None:
            links: list[tuple[int, int]] = []
            if batch is None:
                links = flush()
            else:
                table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
                last = (table[:, :-1] == table[-1, :-1]).all(1)
                begin = len(table) - int(np.argmin(last[::-1])) if not last.all() else 0
                if begin:  # the open group waits for the next batch
                    held.append(table[:begin])
                    links = flush()
                held.append(table[begin:])
            return {"a": [x for x, _ in links], "b": [x for _, x in links]} if links else None

        return step

    return map_batches(ordered, "a long, b long", start, finish=True)


def links(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``radius``.

    ``values`` has the distinct fingerprints in ``fp``.
    """
    found: list[DataFrame] = []
    members, keys = values.select("fp"), []
    for level in range(levels):
        t, k = f"t{level}", f"k{level}"
        tables = F.array(
            *[
                F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                for i, m in enumerate(masks(radius, level))
            ]
        )
        rows = members.select(*keys, "fp", F.explode(tables).alias("_x")).select(
            *keys, F.col("_x.t").alias(t), F.col("_x.k").alias(k), "fp"
        )
        keys = [*keys, t, k]
        buckets = stage(
            rows.groupBy(*keys)
            .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .where("n > 1"),
            "buckets",
        )
        pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        found.append(pairs.select("a", "b"))
        more = buckets.where("n > 2").agg(F.count("*"), F.max("n")).first()
        if not more[0]:
            break
        small = rows.join(buckets.where(f"n > 2 and n <= {bucket}").select(*keys), keys)
        found.append(_stars_by_group(small, keys, radius))
        if more[1] <= bucket:
            break
        members = stage(rows.join(buckets.where(f"n > {bucket}").select(*keys), keys), "members")
    else:
        found.append(_block_links(members, keys, radius, bucket))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct()


def _block_links(members: DataFrame, keys: list[str], radius: int, bucket: int) -> DataFrame:
    """Links of buckets too large for one task, compared in pairs of blocks.

    A bucket of n members has p = n / block blocks by hash; each member goes to the p
    cells that pair its block with another, so a cell holds about two blocks.
    """
    sizes = members.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(bucket // 2)).alias("_p"))
    placed = members.join(sizes, keys).withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_p")))
    cells = placed.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p") - 1))).select(
        *keys, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "fp"
    )
    return _stars_by_group(cells.distinct(), [*keys, "_i", "_j"], radius)


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the smallest node.

    Each round joins every node with its smallest neighbour, first over larger, then over
    smaller neighbours, and is written to the shared folder.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = state(current)
    for _ in range(most):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        large = stage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        current = stage(small, "small-star")
        now = state(current)
        if now == known:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def hex64(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id that links reach.  Null and empty texts have
    fingerprint zero and are linked like any other; repeated rows share their component;
    documents of a component that has no doc_id get null.  An empty table gives no rows.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    values = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(links(values, radius))
    rooted = values.join(roots, values.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return prints.join(named.select("fp", "component_id"), "fp").select(
        "doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; columns of ``docs``.

    Of rows that repeat that doc_id one stays.  Documents without a doc_id always stay.
    """
    kept = near_duplicates(docs, radius).where("doc_id = component_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.coalesce("text", F.lit(""))), "text")
    place = fresh(docs, "_first")[0]
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").withColumn(place, F.row_number().over(first))
    return named.where(F.col(place) == 1).select(*docs.columns).unionByName(docs.where("doc_id is null"))
