"""Components of documents whose sets of word shingles have a high Jaccard similarity.

A size-aware heavy-light join.  For similarity ``percent`` a set of ``n`` shingles shares at
least ``need(n) = ceil(n * percent / 100)`` of them with any partner, so two partners share
``k`` among the first ``n - need(n) + k`` of each in any common order.

* First pass, in hash order: sets without enough shared shingles among their first ones have
  no partner.  This settles nearly all documents of a corpus and shuffles a part of the sets.
* The sets left are ordered with the rarest shingles first.  Small sets are met by subsets:
  every ``SUBSET`` shingles of the first ones make a key.  Large sets scan the inverted lists
  of their first shingles, in which small sets stand as well.  The size that divides them is
  the one with the least cost, keys made below it and list entries scanned above it.
* A key or list is a bucket; of buckets with the same members one is left.  Members are
  compared in tasks, on 1,024-bit parity sketches, whose distance is never above the true
  difference; candidates are decided on the whole sets.  For some rounds each set names
  its nearest one of another component in its largest buckets only, which joins large
  groups by few pairs; then all pairs of members that are still in different components
  follow, in all buckets.

No link is lost and no bucket is expanded into all its pairs.  Shingles are 64-bit hashes and
sets are told apart by 128 bits and their size, so unequal ones are taken as equal with a
chance near 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import LOWER, map_batches, to_unique, utf8
from strandloom.staging import bounded_broadcast, dense_ids, row_bound, stage, with_bound

WORDS = 5
PERCENT = 80
SUBSET = 2
ROUNDS = 1  # in which sets name their nearest one, before all pairs that are left
LARGEST = 2  # buckets that a set looks for its nearest one in
KEY_COST = 200  # list entries looked at in the time that a subset is shuffled and grouped, as measured
BLOCK = 1024  # members of a bucket that one task compares with as many others
FEW = 1_000_000  # sets sent to all tasks at once, 40 bytes each; more are joined by a shuffle
PAIRS = 200_000  # pairs of members that one task looks at together
COMMON = 1_000_000  # sets of a shingle from which it is sent to all tasks
_SKETCH = 1024
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> _HALF)) * _MIX
    return h ^ (h >> _HALF)


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; all its words if they are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _STEP + hashed[i : len(hashed) - size + 1 + i]
    return np.unique(_mixed(out))


def _need(n, percent: int):
    return -(-n * percent // 100)


def _surplus(n):
    """How many shared shingles the first pass asks of a set of ``n``."""
    return np.maximum(1, n // 10)


def _digest(items: np.ndarray) -> tuple[int, int]:
    return tuple(np.array([_mixed(items * a).sum() for a in (_STEP, _MIX)], np.uint64).view(np.int64).tolist())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(ends, flat)


def _first_pass(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, hash of the text, number of shingles, digest of the set and its first shingles."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def start():
        def step(batch):
            sets = [shingles(x, size) for x in utf8(batch)]
            n = np.array([len(s) for s in sets], np.int64)
            most = n - _need(n, percent) + _surplus(n)
            digests = [_digest(s) for s in sets]
            return {
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "n": n,
                "d1": [d[0] for d in digests],
                "d2": [d[1] for d in digests],
                "first": _lists([s[:m] for s, m in zip(sets, most)]),
            }

        return step

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = f"doc_id {key}, text_hash long, n long, d1 long, d2 long, first array<long>"
    return stage(map_batches(rows, schema, start), "first-shingles")


def _counted(entries: DataFrame, counts: DataFrame, rows: int) -> DataFrame:
    """``entries`` (h, ...) with ``df`` from ``counts`` (h, df), inner.

    The most common shingles, of which there are at most ``rows / COMMON`` and 20,000, go
    to all tasks, so that no task gets all entries of one.
    """
    cut = max(COMMON, rows // 20_000)
    hot = F.broadcast(counts.where(F.col("df") >= cut))
    rest = entries.join(hot.select("h"), "h", "left_anti").join(counts.where(F.col("df") < cut), "h")
    return entries.join(hot, "h").unionByName(rest)


def _alive(found: DataFrame, percent: int) -> DataFrame:
    """One row per distinct set that may have a partner: number g, digest, hash of a text of it."""
    need = F.ceil(F.col("n") * percent / 100)
    sets = found.where("n > 1").select("d1", "d2", "n", "text_hash", F.explode("first").alias("h"))
    counts = stage(sets.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common-first")
    rows = found.agg(F.sum(F.col("n") - need + F.greatest(F.lit(1), F.floor(F.col("n") / 10)))).first()[0] or 0
    # Copies count one by one here, which only lets more sets pass.
    asked = F.greatest(F.lit(1), F.floor(need / 10))
    hits = _counted(sets, counts, rows).groupBy("d1", "d2", "n", "text_hash").agg(F.count("*").alias("hits"))
    one = hits.where(F.col("hits") >= asked).groupBy("d1", "d2", "n").agg(F.min("text_hash").alias("text_hash"))
    return stage(dense_ids(one, ["d1", "d2", "n"], "g", "alive"), "alive-sets")


def _whole_sets(docs: DataFrame, alive: DataFrame, size: int) -> DataFrame:
    """g, n, all shingles and parity sketch of the sets that are left."""
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    few = bounded_broadcast(alive, FEW)
    found = texts.join(few, "text_hash") if few is not alive else to_unique(texts, alive, ["text_hash"])

    def start():
        def step(batch):
            sets = [shingles(x, size) for x in utf8(batch)]
            bits = [np.packbits(np.bincount((s % _SKETCH).astype(int), minlength=_SKETCH) & 1 == 1).tobytes() for s in sets]
            right = [
                (len(s), *_digest(s)) == known
                for s, known in zip(sets, zip(*[batch.column(c).to_pylist() for c in ("n", "d1", "d2")]))
            ]
            return {"g": batch.column("g"), "n": batch.column("n"), "items": _lists(sets), "sketch": bits, "right": right}

        return step

    schema = "g long, n long, items array<long>, sketch binary, right boolean"
    sets = map_batches(found.dropDuplicates(["g", "text"]), schema, start)
    return stage(sets.where("right").drop("right"), "sets")


def _ranked(sets: DataFrame, percent: int) -> DataFrame:
    """g, n, number ``scan`` of first shingles and those first ones, one more, rarest first.

    Shingles of no other set come first of all and are left out; sets that share too few
    shingles have no partner.
    """
    entries = sets.select("g", F.explode("items").alias("h"))
    counts = stage(entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common")
    shared = _counted(entries, counts, sets.agg(F.sum("n")).first()[0] or 0).groupBy("g")
    rows = shared.agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("items"))
    rows = rows.join(sets.select("g", "n"), "g").withColumn(
        "scan", (F.size("items") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    )
    first = F.slice("items", F.lit(1), F.col("scan") + SUBSET - 1)
    return stage(rows.where("scan > 0").select("g", "n", "scan", first.alias("first")), "ranked")


def boundary(ranked: DataFrame) -> int:
    """Largest size of the sets that are met by subsets: the one with the least total cost.

    A set costs its number of subsets, ``KEY_COST`` each, below the boundary, and the entries
    of the lists of its first shingles above it.  Sizes are weighed in steps of a tenth.
    """
    step = F.ceil(F.log2("n") * 8).cast("int")
    firsts = F.size("first")
    lists = F.aggregate(F.slice("first", F.lit(1), F.col("scan")), F.lit(0).cast("long"), lambda a, x: a + x.df)
    rows = (
        ranked.groupBy(step.alias("step"))
        .agg(
            F.max("n").alias("n"),
            F.sum(firsts * (firsts - 1) / 2 * KEY_COST).alias("subsets"),
            F.sum(lists.cast("double")).alias("lists"),
        )
        .orderBy("step")
        .collect()
    )
    best = cost = sum(r.lists for r in rows)
    size = 0
    for r in rows:
        cost += r.subsets - r.lists
        if cost < best:
            best, size = cost, r.n
    return size


def _buckets(ranked: DataFrame, small: int) -> DataFrame:
    """Members (a, b, g, n, scans) of buckets; two are compared if one of them scans."""
    light = ranked.where(F.col("n") <= small)
    pairs = light.select("g", "n", F.posexplode(F.transform("first", lambda x: x.h)).alias("i", "a"), "first").select(
        "a", F.explode(F.transform(F.slice("first", F.col("i") + 2, F.size("first")), lambda x: x.h)).alias("b"), "g", "n"
    )
    lists = ranked.select("g", "n", F.explode(F.slice("first", F.lit(1), F.col("scan"))).alias("x"))
    lists = lists.select(F.col("x.h").alias("a"), F.col("x.h").alias("b"), "g", "n", (F.col("n") > small).alias("scans"))
    members = stage(pairs.withColumn("scans", F.lit(True)).unionByName(lists), "members")
    sums = [F.bit_xor(F.xxhash64(*c)).alias(f"s{i}") for i, c in enumerate((("g", "scans"), ("scans", "g")))]
    of = members.groupBy("a", "b").agg(F.count("*").alias("size"), F.max("scans").alias("any"), *sums)
    one = of.where("size > 1 and any").groupBy("size", "s0", "s1").agg(F.min(F.struct("a", "b")).alias("x"))
    kept = stage(one.select("x.a", "x.b", "size"), "buckets")
    return stage(to_unique(members, kept, ["a", "b"]), "bucket-members")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = stage(pairs.distinct(), "candidates")
    left = sets.select(F.col("g").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("g").alias("b"), F.col("items").alias("ib"))
    both = with_bound(to_unique(pairs, right, ["b"]), row_bound(pairs))
    both = to_unique(both, left, ["a"])
    shared = F.size(F.array_intersect("ia", "ib"))
    return stage(
        both.where(shared * 100 >= (F.size("ia") + F.size("ib") - shared) * percent).select("a", "b"), "similar"
    )


def components(links: DataFrame) -> DataFrame:
    """(g, label) of all sets in ``links`` (a, b); the label is the smallest set of the component.

    Labels only fall, from neighbours and from the label's own label, until none does.
    """
    ways = links.select(F.col("a").alias("g"), F.col("b").alias("to"))
    edges = stage(ways.unionByName(ways.select(F.col("to").alias("g"), F.col("g").alias("to"))).distinct(), "edges")
    labels = stage(edges.groupBy("g").agg(F.least(F.col("g"), F.min("to")).alias("label")), "labels")
    while True:
        near = to_unique(edges, labels.select(F.col("g").alias("to"), "label"), ["to"])
        near = near.groupBy("g").agg(F.min("label").alias("near"))
        met = stage(labels.join(near, "g").select("g", F.col("label").alias("was"), F.least("label", "near").alias("label")), "met")
        further = met.select(F.col("g").alias("label"), F.col("label").alias("next"))
        jumped = stage(to_unique(met, further, ["label"]).select("g", "was", F.col("next").alias("label")), "labels")
        labels = with_bound(jumped.select("g", "label"), row_bound(jumped))
        if not jumped.where("label <> was").limit(1).count():
            return labels


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """Members of buckets that more than one component meets in, with their label."""
    rows = members.withColumn("label", F.col("g"))
    if links is not None:
        # A set is in no more buckets than its text has shingles and pairs of first ones.
        rows = members.join(components(links), "g", "left").withColumn("label", F.coalesce("label", "g"))
    rows = stage(rows.select("a", "b", "g", "n", "scans", "size", "label"), "labelled")
    mixed = rows.groupBy("a", "b").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("a", "b")
    return stage(to_unique(rows, mixed, ["a", "b"]), "mixed")


def _cells(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Members in order of their cell (a, b, i, j) and label.

    A bucket is cut into blocks by hash, and a cell pairs two blocks or one with itself.
    """
    rows = rows.join(sets.select("g", "sketch"), "g")
    rows = rows.withColumn("_cuts", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("g"), F.col("_cuts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
    low, high = F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j")
    cells = rows.select("a", "b", low, high, "own", "g", "label", "n", "scans", "sketch")
    return cells.repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "label")


def _followers(cut: np.ndarray, runs: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same cell but not of the same run, in portions.

    ``cut`` has where cells begin, ``runs`` where runs do; every cell begins a run.
    """
    ends, following = (np.repeat(np.append(c[1:], size), np.diff(np.append(c, size))) for c in (cut, runs))
    after = ends - following
    total = np.cumsum(after)
    at = 0
    while at < size:
        stop = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS)), at + 1)
        left = np.repeat(np.arange(at, stop), after[at:stop])
        first = np.cumsum(after[at:stop]) - after[at:stop]
        yield left, following[left] + np.arange(len(left)) - np.repeat(first, after[at:stop])
        at = stop


def _candidates(rows: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of members of one bucket, but of two components, that may be similar.

    With ``nearest`` only the largest buckets of each set are used, and only the one of
    every member that is nearest by sketch.
    """
    names = ["a", "b", "i", "j"]
    if nearest:
        largest = Window.partitionBy("g").orderBy(F.desc("size"), "a", "b")
        rows = rows.withColumn("_rank", F.row_number().over(largest)).where(F.col("_rank") <= LARGEST).drop("_rank")

    def start():
        held: list[pa.RecordBatch] = []

        def compared(table: pa.Table, cut: np.ndarray, crossed: np.ndarray) -> np.ndarray:
            g, label, n, own = (table[c].to_numpy() for c in ("g", "label", "n", "own"))
            runs = np.union1d(cut, np.flatnonzero(label[1:] != label[:-1]) + 1)
            scans = table["scans"].to_numpy()
            bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(g), -1)
            found = []
            for x, y in _followers(cut, runs, len(g)):
                ok = (scans[x] | scans[y]) & (~crossed[x] | (own[x] != own[y]))
                ok &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
                x, y = x[ok], y[ok]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                # |A - B| + |B - A| <= (n + m) * (100 - p) / (100 + p) for similar sets
                near = apart * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
                found.append(np.stack([x[near], y[near], apart[near]], 1))
            pairs = np.concatenate(found)
            if nearest and len(pairs):
                pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
                firsts = [np.unique(pairs[:, side], return_index=True)[1] for side in (0, 1)]
                pairs = pairs[np.unique(np.concatenate(firsts))]
            return np.unique(np.sort(np.stack([g[pairs[:, 0]], g[pairs[:, 1]]], 1), 1), axis=0)

        def step(batch: pa.RecordBatch | None) -> dict | None:
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or batch is not None and sum(b.num_rows for b in held) < 8 * BLOCK:
                return None
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table[c].to_numpy() for c in names], 1)
            cut = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            held.clear()
            size = table.num_rows
            if batch is not None:  # the open cell waits
                size = int(cut[-1])
                cut = cut[:-1]
                held.extend(table.slice(size).to_batches())
            if not size:
                return None
            pairs = compared(table.slice(0, size), cut, keys[:size, 2] != keys[:size, 3])
            return {"a": pairs[:, 0], "b": pairs[:, 1]} if len(pairs) else None

        return step

    return map_batches(_cells(rows, sets), "a long, b long", start, finish=True)


def similar_sets(docs: DataFrame, found: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets with a number, their labels): the components of distinct sets that have links."""
    alive = _alive(found, percent)
    sets = _whole_sets(docs, alive, size)
    ranked = _ranked(sets, percent)
    members = _buckets(ranked, boundary(ranked))
    links = None
    for number in range(ROUNDS + 1):
        rows = _labelled(members, links)
        new = _linked(_candidates(rows, sets, percent, number < ROUNDS), sets, percent)
        links = new if links is None else links.unionByName(new)
    return alive, components(links)


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable) of every document.

    Two documents are linked when their sets of ``size``-word shingles share ``percent`` of
    their union.  A text of fewer words is one shingle; null, empty and blank texts have an
    empty set and are linked with nothing, so they get their own doc_id.  Texts are used
    whole.  Repeated rows share their component; a component without any doc_id gets null.
    An empty table gives no rows; other columns are ignored.  Below 51 percent subsets of
    two shingles would not be shared by all partners; that is an error.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    found = _first_pass(docs, size, percent)
    alive, labels = similar_sets(docs, found, size, percent)
    key = ["d1", "d2", "n"]
    sets = found.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("least"))
    numbered = alive.select(*key, "g").join(labels, "g")
    sets = stage(sets.join(numbered, key, "left").select(*key, "least", "label"), "distinct-sets")
    linked = with_bound(sets.where("label is not null"), row_bound(sets))
    joint = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    named = to_unique(linked, joint, ["label"]).select(*key, "component_id")
    # Sets without links are most sets and need no join.
    named = named.unionByName(sets.where("label is null").select(*key, F.col("least").alias("component_id")))
    rows = with_bound(found.select("doc_id", *key), row_bound(found))
    return to_unique(rows, named, key, "left_outer").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
