"""Quality rules: document statistics and gradient-boosted trees in numpy node arrays.

Trees are grown level by level on binned statistics with Newton steps of the logistic
loss.  A statistic may be constrained: a split of it must order its sides, and every node
below keeps within the bounds its ancestors' splits have set, so that a document's score
never rises (or falls) with that statistic.  All trees lie in one set of arrays and a
batch of documents walks them level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded, map_batches, utf8
from strandloom.staging import stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_SPACE_AND_TAILS = bytes([32, *range(9, 14), *range(0x80, 0xC0)])
_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(1, 2**62, WINDOW, dtype=np.int64) * 2 + 1

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistics of the trees and their constraint: -1, quality never rises with it; 1, never falls.
FEATURES = {
    "symbols_per_word": -1,
    "repeat_share": -1,
    "dup_line_share": -1,
    "upper_share": -1,
    "mark_share": -1,
    "mean_word_chars": 0,
    "distinct_share": 0,
    "log_words": 0,
    "digit_share": 0,
    "stop_share": 0,
    "words_per_line": 0,
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside ``window``-word runs that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    rolled = np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for j in range(window):
            rolled += codes[j : j + n] * _FACTORS[j]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    seen: dict[tuple, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(np.isin(rolled, twice)).tolist():
        run = tuple(words[i : i + window])
        first = seen.setdefault(run, i)
        if first != i:
            for k in (first, i) if first >= 0 else (i,):
                hit[k] += 1
                hit[min(k + window, len(words))] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the tree statistics of a text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE_AND_TAILS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    some = max(n, 1)
    upper = len(text) - len(text.translate(None, _UPPER))
    lower = len(text) - len(text.translate(None, _LOWER))
    marks = len(text) - len(text.translate(None, b"!?"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    short = sum(1 for w in words if len(w) < 4)
    return [n, chars, symbols, dup, repeat], [
        symbols / some,
        repeat / some,
        dup / max(len(lines), 1),
        upper / max(upper + lower, 1),
        marks / some,
        chars / some,
        len(set(words)) / some,
        float(np.log1p(n)),
        digits / max(chars, 1),
        short / some,
        n / max(len(lines), 1),
    ]


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and ``stats``, the tree statistics in the order of FEATURES."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            found = [statistics(t) for t in utf8(batch)]
            out = {name: [f[0][i] for f in found] for i, name in enumerate(BASE)}
            return out | {"doc_id": batch.column("doc_id"), "stats": [f[1] for f in found]}

        return step

    columns = ", ".join(f"{name} long" for name in BASE)
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, {columns}, stats array<double>", start)


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    l2: float = 2.0
    least: float = 1.0  # smallest sum of second derivatives of a leaf
    sample: int = 20_000  # labelled documents that are fitted, at most
    keep_above: float = 0.5


@dataclass
class Trees:
    """Node arrays of all trees: a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality of each row of ``x``."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


@dataclass
class _Grower:
    settings: Settings
    signs: np.ndarray
    edges: list[np.ndarray]
    nodes: list[list] = field(default_factory=list)

    def leaf(self, g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + self.settings.l2), low, high))

    def grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, out: np.ndarray) -> int:
        """Add a tree for these derivatives; ``out`` gets each row's value."""
        root = self._node(np.inf)
        todo = [(root, np.arange(len(g)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, depth = todo.pop()
            own = self.leaf(g[rows].sum(), h[rows].sum(), low, high)
            best = self._split(binned[rows], g[rows], h[rows], low, high) if depth < self.settings.depth else None
            if best is None:
                self.nodes[node][4] = own * self.settings.rate
                out[rows] = own * self.settings.rate
                continue
            f, cut, a, b = best
            goes = binned[rows, f] <= cut
            bounds = [(low, high), (low, high)]
            if self.signs[f]:
                middle = (a + b) / 2
                bounds = [(low, middle), (middle, high)] if self.signs[f] > 0 else [(middle, high), (low, middle)]
            sides = []
            for side, (lo, hi) in zip((rows[goes], rows[~goes]), bounds):
                sides.append(self._node(np.inf))
                todo.append((sides[-1], side, lo, hi, depth + 1))
            self.nodes[node][:4] = [f, float(self.edges[f][cut]), *sides]
        return root

    def _node(self, threshold: float) -> int:
        n = len(self.nodes)
        self.nodes.append([0, threshold, n, n, 0.0])
        return n

    def _split(self, binned, g, h, low, high):
        s, best, gain = self.settings, None, 1e-9
        total_g, total_h = g.sum(), h.sum()

        def worth(sum_g, sum_h, value):
            return -(sum_g * value + 0.5 * (sum_h + s.l2) * value * value)

        for f in range(binned.shape[1]):
            if not len(self.edges[f]):
                continue
            gl = np.cumsum(np.bincount(binned[:, f], g, s.bins))[: len(self.edges[f])]
            hl = np.cumsum(np.bincount(binned[:, f], h, s.bins))[: len(self.edges[f])]
            gr, hr = total_g - gl, total_h - hl
            vl = np.clip(-gl / (hl + s.l2), low, high)
            vr = np.clip(-gr / (hr + s.l2), low, high)
            ok = (hl >= s.least) & (hr >= s.least) & (self.signs[f] * (vr - vl) >= 0)
            own = worth(total_g, total_h, np.clip(-total_g / (total_h + s.l2), low, high))
            found = np.where(ok, worth(gl, hl, vl) + worth(gr, hr, vr) - own, -np.inf)
            cut = int(np.argmax(found))
            if found[cut] > gain:
                gain, best = float(found[cut]), (f, cut, float(vl[cut]), float(vr[cut]))
        return best


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], settings: Settings = Settings()) -> Trees | None:
    """Trees for labels 0 and 1, or None unless both occur."""
    if len(np.unique(y)) < 2:
        return None
    edges = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, settings.bins + 1)[1:-1]))
        edges.append(q[q < x[:, f].max()][: settings.bins - 1])
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    grower = _Grower(settings, np.array(signs), edges)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin, roots = np.full(len(y), base), []
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        roots.append(grower.grow(binned, p - y, p * (1 - p), out))
        margin += out
    f, t, left, right, v = (np.array(c) for c in zip(*grower.nodes))
    return Trees(f.astype(np.int32), t.astype(float), left, right, v.astype(float), np.array(roots), settings.depth, base)


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every document.

    Null and empty texts have no words and fail; repeated rows are judged alike; a
    document labelled twice counts with its lower quality.  The trees are fitted on at
    most ``sample`` labelled documents that pass the base rules; without both kinds of
    labels the base rules decide alone and the score is null.
    """
    stats = stage(document_statistics(docs), "statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded(stats.where(~failed).select("doc_id", "stats").join(known, "doc_id"), settings.sample, "doc_id")
    held = chosen.orderBy("doc_id").toArrow()
    x = np.array(held.column("stats").to_pylist(), float).reshape(held.num_rows, len(FEATURES))
    trees = fit(x, held.column("quality").to_numpy().astype(float), list(FEATURES.values()), settings)
    if trees is None:
        return stats.select(
            "doc_id", *BASE, failed.alias("base_failed"), F.lit(None).cast("double").alias("score"), (~failed).alias("kept")
        )
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    columns = stats.drop("stats").columns
    schema = stats.drop("stats").withColumn("score", F.lit(0.0)).schema

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            flat = batch.column("stats").flatten().to_numpy(zero_copy_only=False)
            return {c: batch.column(c) for c in columns} | {"score": sent.value.score(flat.reshape(-1, len(FEATURES)))}

        return step

    scored = map_batches(stats, schema, start)
    return scored.select(
        "doc_id",
        *BASE,
        failed.alias("base_failed"),
        "score",
        (~failed & (F.col("score") >= settings.keep_above)).alias("kept"),
    )
