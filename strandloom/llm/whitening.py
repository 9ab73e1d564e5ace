"""Whitening of embedding vectors: pivoted Cholesky, then one-sided Jacobi on the factor.

Entries become integers first, so that counts, sums and scatter are exact whatever the
partitions.  The scatter is taken about the whole numbers below the means; the rest of the
shift, under one unit, is removed exactly afterwards.  The covariance is factored as
``L L'`` with the largest remaining variance first.  Rotations then make the columns of
``L`` orthogonal: their squared norms are the eigenvalues, and their directions the
components.

Spark sums over the vectors; only sums of ``d`` and ``d * d / 2`` numbers reach the driver,
``d`` being the length of the vectors, which does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import map_batches
from strandloom.staging import stage

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
_FAR = 1 << 26  # units from the mean; exact sums and the long of the deviation end about there
_EXACT = 1 << 53
_FULL = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learned: ``components`` has one unit vector a row, ``values`` their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``matrix[order][:, order] = L L'``; L has as many columns as the rank."""
    a = np.array(matrix, float)
    d = len(a)
    order, left, factor = np.arange(d), a.diagonal().copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.max(initial=0), 0)
    for k in range(d):
        m = k + int(np.argmax(left[k:]))
        if left[m] <= least:
            return factor[:, :k], order
        if m != k:
            for rows in (order, left, factor, a):
                rows[[k, m]] = rows[[m, k]]
            a[:, [k, m]] = a[:, [m, k]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which every pair of 0..count-1 meets once."""
    seats = list(range(count + count % 2))
    half, out = len(seats) // 2, []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:half], seats[half:][::-1]) if max(a, b) < count]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` rotated among each other until all are orthogonal."""
    rows = np.ascontiguousarray(factor.T)
    close = np.finfo(float).eps * max(len(factor), 1) ** 0.5
    rounds = _rounds(len(rows)) if len(rows) > 1 else []
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            a, b = rows[p], rows[q]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            turn = np.abs(ab) > close * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            p, q, a, b, aa, bb, ab = p[turn], q[turn], a[turn], b[turn], aa[turn], bb[turn], ab[turn]
            z = (bb - aa) / (2 * ab)
            t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            c, s = c[:, None], (c * t)[:, None]
            rows[p], rows[q] = c * a - s * b, s * a + c * b
        if not turned:
            return rows.T
    raise RuntimeError(f"columns are not orthogonal after {sweeps} sweeps")


def principal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, eigenvalues) of a covariance, largest first, zero ones left out."""
    factor, order = pivoted_cholesky(matrix)
    rows = orthogonal_columns(factor).T
    values = (rows * rows).sum(1)
    falling = np.argsort(-values, kind="stable")
    out = np.zeros((len(rows), len(matrix)))
    out[:, order] = rows[falling] / np.sqrt(values[falling])[:, None]
    return out, values[falling]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of at least one entry and only finite entries."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~bad)


def _integers(batch: pa.RecordBatch, column: str, length: int) -> np.ndarray:
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != (length or lengths[0])).any():
        raise ValueError("vectors differ in length")
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = np.floor(SCALE * values) + OFFSET
    if np.abs(x).max() >= _EXACT:
        raise ValueError("an entry is too large for exact sums")
    return x.astype(np.int64).reshape(len(lengths), -1)


def _added(vectors: DataFrame, vector: str, schema: str, start: Callable) -> DataFrame:
    return map_batches(vectors.select(F.col(vector).alias("v")), schema, start, finish=True)


def _sums(vectors: DataFrame, vector: str) -> tuple[int, list[int]]:
    def start():
        n, held = 0, None

        def step(batch):
            nonlocal n, held
            if batch is None:
                if held is None:
                    return None
                return {"i": list(range(len(held))), "s": [Decimal(s) for s in held], "n": [n] * len(held)}
            if batch.num_rows:
                x = _integers(batch, "v", len(held or ()))
                added = x.sum(0, dtype=object) if np.abs(x).max() * len(x) >= _FULL else x.sum(0).tolist()
                n, held = n + len(x), [a + int(b) for a, b in zip(held or [0] * x.shape[1], added)]
            return None

        return step

    parts = _added(vectors, vector, "i int, s decimal(38,0), n long", start)
    rows = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    return (rows[0].n if rows else 0), [int(r.s) for r in rows]


def _scatter(vectors: DataFrame, vector: str, centre: np.ndarray) -> list[tuple[int, int, int]]:
    """Upper triangle of the sums of products about ``centre``."""
    upper = np.triu_indices(len(centre))

    def start():
        held, bound = np.zeros((len(centre),) * 2, np.int64), 0

        def flush():
            nonlocal held, bound
            out = {"i": upper[0], "j": upper[1], "v": held[upper]} if bound else None
            held, bound = np.zeros_like(held), 0
            return out

        def step(batch):
            nonlocal held, bound
            if batch is None:
                return flush()
            if not batch.num_rows:
                return None
            z = _integers(batch, "v", len(centre)) - centre
            far = int(np.abs(z).max())
            if far >= _FAR:
                raise ValueError("an entry is too far from its mean for exact sums")
            most = far * far * len(z)
            out = flush() if bound + most >= _FULL else None
            bound += most + 1
            held += z.T @ z if most >= _EXACT else (z.T.astype(float) @ z.astype(float)).astype(np.int64)
            return out

        return step

    parts = _added(vectors, vector, "i int, j int, v long", start)
    total = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return [(r.i, r.j, int(r.v)) for r in total.collect()]


def fit(vectors: DataFrame, vector: str = "embedding", components: int | None = None) -> Whitening | None:
    """Mean and principal components of all usable vectors; None if there are none."""
    rows = usable(vectors, vector)
    n, sums = _sums(rows, vector)
    if not n:
        return None
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    covariance = np.zeros((len(sums),) * 2)
    trace = 0
    for i, j, v in _scatter(rows, vector, np.array(centre, np.int64)):
        exact = n * v - rest[i] * rest[j]
        covariance[i, j] = covariance[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    found, values = principal(covariance)
    return Whitening(n, sums, found[:components], values[:components], trace / (n * n))


def transform(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Key, deviation and whitened coordinates (an array, one per component) of usable vectors.

    ``deviation`` is the exact squared distance from the mean, times ``n * n``; an error is
    raised where it does not fit a long.  Other columns of ``vectors`` are ignored.
    """
    n, sums, components, values = model.n, model.sums, model.components, model.values
    rows = usable(vectors, vector).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    key_type = rows.schema["k"].dataType.simpleString()

    def start():
        mean = np.array([s / n for s in sums])
        turned = components.T / np.sqrt(values)

        def step(batch):
            if not batch.num_rows:
                return None
            x = _integers(batch, "v", len(sums))
            spread = max(n * int(x.max()) - min(sums), max(sums) - n * int(x.min()), 1)
            if spread * spread * len(sums) < _FULL:
                y = n * x - np.array(sums)
                deviation = (y * y).sum(1)
            else:
                y = n * x.astype(object) - np.array(sums, object)
                deviation = [int(v) for v in (y * y).sum(1)]
            white = (x - mean) @ turned
            lists = pa.ListArray.from_arrays(
                np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], np.ascontiguousarray(white).ravel()
            )
            return {"k": batch.column("k"), "deviation": deviation, "white": lists}

        return step

    out = map_batches(rows, f"k {key_type}, deviation long, white array<double>", start)
    return out.withColumnRenamed("k", key)


def identity_error(white: DataFrame, components: int) -> float:
    """Largest entry of the covariance of ``white`` minus the identity."""
    w = [F.col("white")[i] for i in range(components)]
    means = white.agg(*[F.avg(c) for c in w]).first()
    centred = [c - F.lit(m) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = white.agg(*[F.avg(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector and component, with the figures of the fit.

    Vectors that are null, empty or hold null or non-finite entries are dropped; all others
    must have one length.  Rows without a key and repeated rows are kept as they are; further
    columns are ignored.  Components without variance have no whitened values and are left
    out, so equal vectors, one vector or an empty table give no rows.
    """
    model = fit(vectors, vector, components)
    if model is None or not len(model.values):
        empty = vectors.select(F.col(key)).limit(0)
        return empty.selectExpr(
            key, "0 as component", "0L as n", "0L as deviation", "0D as whitened", "0D as explained", "0D as identity_error"
        )
    white = stage(transform(vectors, model, key, vector), "whitened")
    error = identity_error(white, len(model.values))
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return white.select(key, "deviation", F.posexplode("white").alias("_i", "whitened")).select(
        key,
        (F.col("_i") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("_i")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
