"""Least-squares superposition and ring planes.

RMSDs and plane normals are closed forms in column expressions.  With ``S`` the cross
moment of two centred shapes, the largest sum of signed singular values is the largest
root of ``x^4 - 2 e x^2 - 8 det(S) x + e^2 - 4 |cof(S)|^2`` with ``e = |S|^2``; Newton
steps from half the total square reach it from above.

Rotations themselves need the singular vectors; they run on Arrow batches.  Coordinates
of those functions are flat arrays ``x0, y0, z0, x1, ...``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strandloom.functions import vectors as v

NEWTON_STEPS = 24
LEAST_SPREAD = 1e-7  # second singular value below which a ring is a line


def _batches(*series: pd.Series):
    """Row numbers and (rows, atoms, 3) arrays, one batch per atom count."""
    sizes = series[0].map(len).to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, [
            np.stack(s.iloc[rows].to_list()).astype(float).reshape(len(rows), -1, 3) for s in series
        ]


def fit(mobile: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-vector rotations of ``mobile`` onto ``target`` and the RMSDs left."""
    if mobile.shape != target.shape:
        raise ValueError(f"atom counts differ: {mobile.shape[1:]} and {target.shape[1:]}")
    a, b = (x - x.mean(axis=1, keepdims=True) for x in (mobile, target))
    left, sizes, right = np.linalg.svd(np.einsum("nai,naj->nij", a, b))
    # A mirror image is no rotation: the weakest direction is turned back.
    signs = np.ones((len(a), 3))
    signs[:, 2] = np.sign(np.linalg.det(left @ right))
    rest = (a * a + b * b).sum(axis=(1, 2)) - 2 * (sizes * signs).sum(axis=1)
    return (left * signs[:, None, :]) @ right, np.sqrt(np.maximum(rest, 0) / a.shape[1])


def _require_plane(ring: np.ndarray, name: str) -> None:
    spread = np.linalg.svd(ring - ring.mean(axis=-2, keepdims=True), compute_uv=False)
    if (spread[..., 1] < LEAST_SPREAD).any():
        raise ValueError(f"{name} ring coordinates are degenerate")


def ring_rotation(mobile: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rotation of one ring onto another; a ring on a line has no such rotation."""
    _require_plane(mobile, "source")
    _require_plane(target, "target")
    return fit(mobile[None], target[None])[0][0]


@F.pandas_udf(ArrayType(DoubleType()))
def superposing_rotation(mobile: pd.Series, target: pd.Series) -> pd.Series:
    out = np.empty((len(mobile), 9))
    for rows, (a, b) in _batches(mobile, target):
        _require_plane(a, "source")
        _require_plane(b, "target")
        out[rows] = fit(a, b)[0].reshape(len(rows), 9)
    return pd.Series(list(out))


@F.pandas_udf(ArrayType(DoubleType()))
def plane_rotation(mobile: pd.Series, target: pd.Series) -> pd.Series:
    """As ``superposing_rotation``, but null where a ring is missing or lies on a line."""
    out: list = [None] * len(mobile)
    sizes = [[-1 if x is None else len(x) for x in ring] for ring in (mobile, target)]
    there = mobile.notna().to_numpy() & target.notna().to_numpy() & np.equal(*sizes)
    kept = np.flatnonzero(there)
    for rows, (a, b) in _batches(mobile.iloc[kept], target.iloc[kept]):
        planes = np.ones(len(rows), bool)
        for ring in (a, b):
            # Most often all rows have one reference ring.
            ring = ring[:1] if (ring == ring[:1]).all() else ring
            finite = np.isfinite(ring).all(axis=(1, 2))
            spread = np.linalg.svd(
                np.where(finite[:, None, None], ring - ring.mean(axis=1, keepdims=True), 0.0), compute_uv=False
            )
            planes &= finite & (spread[:, 1] >= LEAST_SPREAD)
        turns = fit(a[planes], b[planes])[0].reshape(-1, 9)
        for at, turn in zip(kept[rows[planes]].tolist(), turns.tolist()):
            out[at] = turn
    return pd.Series(out, dtype=object)


def with_superposed_rmsd(df: DataFrame, mobile: str, target: str, name: str) -> DataFrame:
    """``df`` with the RMSD of two columns of [x, y, z] arrays after superposition."""
    columns = df.columns
    same = F.when(F.size(mobile) == F.size(target), F.col(mobile)).otherwise(
        F.raise_error(F.lit("atom counts differ"))
    )
    step = df.withColumns({"_pm": v.centroid(F.col(mobile)), "_pt": v.centroid(F.col(target))}).withColumns(
        {"_pa": v.centred(same, F.col("_pm")), "_pb": v.centred(F.col(target), F.col("_pt"))}
    )
    step = step.select(
        *columns,
        F.size(mobile).alias("_pn"),
        ((v.square_sum(F.col("_pa")) + v.square_sum(F.col("_pb"))) / 2.0).alias("_pe"),
        v.cross_moment(F.col("_pa"), F.col("_pb")).alias("_ps"),
    )
    s = [F.get("_ps", F.lit(k)) for k in range(9)]
    step = step.select(*columns, "_pn", "_pe", *[x.alias(f"_p{k}") for k, x in enumerate(s)])
    s = [F.col(f"_p{k}") for k in range(9)]
    cofactor = [
        s[(i + 1) % 3 * 3 + (j + 1) % 3] * s[(i + 2) % 3 * 3 + (j + 2) % 3]
        - s[(i + 1) % 3 * 3 + (j + 2) % 3] * s[(i + 2) % 3 * 3 + (j + 1) % 3]
        for i in range(3)
        for j in range(3)
    ]
    step = step.select(
        *columns, "_pn", "_pe",
        v.dot(s, s, 9).alias("_pq"),
        v.dot(s[:3], cofactor[:3]).alias("_pd"),
        v.dot(cofactor, cofactor, 9).alias("_pc"),
    )
    step = step.select(
        *columns, "_pn", "_pe",
        (F.col("_pq") * -2.0).alias("_p2"),
        (F.col("_pd") * -8.0).alias("_p1"),
        (F.col("_pq") * F.col("_pq") - F.col("_pc") * 4.0).alias("_p0"),
        F.col("_pe").alias("_px"),
    )
    x = F.col("_px")
    value = ((x * x + F.col("_p2")) * x + F.col("_p1")) * x + F.col("_p0")
    slope = (x * x * 4.0 + F.col("_p2") * 2.0) * x + F.col("_p1")
    for _ in range(NEWTON_STEPS):
        step = step.withColumn("_px", F.when(slope > 0, x - value / slope).otherwise(x))
    rest = F.greatest(F.col("_pe") - x, F.lit(0.0)) * 2.0
    return step.select(*columns, F.sqrt(rest / F.col("_pn")).alias(name))


def with_plane_normal(df: DataFrame, ring: str, name: str) -> DataFrame:
    """``df`` with the unit normal of a flat ring, on the side its first atoms go round.

    The normal is the direction of least scatter: the eigenvalue comes from the cosine
    form of the cubic, the vector from the rows of what is left of the scatter.
    """
    columns = df.columns
    centre = [v.flat_axis_mean(F.col(ring), k) for k in range(3)]

    def along(k: int) -> Column:
        atoms = F.sequence(F.lit(0), (F.size(ring) / 3).cast("int") - 1)
        return F.transform(atoms, lambda n: F.get(F.col(ring), n * 3 + k) - F.col(f"_nc{k}"))

    step = df.select(*columns, *[c.alias(f"_nc{k}") for k, c in enumerate(centre)])
    step = step.select(*columns, *[along(k).alias(f"_na{k}") for k in range(3)])

    def moment(i, j):
        return F.aggregate(F.zip_with(f"_na{i}", f"_na{j}", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)

    places = {(i, j): f"_nm{i}{j}" for i in range(3) for j in range(i, 3)}
    atom = [[F.get(f"_na{k}", F.lit(n)) for k in range(3)] for n in range(3)]
    ahead = [[atom[n + 1][k] - atom[n][k] for k in range(3)] for n in range(2)]
    step = step.select(
        *columns, *[moment(i, j).alias(n) for (i, j), n in places.items()],
        *[c.alias(f"_nt{k}") for k, c in enumerate(v.cross(*ahead))],
    )
    m = {(i, j): F.col(places[min(i, j), max(i, j)]) for i in range(3) for j in range(3)}
    mean = (m[0, 0] + m[1, 1] + m[2, 2]) / 3.0
    off = m[0, 1] * m[0, 1] + m[0, 2] * m[0, 2] + m[1, 2] * m[1, 2]
    size = F.sqrt((sum(((m[k, k] - mean) * (m[k, k] - mean) for k in (1, 2)), (m[0, 0] - mean) * (m[0, 0] - mean)) + off * 2.0) / 6.0)
    step = step.withColumns({"_nq": mean, "_nw": size})
    b = {k: (c - F.col("_nq") if k[0] == k[1] else c) / F.col("_nw") for k, c in m.items()}
    det = v.dot([b[0, k] for k in range(3)], v.cross([b[1, k] for k in range(3)], [b[2, k] for k in range(3)]))
    angle = F.acos(F.least(F.greatest(det / 2.0, F.lit(-1.0)), F.lit(1.0))) / 3.0
    step = step.withColumn("_nl", F.col("_nq") + F.col("_nw") * F.cos(angle + 2.0 * math.pi / 3.0) * 2.0)
    rows = [[m[i, j] - F.col("_nl") if i == j else m[i, j] for j in range(3)] for i in range(3)]
    crossed = [v.cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    step = step.withColumn(
        "_nx",
        F.array_max(F.array(*[F.struct(v.dot(c, c).alias("n"), F.array(*c).alias("v")) for c in crossed])),
    )
    towards = v.dot(F.col("_nx.v"), [F.col(f"_nt{k}") for k in range(3)])
    scale = F.when(
        F.col("_nx.n") > F.lit(1e-24) * F.pow(F.col("_nq"), 4), F.signum(towards) / F.sqrt(F.col("_nx.n"))
    ).otherwise(F.raise_error(F.lit("ring coordinates are degenerate")))
    return step.withColumn("_ns", scale).select(
        *columns, F.transform("_nx.v", lambda c: c * F.col("_ns")).alias(name)
    )
