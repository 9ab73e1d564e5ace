import numpy as np
import pytest

from strandloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, white string, k string, v string, deviation string"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "x", "x", "x", "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors):
    """Exact integers, covariance and its eigenvectors, by numpy."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return x, n, s, y, values[::-1], vectors[:, ::-1]


def test_rows_equal_an_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12)) / 8).astype(np.float32)
    rows = W.whiten(table(spark, data.tolist())).toPandas()
    x, n, s, y, values, vectors = plain(data)
    assert sorted(rows.component.unique()) == list(range(1, 9)) and len(rows) == 500 * 8
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ vectors[:, :8] / np.sqrt(values[:8])
    want *= np.sign((got * want).sum(0))
    assert np.abs(got - want).max() < 1e-10
    explained = rows.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, values[:8] / values.sum(), rtol=1e-12)
    exact = dict(zip(range(n), ((n * x - s) ** 2).sum(1).tolist()))
    assert all(exact[r.vec_id] == r.deviation and r.n == n for r in rows.itertuples())
    assert rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-12


def test_unusable_vectors_leave_repeats_and_null_keys_stay(spark):
    good = [[0.5, 1.0], [1.5, -1.0], [1.5, -1.0], [0.25, 3.0]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [1.0, float("inf")], [float("-inf"), 0.0]]
    df = table(spark, good + bad, [None, 1, 1, 2, 3, 4, 5, 6, 7, 8])
    rows = W.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == sorted((i, c) for i in (0, 1, 1, 2) for c in (1, 2))
    assert {r.n for r in rows} == {4}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten_gives_no_rows(spark, vectors):
    out = W.whiten(table(spark, vectors))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_components_without_variance_are_left_out(spark):
    base = np.random.default_rng(2).normal(size=(40, 2))
    data = np.hstack([base, np.ones((40, 3))]).tolist()
    rows = W.whiten(table(spark, data)).collect()
    assert {r.component for r in rows} == {1, 2} and rows[0].identity_error < 1e-12


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="differ in length"):
        W.whiten(table(spark, [[1.0, 2.0], [1.0]]))


def test_large_entries_stay_exact(spark):
    data = [[float(i * 4000), float(-i)] for i in range(-5, 6)]
    rows = W.whiten(table(spark, data)).collect()
    x, n, s, *_ = plain(data)
    assert {r.vec_id: r.deviation for r in rows} == dict(enumerate(((n * x - s) ** 2).sum(1).tolist()))


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (7, 7), (8, 3), (33, 33)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    half = rng.normal(size=(d, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
    matrix = half @ half.T
    factor, order = W.pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12 * matrix.max())
    components, values = W.principal(matrix)
    want = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert len(values) <= rank and np.allclose(values, want, rtol=1e-8, atol=1e-13 * want[0])
    assert np.allclose(components @ components.T, np.eye(len(values)), atol=1e-10)
    assert (np.diff(values) <= 0).all()


@pytest.mark.parametrize("count", [1, 2, 3, 6, 7])
def test_rounds_meet_every_pair_once(count):
    pairs = []
    for p, q in W._rounds(count):
        used = np.concatenate([p, q])
        assert len(set(used.tolist())) == len(used)
        pairs += [tuple(sorted(x)) for x in zip(p.tolist(), q.tolist())]
    assert sorted(pairs) == [(i, j) for i in range(count) for j in range(i + 1, count)]
