"""Whitening against numpy's own eigenvectors, on hard small cases and on the given vectors."""

import numpy as np
import pytest

from runlens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, part string, v string, n int, deviation int"


def plain(vectors):
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    e = x * n - s
    c = e.astype(float) / n
    values, base = np.linalg.eigh(c.T @ c / n)
    return n, [int(d) for d in (e * e).sum(axis=1)], c, values[::-1], base[:, ::-1]


def agrees(rows, vectors, ids, k):
    """Rows hold the same whitened values as numpy's components, whose eigenvalues lie apart, up to one sign a component."""
    n, deviation, c, values, base = plain(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.component, {})[r.vec_id] = r
        assert r.n == n
    assert sorted(by) == list(range(1, k + 1))
    for j in range(k):
        want = c @ base[:, j] / np.sqrt(values[j])
        got = np.array([by[j + 1][i].whitened for i in ids])
        sign = np.sign(want @ got)
        assert np.abs(sign * got - want).max() < 1e-8
        assert [by[j + 1][i].deviation for i in ids] == deviation
        assert abs(by[j + 1][ids[0]].explained / (values[j] / values.sum()) - 1) < 1e-9
        assert by[j + 1][ids[0]].identity_error < 1e-9


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    agrees(queries.op11_whitening(spark, sf).collect(), t["embedding"], t["vec_id"].tolist(), 8)


def test_partitions_and_rank_do_not_matter(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 20)) * 2.0 ** -np.arange(20)
    v[300:400] = v[:100]
    rows = [(k, [float(c) for c in x]) for k, x in enumerate(v)]
    for parts, rank in ((1, 128), (19, 128), (3, 9), (11, 10)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        agrees(whitening.whiten(df, rank=rank).collect(), v, list(range(len(v))), 8)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.25, -2.0, 1e-9], [-3.5, 0.125, 4.0], [7.0, 7.0, -7.0], [1.0, 2.0, 0.5]]
    bad = [None, [], [None, 1.0, 2.0], [nan, 1.0, 2.0], [1.0, inf, 2.0], [1.0, 2.0], [1.0]]
    rows = [(k, v, 0, "p", "v", 1, 2) for k, v in enumerate(good + bad)] + [(0, good[0], 0, "p", "v", 1, 2), (None, good[1], 0, "p", "v", 1, 2)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 7 * 3 and sum(r.vec_id is None for r in got) == 3
    n, deviation, c, values, base = plain(good + [good[0], good[1]])
    want = np.abs(c @ base / np.sqrt(values))
    for r in got:
        k = 1 if r.vec_id is None else r.vec_id
        assert abs(abs(r.whitened) - want[k, r.component - 1]) < 1e-9 and r.deviation == deviation[k] and int(r.deviation_exact) == deviation[k]


@pytest.mark.parametrize("vectors, flat", [([[1.0, 2.0]], {1, 2}), ([[1.0, 2.0]] * 5, {1, 2}), ([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [3.0, 6.0, 9.0]], {2, 3})])
def test_zero_eigenvalues_give_null(spark, vectors, flat):
    got = whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(vectors) * len(vectors[0])
    assert all((r.whitened is None) == (r.component in flat) for r in got)
    assert all(r.identity_error is None or r.identity_error < 1e-12 for r in got)


def test_large_entries(spark):
    vectors = [[1e300, 0.0], [-1e300, 1.0], [5.0, 2.0]]
    got = whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r.deviation is None and r.deviation_exact is not None for r in got if r.vec_id < 2)


def test_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "p", "v", 1, 1)], SCHEMA)).count() == 0


def test_rank_one_updates(spark):
    """Against numpy, with repeated and zero eigenvalues, and updates inside, along and outside of the basis."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        r = int(rng.integers(1, 20))
        dim = r + int(rng.integers(0, 4))
        q = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :r]
        d = np.sort(rng.choice([0, 0, 1, 1, 2, 1e-9, 3, 1e6, rng.random()], r))
        v = q[:, 0] * 2 if rng.random() < 0.3 else rng.normal(size=dim) * rng.choice([1e-8, 1, 1e4])
        want = (q * d) @ q.T + np.outer(v, v)
        e, u = whitening.rank_one(d, q, v, dim)
        assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-13
        assert np.abs((u * e) @ u.T - want).max() < 1e-13 * np.abs(want).max()
