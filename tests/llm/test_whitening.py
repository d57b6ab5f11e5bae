import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import whitening as w

SF = "/root/testdata/sf0.001"


def brute(x, k=4):
    """(S, n, eigenvalues, eigenvectors, trace) of the distinct rows of ``x``."""
    u = np.unique(x, axis=0)
    c = u - u.sum(0) / len(u)
    v = c.T @ c / len(u)
    e, q = np.linalg.eigh(v)
    return u.sum(0), len(u), e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def check(rows, x_of, k=4, rel=1e-9):
    """Rows of the operator against numpy."""
    sums, n, e, q, trace = brute(np.array([x_of[i] for i in x_of]), k)
    z = {}
    for r in rows:
        x = x_of[r.id]
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=rel)
        z.setdefault(r.component, {})[r.id] = r.whitened
    for c, mine in z.items():
        want = {i: (x_of[i] - sums / n) @ q[:, c - 1] / np.sqrt(e[c - 1]) for i in mine}
        sign = np.sign(sum(want[i] * mine[i] for i in mine))
        assert max(abs(sign * mine[i] - want[i]) for i in mine) < 1e-8
    return z


def test_query_equals_the_dense_solution(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    x_of = {r.vec_id: np.floor(256 * np.array(r.embedding, float)) for r in table.collect()}
    rows = w.op11_embedding_whitening(spark, SF).withColumnRenamed("vec_id", "id").collect()
    assert len(rows) == 4 * len(x_of)
    check(rows, x_of)
    assert {r.identity_error for r in rows}.pop() < 1e-10


@pytest.mark.parametrize("d,spectrum", [(6, "plain"), (40, "close"), (90, "flat"), (120, "steep")])
def test_pairs_of_known_matrices(d, spectrum):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {"plain": np.arange(d, 0, -1.0), "close": 1 + np.sort(rng.random(d))[::-1] * 1e-3,
         "flat": 100 + np.sort(rng.random(d))[::-1], "steep": 10.0 ** -np.arange(d).clip(0, 300)}[spectrum]
    m = (q * e) @ q.T
    m = (m + m.T) / 2
    calls = []

    def times(u):
        calls.append(u.shape[1])
        return m @ u

    values, vectors = w.leading_pairs(times, d, 4, float(np.trace(m)))
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(m))[::-1][:4], rtol=1e-12)
    assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert len(calls) < 400


def test_minres_solves_symmetric_systems():
    rng = np.random.default_rng(1)
    m = rng.standard_normal((30, 30))
    m = m + m.T
    right = rng.standard_normal((30, 3))
    got = w.minres(lambda v, which: m @ v, right, 30, 1e-14)
    assert np.abs(m @ got - right).max() < 1e-6
    assert not w.minres(lambda v, which: m @ v, np.zeros((30, 2)), 5, 1e-3).any()


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_unusable_vectors_and_repeats(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.standard_normal(5).astype(np.float32)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0])]
    again = [(7, good[7][1]), (50, good[7][1]), (None, good[3][1])]
    df = _vectors(spark, good + bad + again).withColumns({c: F.lit("?") for c in ("id", "x", "n", "block", "component")})
    rows = w.whitened(df).collect()
    x_of = {i: np.floor(256 * np.array(v)) for i, v in [*good, *again]}
    assert len(rows) == 4 * 43 and {r.id for r in rows} == set(x_of)
    check(rows, x_of)


def test_more_components_than_dimensions(spark):
    df = _vectors(spark, [(i, [float(i), float(i * i % 7), float(i % 3)]) for i in range(20)])
    rows = w.whitened(df).collect()
    assert sorted({r.component for r in rows}) == [1, 2, 3] and len(rows) == 60
    check(rows, {i: np.floor(256 * np.array([i, i * i % 7, i % 3], float)) for i in range(20)}, k=3)


def test_without_variance(spark):
    rows = w.whitened(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(rows) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None
                                  and r.identity_error is None for r in rows)
    line = w.whitened(_vectors(spark, [(i, [float(i), 1.0, 1.0]) for i in range(5)])).collect()  # variance in one dimension
    by = {c: [r.whitened for r in line if r.component == c] for c in (1, 2, 3)}
    assert None not in by[1] and by[2] == by[3] == [None] * 5
    assert all(r.identity_error < 1e-10 for r in line)
    assert w.whitened(_vectors(spark, [])).count() == 0


def test_very_large_entries(spark):
    rows = w.whitened(_vectors(spark, [(i, [float(i) * 1e12, -float(i % 4) * 1e12]) for i in range(9)])).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in rows) and {r.component for r in rows} == {1, 2}
    exact = w._deviations(np.array([[2**40, -(2**40)]]), 3, [5, 7])
    assert exact == [None if (v := (3 * 2**40 - 5) ** 2 + (-3 * 2**40 - 7) ** 2) >= 2**63 else v]
