import numpy as np
import pytest

from quire.llm import whitening as X
from quire.llm.queries import QUERIES


def brute(vectors):
    """Integer rows, mean, eigenvalues and eigenvectors by a dense solver."""
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], np.int64)
    u = np.unique(x, axis=0)
    s = u.sum(0)
    c = u - s / len(u)
    values, q = np.linalg.eigh(c.T @ c / len(u))
    return x, len(u), s, values[::-1], q[:, ::-1]


def check(rows, got, k, tol=1e-9):
    x, n, s, values, q = brute([v for _, v in rows])
    got = sorted(got, key=lambda r: (r.id, r.component))
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    w = np.array([r.whitened for r in got]).reshape(-1, k)
    want = (x - s / n) @ q[:, :k] / np.sqrt(values[:k])
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < tol
    assert np.allclose([r.explained for r in got[:k]], values[:k] / values.sum(), rtol=1e-9)
    assert [r.deviation for r in got[::k]] == ((n * x - s) ** 2).sum(1).tolist()
    assert max(r.identity_error for r in got) < 1e-9


@pytest.fixture()
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_matches_a_dense_solver_with_repeated_vectors(vectors):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((300, 12)) * np.linspace(.05, 3, 12)).astype(np.float32).astype(float)
    rows = [(i, base[i % 200 if i < 300 else 0].tolist()) for i in range(500)]  # one vector 200 times
    check(rows, X.whiten(vectors(rows)).collect(), 4)


def test_query_on_the_small_table(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").orderBy("vec_id").collect()]
    got = QUERIES["op12_embedding_whitening"](spark, sf_small).withColumnRenamed("vec_id", "id").collect()
    check(rows, got, 4)


def test_bidiagonal_matrix_and_basis(spark, vectors):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((80, 6)))]
    fit = X.integer_vectors(vectors(rows)).select("x").distinct()
    x = np.array([r.x for r in fit.collect()], float)
    c = x - x.mean(0)
    v, b = X.bidiagonalise(X.Centred(fit, 6, x.mean(0), 1), np.linalg.norm(c))
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-12
    assert np.allclose(b, np.triu(np.tril(b, 1))) and np.allclose(np.linalg.svd(b)[1], np.linalg.svd(c)[1], rtol=1e-10)
    u = c @ v @ np.linalg.inv(b)
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-9


def test_equal_eigenvalues_are_all_found(vectors):
    """Plus and minus of each axis: four equal eigenvalues, found by steps after a breakdown."""
    rows = [(2 * i + s, [(1 - 2 * s) * 1.0 if j == i else 0.0 for j in range(5)]) for i in range(5) for s in (0, 1)]
    got = X.whiten(vectors(rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and max(abs(r.explained - .2) for r in got) < 1e-12
    assert max(r.identity_error for r in got) < 1e-12


def test_low_rank_and_single_vectors(vectors):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(30)]  # rank one
    got = {(r.id, r.component): r for r in X.whiten(vectors(rows)).collect()}
    assert {c for _, c in got} == {1, 2, 3} and abs(got[0, 1].explained - 1) < 1e-12
    assert all(got[i, c].whitened == 0 and got[i, c].explained == 0 for i in range(30) for c in (2, 3))
    assert abs(abs(got[0, 1].whitened) - 1.5) < 1e-12 and got[0, 1].identity_error < 1e-12
    one = X.whiten(vectors([(5, [.5, .25]), (None, [.5, .25])])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, 0.0, 0.0)} and len(one) == 4


def test_unusable_rows_are_dropped_and_short_vectors_padded(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], "a", 1), (2, None, "b", 2), (3, [nan, 1.0], "c", 3), (4, [inf, 1.0], "d", 4), (5, [None, 1.0], "e", 5),
         (6, [-1.0], "f", 6), (7, [0.001, -0.001], "g", 7), (8, [], "h", 8), (8, [1.0, 2.0], "i", 9)],
        "vec_id bigint, embedding array<double>, x string, component int")
    got = X.whiten(df).collect()
    assert sorted({r.id for r in got}) == [1, 6, 7, 8] and {r.n for r in got} == {4} and len(got) == 10
    xs = dict(map(tuple, X.integer_vectors(df).where("id < 8").collect()))
    assert xs == {1: [256, 512], 6: [-256], 7: [0, -1]}


def test_empty_tables(vectors):
    assert X.whiten(vectors([])).count() == 0 and X.whiten(vectors([(1, None), (2, [])])).count() == 0


def test_huge_entries_keep_exact_sums(vectors):
    rows = [(i, [1e30 * (-1) ** i, 1e15 * i, 1.0]) for i in range(4)]
    got = X.whiten(vectors(rows)).collect()
    assert len(got) == 12 and {r.deviation for r in got} == {None}
    small = [(i, [3e6 * i, 1.0]) for i in range(3)]
    x, n, s, _, _ = brute([v for _, v in small])
    assert sorted(r.deviation for r in X.whiten(vectors(small)).where("component = 1").collect()) == sorted(((n * x - s) ** 2).sum(1).tolist())


def test_sums_of_many_tasks_are_added_up_in_spark(vectors, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 3)))]
    fit = X.integer_vectors(vectors(rows)).select("x").distinct().repartition(7)
    m = rng.standard_normal((3, 2))
    near = X.Centred(fit, 3, np.zeros(3), 7).gram(m)
    monkeypatch.setattr(X, "FAN_IN", 2)
    far = X.Centred(fit, 3, np.zeros(3), 7).gram(m)
    assert np.allclose(near[0], far[0], rtol=1e-12) and np.allclose(near[1], far[1], rtol=1e-12)
