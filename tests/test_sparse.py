"""Sparse SVD against the dense one."""

import numpy as np
import pytest

from wardlens.operators import sparse
from wardlens.operators.sparse import sparse_svd


def triples(m):
    return [(int(r), f"c{c}", float(m[r, c])) for r, c in zip(*np.nonzero(m))]


@pytest.mark.parametrize("rank", [30, 4])
def test_values_and_projection_equal_the_dense_ones(spark, rank):
    rng = np.random.default_rng(3)
    if rank == 30:
        m = rng.random((120, 30)) * (rng.random((120, 30)) < 0.2)
    else:
        m = rng.integers(0, 3, (120, rank)) @ (rng.integers(1, 4, (rank, 30)) * (rng.random((rank, 30)) < 0.4)).astype(float)
    df = spark.createDataFrame(triples(m), "row long, col string, value double").repartition(3)
    s, rows = sparse_svd(df, 6, oversample=14)
    want = np.linalg.svd(m, compute_uv=False)
    want = want[want > 1e-9][:6]
    assert len(s) == len(want) and np.abs(s / want - 1).max() < 1e-6
    got = {r["id"]: list(r)[1:] for r in rows.collect()}
    p = np.array([got.get(i, [0.0] * len(s)) for i in range(120)])
    u, _, vt = np.linalg.svd(m, full_matrices=False)
    assert np.abs(p @ p.T - m @ vt[:len(s)].T @ vt[:len(s)] @ m.T).max() < 1e-5 * want[0] ** 2
    other, _ = sparse_svd(df.repartition(5, "col"), 6, oversample=14)
    assert np.allclose(other, s, rtol=1e-9)


def test_repeats_add_up_and_odd_values_are_left_out(spark):
    rows = [(1, "a", 1.0), (1, "a", 2.0), (2, "b", 5.0), (3, None, 4.0), (None, "a", 4.0), (3, "b", None), (4, "b", float("nan")), (5, "b", float("inf")), (6, "a", 0.0)]
    s, p = sparse_svd(spark.createDataFrame(rows, "row long, col string, value double"), 3)
    assert np.allclose(s, [5, 3]) and {r["id"] for r in p.collect()} == {1, 2}


def test_empty_matrix(spark):
    s, p = sparse_svd(spark.createDataFrame([], "row long, col string, value double"), 3)
    assert len(s) == 0 and p.count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_both_forms_take_the_same_steps(spark, monkeypatch, few):
    passes, step = [], sparse._step
    monkeypatch.setattr(sparse, "FEW", few)
    monkeypatch.setattr(sparse, "ENTRIES", 7)
    monkeypatch.setattr(sparse, "_step", lambda *a: (passes.append(1), step(*a))[1])
    rng = np.random.default_rng(8)
    m = rng.random((40, 9)) * (rng.random((40, 9)) < 0.4)
    s, rows = sparse_svd(spark.createDataFrame(triples(m), "row long, col string, value double").repartition(3), 4, oversample=3, max_iter=4 if few else 2)
    assert bool(passes) == bool(few) and len(passes) < 9
    want = np.linalg.svd(m, compute_uv=False)[:4]
    assert np.abs(s / want - 1).max() < 0.1
    if few:
        p = np.array([list(r)[1:] for r in rows.orderBy("id").collect()])
        assert np.allclose(p.T @ p, np.diag(s ** 2), atol=1e-9)


def test_weights_keep_their_rules_for_nulls_and_repeats(spark):
    rows = [(1, ["a", "a", "b", None]), (2, ["b"]), (3, None), (4, []), (None, ["a"]), (1, ["b"])]
    got = {(r["id"], r["item"]): r["weight"] for r in sparse.tfidf_long(spark.createDataFrame(rows, "id long, items array<string>"), "id", "items").collect()}
    idf = np.log(7 / 3) + 1
    # counts of key 1: a twice, b twice; both items are in two keys (the null key counts, but has no rows)
    assert set(got) == {(1, "a"), (1, "b"), (2, "b")} and np.isclose(got[1, "a"], 2 * idf / np.hypot(2 * idf, 2 * idf)) and got[2, "b"] == 1
