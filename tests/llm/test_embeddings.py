"""Embedding operators against brute force."""

import numpy as np
import pytest

from wardlens.llm import stable, whitening

SF_MID = "/root/testdata/sf0.01"
DDL = "vec_id long, embedding array<double>"


def brute(rows, cosine=0.9):
    """(n_links, component_id, kept) of each row, in order."""
    def usable(v):
        return v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if usable(v) else None for _, v in rows]
    unit = [None if u is None else u / np.sqrt(u @ u) for u in unit]
    near = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out = [None] * len(rows)
    for i in range(len(rows)):
        if out[i] is None:
            group, todo = {i}, [i]
            while todo:
                new = set(near[todo.pop()]) - group
                group |= new
                todo += new
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            least = min(ids, default=None)
            for k in group:
                out[k] = len(near[k]), least, least is not None and rows[k][0] == least
    return out


def found(spark, rows, ddl=DDL):
    out = stable.near_vectors(spark.createDataFrame(rows, ddl).repartition(3)).collect()
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=str)


def near_rows(rng, groups, copies, width, noise):
    out = []
    for g in range(groups):
        centre = rng.standard_normal(width)
        for c in range(copies):
            out.append((g * copies + c, [float(x) for x in centre + noise * rng.standard_normal(width)]))
    return out


@pytest.mark.parametrize("noise", [0.05, 0.2, 0.31])
def test_near_groups(spark, noise):
    rows = near_rows(np.random.default_rng(4), 40, 6, 32, noise)
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute(rows))), key=str)
    got = found(spark, rows)
    if noise < 0.3:  # cosines far above the threshold: nothing may be missed
        assert got == want
    links, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.97 * all_links <= links <= all_links
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_recall_at_the_threshold():
    """Pairs with a cosine just above the threshold meet in some table."""
    rng = np.random.default_rng(7)
    a = stable.unit(rng.standard_normal((4000, 64)))
    b = rng.standard_normal((4000, 64))
    b = stable.unit(b - (b * a).sum(1, keepdims=True) * a)
    b = 0.9005 * a + np.sqrt(1 - 0.9005 ** 2) * b
    k, tables = stable.plan(50_000)
    meet = (stable.bucket_keys(a, k, tables) == stable.bucket_keys(b, k, tables)).any(1)
    assert meet.mean() >= 0.985


def test_buckets_beyond_a_cell(spark, monkeypatch):
    """A hot group is cut into chunks; counts and components stay whole."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 0.1 * rng.standard_normal(16)]) for i in range(700)] + near_rows(rng, 20, 2, 16, 0.05)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    monkeypatch.setattr(stable, "CELL", 64)
    monkeypatch.setattr(stable, "BLOCK", 32)
    assert found(spark, rows) == sorted(((i, *b) for (i, _), b in zip(rows, brute(rows))), key=str)


def test_links_count_each_pair_once():
    rng = np.random.default_rng(3)
    units = stable.unit(rng.standard_normal((60, 3)))
    keys = rng.integers(0, 3, (60, 2)).astype(np.int32)
    links, label = stable._links(units, keys, np.ones(60, np.int64), np.zeros(60, np.int64), False, 0.9)
    near = (units @ units.T >= 0.9) & ~(keys[:, None] == keys[None]).any(2) & ~np.eye(60, dtype=bool)
    assert links.tolist() == near.sum(1).tolist()
    for i in range(60):
        assert all(label[i] == label[j] for j in np.flatnonzero(near[i]))


def test_corner_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1e300, 1e-300]),
            (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-300, 0.0])]
    assert found(spark, rows) == sorted(((i, *b) for (i, _), b in zip(rows, brute(rows))), key=str)
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]
    extra = spark.createDataFrame([(1, [1.0, 2.0], "c", 3), (2, [2.0, 4.0], "c", 3)], DDL + ", cls string, n int")
    assert {r["n_links"] for r in stable.near_vectors(extra).collect()} == {1}


def test_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(spark, rows, "vec_id long, embedding array<float>") == sorted(((i, *b) for (i, _), b in zip(rows, brute(rows))), key=str)


# ------------------------------------------------------------------ whitening
def truth(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n), ((n * x - s) ** 2).sum(1)


def whitened(spark, rows, ddl=DDL, parts=3):
    out = whitening.whiten(spark.createDataFrame(rows, ddl).repartition(parts)).toPandas().sort_values(["vec_id", "component"])
    return out


def compare(out, vectors, k=8):
    y, explained, deviation = truth(vectors, k)
    got = out["whitened"].to_numpy().reshape(-1, k)
    assert np.allclose(got * np.sign((got * y).sum(0)), y, atol=1e-9)
    assert np.allclose(out["explained"].to_numpy().reshape(-1, k), explained, rtol=1e-9)
    assert out["deviation"].tolist() == np.repeat(deviation, k).tolist()
    assert (out["identity_error"] < 1e-9).all() and out["identity_error"].nunique() == 1 and (out["n"] == len(vectors)).all()


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 24)) * np.linspace(0.2, 2, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    compare(whitened(spark, rows), vectors)
    compare(whitened(spark, rows, parts=40), vectors)


def test_whitening_of_given_vectors(spark):
    df = spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id").toPandas()
    compare(whitening.whiten(spark.read.parquet(f"{SF_MID}/embeddings.parquet")).toPandas().sort_values(["vec_id", "component"]), df["embedding"].tolist())


def test_whitening_corner_rows(spark):
    good = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.5, 0.25])]
    bad = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0])]
    out = whitened(spark, good + bad)
    assert len(out) == 8 and set(out["n"]) == {4} and out["vec_id"].isna().sum() == 2
    assert whitened(spark, []).empty and whitened(spark, [(1, None)]).empty and whitened(spark, [(1, [1.0])]).empty
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).empty  # equal vectors have no component
    one = whitened(spark, [(1, [1.0]), (2, [3.0])])
    assert one["whitened"].abs().tolist() == [1.0, 1.0] and one["explained"].tolist() == [1.0, 1.0]
    extra = spark.createDataFrame([(1, [1.0], "p"), (2, [3.0], "p")], DDL + ", payload string")
    assert whitening.whiten(extra).count() == 2


def test_rank_deficient_and_tied_components(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3, 10))
    vectors = rng.standard_normal((200, 3)) @ base * 5
    out = whitened(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors)])
    assert out["identity_error"].max() < 1e-4
    square = [[float(a), float(b), float(c)] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]  # three equal eigenvalues
    tied = whitened(spark, list(enumerate(square)))
    assert tied["component"].max() == 3 and tied["identity_error"].max() < 1e-12 and np.allclose(tied["explained"], 1 / 3)


def small_problems():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((120, 20)))[0]
    turn = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    yield "random", rng.standard_normal((300, 20))
    yield "graded", rng.standard_normal((300, 20)) * np.logspace(0, -9, 20)
    yield "equal", q
    yield "multiple", (q * ([5] * 4 + [3] * 10 + [1] * 6)) @ turn
    yield "close", q * np.concatenate([[1, 1 + 1e-9, 1 + 2e-9, 1 + 1e-12], np.full(16, 0.5)])
    yield "glued", np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1)
    yield "low rank", rng.standard_normal((3, 20))
    yield "diagonal", np.diag([1.0, 0, 0, 2.0])
    yield "zero", np.zeros((4, 4))


@pytest.mark.parametrize("name,a", list(small_problems()), ids=[n for n, _ in small_problems()])
def test_solver_on_hard_matrices(name, a):
    n = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((max(0, n - len(r)), n))])[:n]
    values, axes, total = whitening.principal(r, 8)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(values, want[:len(values)], rtol=1e-12)
    assert np.isclose(total, want.sum())
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert np.abs(a.T @ (a @ axes) - axes * values).max(initial=0) <= 1e-12 * max(want[0], 1e-300)
    d, e, v = whitening.bidiagonalise(r)
    assert np.allclose(whitening.dqds(d * d, e * e)[::-1], np.pad(want, (0, n - len(want))), atol=1e-13 * max(want[0], 1e-300))
    assert np.allclose(v.T @ v, np.eye(n), atol=1e-13)
