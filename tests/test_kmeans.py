"""k-means for all k against a plain version over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.operators import kmeans as km


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    middle = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0]])
    x = np.concatenate([m + rng.standard_normal((n, 3)) for m, n in zip(middle, (50, 80, 20))])
    w = rng.integers(1, 4, len(x)).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(w[i])) for i in range(len(x))], "id long, v array<double>, w double").repartition(4)
    return df, x, w


def plain(x, w, centres, turns):
    for turn in range(turns + 1):
        d = ((x[:, None] - centres) ** 2).sum(2)
        which = d.argmin(1)
        sums = np.array([w[which == i].sum() for i in range(len(centres))])
        cost = (w * d.min(1)).sum()
        if turn < turns:
            centres = np.array([np.average(x[which == i], axis=0, weights=w[which == i]) if sums[i] else centres[i] for i in range(len(centres))])
    return centres, sums, cost


def test_all_k_equal_the_plain_loop(blobs):
    df, x, w = blobs
    got = km.kmeans_all(df, "v", "id", [1, 2, 3, 5], F.col("w"), starts=4)
    rows = km.usable(df, "v", "id", F.col("w"))
    seeds = {r: np.zeros((0, 3)) for r in range(4)}
    for t in range(5):
        found = km.next_seeds(rows, seeds, t, 1, 3)
        seeds = {r: np.vstack([seeds[r], found[r]]) for r in seeds}
    assert all((s == x).all(1).any() for c in seeds.values() for s in c) and len({tuple(c[0]) for c in seeds.values()}) > 1
    for k in (1, 2, 3, 5):
        ends = [plain(x, w, seeds[r][:k].copy(), 60) for r in range(4 if k > 1 else 1)]
        centres, sums, cost = min(ends, key=lambda e: round(e[2], 6))
        order = np.lexsort(centres.T), np.lexsort(got.centres[k].T)
        assert np.allclose(got.centres[k][order[1]], centres[order[0]], atol=1e-3) and abs(got.inertia[k] - cost) < 1e-4 * cost
        assert np.allclose(got.weights[k][order[1]], sums[order[0]])
    assert got.inertia[1] > got.inertia[2] > got.inertia[3] > got.inertia[5]
    assert abs(got.inertia[1] - (w[:, None] * (x - np.average(x, axis=0, weights=w)) ** 2).sum()) < 1e-6
    assert sorted(got.weights[3]) == sorted([w[:50].sum(), w[50:130].sum(), w[130:].sum()])


def test_no_cancellation_far_from_zero(spark):
    df = spark.createDataFrame([(i, [1e8 + i % 2]) for i in range(100)], "id long, v array<double>")
    assert abs(km.kmeans_all(df, "v", "id", [1]).inertia[1] - 25) < 1e-6


def test_seeds_follow_weight_and_distance(spark):
    df = spark.createDataFrame([(0, [0.0], 1.0), (1, [1.0], 1.0), (2, [2.0], 2.0)], "id long, v array<double>, w double")
    rows = km.usable(df, "v", "id", F.col("w"))
    drawn = [c[0] for c in km.next_seeds(rows, {r: np.array([[0.0]]) for r in range(200)}, 1, 5, 1).values()]
    assert 0.0 not in drawn and abs(np.mean(np.array(drawn) == 2.0) - 8 / 9) < 0.07


def test_seeds_and_result_do_not_follow_the_partitioning(blobs):
    df, _, _ = blobs
    a, b = (km.kmeans_all(d, "v", "id", [3], F.col("w")) for d in (df, df.repartition(7, "w")))
    assert np.allclose(a.centres[3], b.centres[3]) and (a.weights[3] == b.weights[3]).all()


def test_null_empty_and_repeated_vectors(spark):
    schema = "id long, v array<double>"
    assert km.kmeans_all(spark.createDataFrame([], schema), "v", "id", [1, 2]).centres == {}
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0]), (None, [1.0, 2.0])]
    got = km.kmeans_all(spark.createDataFrame(rows, schema), "v", "id", [1, 3])
    assert got.weights[1].tolist() == [3.0] and got.weights[3].tolist() == [3.0] and got.inertia[3] == 0
    with pytest.raises(ValueError):
        km.kmeans_all(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), "v", "id", [1])


def test_background_draw_follows_the_weights(blobs):
    df, _, w = blobs
    got = km.kmeans_all(df, "v", "id", [3], F.col("w"))
    drawn = np.bincount(km.draw_background(got, 3, 4000), minlength=3) / 4000
    assert np.allclose(drawn, got.weights[3] / w.sum(), atol=0.04)


def test_a_pass_over_one_file_has_a_task_for_every_core(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "id long, v array<double>").coalesce(1)
    parts, plain_step = [], km.step_sums
    monkeypatch.setattr(km, "step_sums", lambda rows, *a: (parts.append(rows.rdd.getNumPartitions()), plain_step(rows, *a))[1])
    km.kmeans_all(df, "v", "id", [2])
    assert parts and min(parts) >= spark.sparkContext.defaultParallelism


def test_products_choose_the_centre_that_differences_choose(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([1e6 + rng.integers(0, 3, (300, 4)) / 2, [[1e12, 0, 0, 0]]])
    rows = km.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "v", "id")
    centres = {(k, run): x[rng.choice(300, k, replace=False)] + run * 1e-7 for k in (1, 4, 9) for run in (0, 1)} | {(5, 0): x[-5:]}
    got = {(r["k"], r["run"], r["centre"]): (r["n"], r["cost"]) for r in km.step_sums(rows, centres, 4).where("dim = 0").collect()}
    for (k, run), c in centres.items():
        d = ((x[:, None] - c) ** 2).sum(2)
        for i in range(k):
            n, cost = got[k, run, i]
            assert n == (d.argmin(1) == i).sum() and np.isclose(cost, d.min(1)[d.argmin(1) == i].sum(), rtol=1e-9, atol=0)
