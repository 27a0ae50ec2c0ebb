"""Grouped logistic fits against separate ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.operators.newton import grouped_logistic


def rows():
    rng = np.random.default_rng(5)
    out = []
    for c, n in (("a", 300), ("b", 80), (None, 120)):
        for i in range(n):
            x = rng.standard_normal(2) * [2, 1] + [5, 0]
            y = int(rng.random() < 1 / (1 + np.exp(-(x[0] - 5) + (2 if c == "b" else -1) * x[1])))
            out.append((c, y, i % 5 == 0, float(x[0]), float(x[1])))
    return out + [("one class", 1, i % 2 == 0, 1.0 * i, 2.0) for i in range(10)] + [("no test", i % 2, False, 1.0 * i, 2.0) for i in range(10)]


def plain(own):
    """Newton steps on one cluster alone."""
    x, y, test = np.array([r[3:] for r in own]), np.array([r[1] for r in own]), np.array([r[2] for r in own])
    z = (x - x[~test].mean(0)) / x[~test].std(0, ddof=1)
    z = np.c_[np.ones(len(z)), z]
    w = np.where(y == 1, (y[~test] == 0).sum() / (y[~test] == 1).sum(), 1.0)
    t, beta = ~test, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[t] @ beta))
        g, h = z[t].T @ (w[t] * (p - y[t])), (z[t] * (w[t] * p * (1 - p))[:, None]).T @ z[t]
        ridge = 1e-6 * h[0, 0]
        beta = beta - np.linalg.solve(h + ridge * np.eye(3), g + ridge * beta)
    return 1 / (1 + np.exp(-z @ beta))


def test_equals_separate_fits(spark):
    data = rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, c string, label int, test boolean, u double, v double").repartition(4)
    scored, skipped, history = grouped_logistic(df, "c", ["u", "v"], test=F.col("test"))
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert history[-1] < 1e-8 and len(history) < 25
    assert dict(skipped) == {"one class": "not both classes in the train part and the test part", "no test": "not both classes in the test part"}
    for c in ("a", "b", None):
        ids = [i for i, r in enumerate(data) if r[0] == c]
        assert [got[i] for i in ids] == pytest.approx(list(plain([data[i] for i in ids])), abs=1e-6)
    assert len(got) == 500


def test_number_of_scans_does_not_grow_with_clusters(spark):
    """Twenty clusters take no more iterations' jobs than their slowest one needs."""
    rng = np.random.default_rng(1)
    data = [(k, int(rng.random() < 0.4), float(rng.standard_normal())) for k in range(20) for _ in range(60)]
    df = spark.createDataFrame(data, "c int, label int, u double")
    scored, skipped, history = grouped_logistic(df, "c", ["u"])
    assert not skipped and len(history) <= 8 and scored.count() == 1200
