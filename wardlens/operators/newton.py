"""Logistic fits of all clusters at once by Newton steps on grouped cross-products.

One aggregate per iteration sums, for every cluster, the weighted cross-products of the features (and the gradient);
the driver solves one small system per cluster, and the new coefficients go back as a small table.  One scan an iteration
whatever the number of clusters, one scan to score; nothing is planned per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTER, X, W, Y = "_wl_cluster", "_wl_x", "_wl_w", "_wl_y"


def standardized(df: DataFrame, cluster_col: str, features: Sequence[str], label_col: str, train: Column) -> DataFrame:
    """``df`` with the features as z-scores of their cluster's training rows, a one in front, and a class weight
    (negatives / positives of the training rows for positives); nulls and constant features are 0."""
    inside = lambda c: F.when(train, c)
    stats = df.groupBy(cluster_col).agg(
        *[F.avg(inside(F.col(c))).alias(f"_m{i}") for i, c in enumerate(features)], *[F.stddev(inside(F.col(c))).alias(f"_s{i}") for i, c in enumerate(features)],
        F.sum(inside(1 - F.col(label_col))).alias("_neg"), F.sum(inside(F.col(label_col))).alias("_pos"),
        F.countDistinct(F.when(train, F.col(label_col))).alias("_k0"), F.countDistinct(F.when(~train, F.col(label_col))).alias("_k1"))
    stats = stats.withColumnRenamed(cluster_col, CLUSTER)
    j = df.join(stats, df[cluster_col].eqNullSafe(stats[CLUSTER]))
    z = [F.coalesce(F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")), F.lit(0.0)) for i, c in enumerate(features)]
    weight = F.when(F.col(label_col) == 1, F.try_divide(F.col("_neg").cast("double"), F.col("_pos").cast("double"))).otherwise(F.lit(1.0))
    return j.select(*df.columns, F.array(F.lit(1.0), *z).alias(X), weight.alias(W), F.col(label_col).cast("double").alias(Y),
                    F.when(F.col("_k0") < 2, F.when(F.col("_k1") < 2, "not both classes in the train part and the test part").otherwise("not both classes in the train part"))
                    .when(F.col("_k1") < 2, "not both classes in the test part").alias("_why"))


def _sums(df: DataFrame, cluster_col: str, width: int, margin: Column) -> DataFrame:
    """Per cluster the gradient and the upper triangle of the hessian: ``g0, g1, ..., h0_0, h0_1, ...`` and the loss."""
    p = 1 / (1 + F.exp(-margin))
    with_p = df.select(F.col(cluster_col).alias(CLUSTER), *[F.col(X)[i].alias(f"x{i}") for i in range(width)], W, Y, p.alias("p"))
    a = F.col(W) * (F.col("p") - F.col(Y))
    b = F.col(W) * F.col("p") * (1 - F.col("p"))
    right = F.when(F.col(Y) == 1, F.col("p")).otherwise(1 - F.col("p"))
    return with_p.groupBy(CLUSTER).agg(
        *[F.sum(a * F.col(f"x{i}")).alias(f"g{i}") for i in range(width)],
        *[F.sum(b * F.col(f"x{i}") * F.col(f"x{k}")).alias(f"h{i}_{k}") for i in range(width) for k in range(i, width)],
        F.sum(-F.col(W) * F.log(F.greatest(right, F.lit(1e-300)))).alias("loss"))


def with_margin(df: DataFrame, cluster_col: str, coefficients: dict) -> tuple[DataFrame, Column]:
    """``df`` beside its cluster's coefficients (a table of one row a cluster) and the margin."""
    spark = df.sparkSession
    # the cluster keys are the driver's own rows of an aggregate: one short row for each
    table = spark.createDataFrame([(c, [float(v) for v in beta]) for c, beta in coefficients.items()],
                                  f"_c {df.schema[cluster_col].dataType.simpleString()}, _beta array<double>")
    j = df.join(table, df[cluster_col].eqNullSafe(table["_c"])).drop("_c")
    return j, F.aggregate(F.zip_with("_beta", X, lambda b, x: b * x), F.lit(0.0), lambda s, v: s + v)


def grouped_logistic(df: DataFrame, cluster_col: str, features: Sequence[str], label_col: str = "label", test: Column | None = None,
                     ridge: float = 1e-6, max_iter: int = 25, tolerance: float = 1e-8):
    """``(scored, skipped, history)``: every row of the fitted clusters with ``score`` in place, the clusters without both
    classes in both parts as ``(cluster, reason)``, and the largest step of each iteration.

    ``ridge`` is the share of a cluster's weight that is added to the diagonal; without it separable clusters have no
    finite fit.  Steps that raise a cluster's loss are halved."""
    train = F.lit(True) if test is None else ~test
    ready = standardized(df, cluster_col, features, label_col, train)
    ready = ready.checkpoint(eager=True)   # read by every iteration
    found = ready.groupBy(cluster_col).agg(F.max("_why").alias("why")).collect()  # one row a cluster
    skipped = sorted(((r[0], r["why"]) for r in found if r["why"]), key=lambda s: (s[0] is not None, str(s[0])))
    fitted = ready.where(F.col("_why").isNull() & F.col(W).isNotNull()).drop("_why")
    if test is None:
        skipped = [(c, "not both classes") for c, w in skipped if "train" in w]
        fitted = ready.where(~F.coalesce(F.col("_why").contains("train"), F.lit(False))).drop("_why")
    width = len(features) + 1
    left_out = {c for c, _ in skipped}
    names = [r[0] for r in found if r[0] not in left_out]
    beta = {c: np.zeros(width) for c in names}
    moved = {c: np.zeros(width) for c in names}
    loss: dict = {}
    history = []
    part = fitted.where(train)
    for _ in range(max_iter):
        rows, margin = with_margin(part, cluster_col, beta)
        step = 0.0
        for r in _sums(rows, cluster_col, width, margin).collect():  # one row a cluster
            c = r[CLUSTER]
            if c in loss and r["loss"] > loss[c] * (1 + 1e-12) and np.abs(moved[c]).max() > 1e-12:
                moved[c] = moved[c] / 2
                beta[c] = beta[c] - moved[c]
                step = max(step, float(np.abs(moved[c]).max()))
                continue
            loss[c] = r["loss"]
            h = np.zeros((width, width))
            for i in range(width):
                for k in range(i, width):
                    h[i, k] = h[k, i] = r[f"h{i}_{k}"]
            g = np.array([r[f"g{i}"] for i in range(width)])
            penalty = ridge * max(h[0, 0], 1e-12)
            h[np.arange(width), np.arange(width)] += penalty
            moved[c] = -np.linalg.lstsq(h, g + penalty * beta[c], rcond=None)[0]
            beta[c] = beta[c] + moved[c]
            step = max(step, float(np.abs(moved[c]).max()))
        history.append(step)
        if step < tolerance:
            break
    rows, margin = with_margin(fitted, cluster_col, beta)
    scored = rows.withColumn("score", 1 / (1 + F.exp(-margin))).drop("_beta", X, W, Y)
    return scored, skipped, history


def first_step_sums(df: DataFrame, cluster_col: str, features: Sequence[str], label_col: str = "label") -> DataFrame:
    """Gradient of every cluster's coefficients at zero, on raw features: ``cluster, term, gradient, curvature`` (the
    first step of ``grouped_logistic`` before standardising)."""
    ready = df.select(cluster_col, F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]).alias(X), F.lit(1.0).alias(W), F.col(label_col).cast("double").alias(Y))
    s = _sums(ready, cluster_col, len(features) + 1, F.lit(0.0))
    terms = ["intercept", *features]
    return s.select(F.col(CLUSTER).alias(cluster_col), F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"g{i}").alias("gradient"), F.col(f"h{i}_{i}").alias("curvature")) for i, t in enumerate(terms)])).alias("s")) \
        .select(cluster_col, "s.*")
