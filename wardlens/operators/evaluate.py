"""Evaluation tables over a prediction frame (score, label[, group]).

Curves and areas are computed from one row per distinct score per group
(``score_counts``: a grouped aggregate with map-side combine, so a score value
held by a third of all rows is one row after the partial aggregation).  The
running sums over descending scores use ``running_totals`` (range-bucketed), so
no task holds a whole group.  The previous curve point is ``cum - this``, which
removes every ``lag``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from wardlens.operators.ordered import _grouped, running_totals


def score_counts(pred: DataFrame, score_col: str = "score", label_col: str = "label",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    return pred.where(F.col(score_col).isNotNull()).groupBy(*group_cols, score_col).agg(
        F.sum(F.col(label_col).cast("long")).alias("n_pos"),
        F.sum((1 - F.col(label_col)).cast("long")).alias("n_neg"))


def _curve_base(pred, score_col, label_col, group_cols):
    g = list(group_cols)
    sc = score_counts(pred, score_col, label_col, g)
    cum = running_totals(sc, score_col, ["n_pos", "n_neg"], g, descending=True, with_totals=True)
    return cum.withColumnRenamed("cum_n_pos", "tp").withColumnRenamed("cum_n_neg", "fp") \
        .withColumnRenamed("tot_n_pos", "P").withColumnRenamed("tot_n_neg", "N")


def roc_curve(pred: DataFrame, score_col: str = "score", label_col: str = "label",
              group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """One ROC point per distinct score (threshold), descending, plus the origin
    (threshold null).  No collinear points are dropped."""
    pred, g, extra = _grouped(pred, group_cols)
    b = _curve_base(pred, score_col, label_col, g)
    pts = b.select(*g, F.col(score_col).alias("threshold"), "fp", "tp",
                   F.round(F.try_divide(F.col("fp"), F.col("N")), digits).alias("fpr"),
                   F.round(F.try_divide(F.col("tp"), F.col("P")), digits).alias("tpr"))
    origin = b.select(*g).distinct().select(*g, F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("tp"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin).drop(*extra)


def roc_auc(pred: DataFrame, score_col: str = "score", label_col: str = "label",
            group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Area under ROC by the rank-sum formula with tied scores sharing their mean
    rank; null when a group has one class only."""
    pred, g, extra = _grouped(pred, group_cols)
    sc = score_counts(pred, score_col, label_col, g).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    cum = running_totals(sc, score_col, ["n"], g)
    avg_rank = (F.col("cum_n") - F.col("n")).cast("double") + (F.col("n") + 1) / 2.0
    agg = cum.groupBy(*g).agg(F.sum(F.col("n_pos") * avg_rank).alias("_rs"), F.sum("n_pos").alias("_P"),
                              F.sum("n_neg").alias("_N"))
    auc = F.try_divide(F.col("_rs") - F.col("_P") * (F.col("_P") + 1) / 2.0, (F.col("_P") * F.col("_N")).cast("double"))
    return agg.select(*g, F.round(auc, digits).alias("auc")).drop(*extra)


def roc_auc_trapezoid(pred: DataFrame, score_col: str = "score", label_col: str = "label",
                      group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Trapezoid area under the ROC points (equal to the rank formula)."""
    pred, g, extra = _grouped(pred, group_cols)
    b = _curve_base(pred, score_col, label_col, g)
    fpr, tpr = F.try_divide(F.col("fp"), F.col("N")), F.try_divide(F.col("tp"), F.col("P"))
    fpr0, tpr0 = F.try_divide((F.col("fp") - F.col("n_neg")), F.col("N")), F.try_divide((F.col("tp") - F.col("n_pos")), F.col("P"))
    return b.groupBy(*g).agg(F.round(F.sum((fpr - fpr0) * (tpr + tpr0) / 2), digits).alias("auc")).drop(*extra)


def pr_curve(pred: DataFrame, score_col: str = "score", label_col: str = "label",
             group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Precision / recall per distinct score, plus the closing point (recall 0, precision 1)."""
    pred, g, extra = _grouped(pred, group_cols)
    b = _curve_base(pred, score_col, label_col, g)
    pts = b.select(*g, F.col(score_col).alias("threshold"),
                   F.round(F.col("tp") / (F.col("tp") + F.col("fp")), digits).alias("precision"),
                   F.round(F.try_divide(F.col("tp"), F.col("P")), digits).alias("recall"))
    close = b.select(*g).distinct().select(*g, F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(close).drop(*extra)


def average_precision(pred: DataFrame, score_col: str = "score", label_col: str = "label",
                      group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """``sum_n (R_n - R_{n-1}) P_n`` over descending thresholds; the recall step at a
    threshold is its positives over all positives."""
    pred, g, extra = _grouped(pred, group_cols)
    b = _curve_base(pred, score_col, label_col, g)
    term = F.try_divide(F.col("n_pos"), F.col("P")) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return b.groupBy(*g).agg(F.round(F.sum(term), digits).alias("average_precision")).drop(*extra)


def pr_area_trapezoid(pred: DataFrame, score_col: str = "score", label_col: str = "label",
                      group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Trapezoid area under precision(recall) including the (0, 1) closing point."""
    pred, g, extra = _grouped(pred, group_cols)
    b = _curve_base(pred, score_col, label_col, g)
    r, p = F.try_divide(F.col("tp"), F.col("P")), F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, fp0 = F.col("tp") - F.col("n_pos"), F.col("fp") - F.col("n_neg")
    r0 = F.try_divide(tp0, F.col("P"))
    p0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    return b.groupBy(*g).agg(F.round(F.sum((r - r0) * (p + p0) / 2), digits).alias("pr_auc")).drop(*extra)


def curve_areas(pred: DataFrame, score_col: str = "score", label_col: str = "label",
                group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """ROC area (trapezoid = rank formula), average precision and PR trapezoid area
    from one pass over the distinct-score curve."""
    pred, g, extra = _grouped(pred, group_cols)
    b = _curve_base(pred, score_col, label_col, g)
    fpr, tpr = F.try_divide(F.col("fp"), F.col("N")), F.try_divide(F.col("tp"), F.col("P"))
    fpr0 = F.try_divide(F.col("fp") - F.col("n_neg"), F.col("N"))
    tpr0 = F.try_divide(F.col("tp") - F.col("n_pos"), F.col("P"))
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    tp0, fp0 = F.col("tp") - F.col("n_pos"), F.col("fp") - F.col("n_neg")
    prec0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0))
    return b.groupBy(*g).agg(
        F.round(F.sum((fpr - fpr0) * (tpr + tpr0) / 2), digits).alias("auc"),
        F.round(F.sum(F.try_divide(F.col("n_pos"), F.col("P")) * prec), digits).alias("average_precision"),
        F.round(F.sum((tpr - tpr0) * (prec + prec0) / 2), digits).alias("pr_auc")).drop(*extra)


def confusion_counts(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp per group as conditional sums (zeros included)."""
    l, p = F.col(label_col), F.col(pred_col)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return pred.groupBy(*group_cols).agg(cnt((l == 0) & (p == 0)).alias("tn"), cnt((l == 0) & (p == 1)).alias("fp"),
                                         cnt((l == 1) & (p == 0)).alias("fn"), cnt((l == 1) & (p == 1)).alias("tp"))


def confusion_matrix(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix ``(label, pred, n)``, all four cells present."""
    c = confusion_counts(pred, label_col, pred_col, group_cols)
    return c.selectExpr(*group_cols, "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (label, pred, n)")


def _prf(tp, fp, fn):
    precision = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return precision, recall, f1


def class_report(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
                 group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Per class (0, 1): precision, recall, f1 (0.0 when undefined) and support."""
    c = confusion_counts(pred, label_col, pred_col, group_cols)
    tn, fp, fn, tp = F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")
    rows = []
    for cls, (a, b, d) in ((1, (tp, fp, fn)), (0, (tn, fn, fp))):
        p, r, f = _prf(a, b, d)
        rows.append(c.select(*group_cols, F.lit(cls).alias("class"), F.round(p, digits).alias("precision"),
                             F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1"),
                             (a + d).cast("long").alias("support")))
    return rows[0].unionByName(rows[1])


def report_averages(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
                    group_cols: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Micro, macro and support-weighted averages of precision / recall / f1."""
    pred, g, extra = _grouped(pred, group_cols)
    rep = class_report(pred, label_col, pred_col, g, digits=digits)   # averages of the reported values
    tot = F.sum("support")
    macro = rep.groupBy(*g).agg(F.lit("macro").alias("average"), F.avg("precision").alias("precision"),
                                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = rep.groupBy(*g).agg(
        F.lit("weighted").alias("average"),
        *[(F.sum(F.col(m) * F.col("support")) / tot).alias(m) for m in ("precision", "recall", "f1")],
        tot.alias("support"))
    c = confusion_counts(pred, label_col, pred_col, g)
    acc = F.try_divide((F.col("tp") + F.col("tn")).cast("double"),
                       (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).cast("double"))
    micro = c.select(*g, F.lit("micro").alias("average"), acc.alias("precision"), acc.alias("recall"),
                     acc.alias("f1"), (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("support"))
    out = macro.unionByName(weighted).unionByName(micro)
    return out.select(*g, "average", *[F.round(m, digits).alias(m) for m in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support")).drop(*extra)


def accuracy(pred: DataFrame, label_col: str = "label", pred_col: str = "pred",
             group_cols: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*group_cols).agg(F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"))


def sensitivity_specificity(pred: DataFrame, label_col: str = "label", prob_col: str = "prob",
                            group_cols: Sequence[str] = (), eps: float = 1e-7) -> DataFrame:
    """Soft sensitivity and specificity: half-even round(clip(y * p)) sums over class sizes + eps."""
    y, p = F.col(label_col).cast("double"), F.col(prob_col).cast("double")
    tp = F.sum(F.bround(F.least(F.greatest(y * p, F.lit(0.0)), F.lit(1.0))))
    tn = F.sum(F.bround(F.least(F.greatest((1 - y) * (1 - p), F.lit(0.0)), F.lit(1.0))))
    return pred.groupBy(*group_cols).agg((tp / (F.sum(y) + eps)).alias("sensitivity"),
                                         (tn / (F.sum(1 - y) + eps)).alias("specificity"))


def specificity_at_sensitivity(pred: DataFrame, sensitivity: float, score_col: str = "score",
                               label_col: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """Largest ``1 - fpr`` among ROC points with ``tpr >= sensitivity``."""
    pred, g, extra = _grouped(pred, group_cols)
    roc = roc_curve(pred, score_col, label_col, g, digits=15)
    return roc.where(F.col("tpr") >= sensitivity).groupBy(*g).agg(F.max(1 - F.col("fpr")).alias("specificity")).drop(*extra)


def roc_on_grid(spark: SparkSession, pred: DataFrame, score_col: str = "score", label_col: str = "label",
                group_cols: Sequence[str] = (), n_grid: int = 100) -> DataFrame:
    """ROC tpr linearly interpolated at ``n_grid`` even fpr points per group.

    Each distinct score is the segment from the previous point ``(fp - n_neg,
    tp - n_pos)`` to its own; a grid point strictly inside a rising segment is
    interpolated there, a grid point equal to a point's fpr takes the highest
    tpr at that fpr (the last point, as with sorted ``interp``).
    """
    pred, g, extra = _grouped(pred, group_cols)
    b = _curve_base(pred, score_col, label_col, g)
    x1, y1 = F.try_divide(F.col("fp"), F.col("N")), F.try_divide(F.col("tp"), F.col("P"))
    x0, y0 = F.try_divide((F.col("fp") - F.col("n_neg")), F.col("N")), F.try_divide((F.col("tp") - F.col("n_pos")), F.col("P"))
    step = 1.0 / (n_grid - 1)
    seg = b.select(*g, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    # grid indices a segment can touch: from floor(x0 / step) to ceil(x1 / step)
    cand = seg.select("*", F.explode(F.sequence(F.floor(F.col("x0") / step).cast("int"),
                                                F.least(F.ceil(F.col("x1") / step).cast("int"), F.lit(n_grid - 1))))
                      .alias("i")).withColumn("x", F.col("i") * F.lit(step))
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1"))
    on_end = F.col("x") == F.col("x1")
    at_start = (F.col("x") == F.col("x0")) & (F.col("x0") == 0)   # grid point 0 before any false positive
    val = F.when(inside, F.col("y0") + (F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))) \
        .when(on_end, F.col("y1")).when(at_start, F.col("y0"))
    pts = cand.select(*g, "i", "x", val.alias("tpr")).where(F.col("tpr").isNotNull())
    return pts.groupBy(*g, "i", "x").agg(F.max("tpr").alias("tpr")).drop(*extra)


def mean_roc(spark: SparkSession, pred: DataFrame, fold_col: str = "fold", score_col: str = "score",
             label_col: str = "label", group_cols: Sequence[str] = (), n_grid: int = 100,
             digits: int = 9) -> DataFrame:
    """Mean of the fold ROC curves on the grid, first point 0 and last 1, and its
    trapezoid area (one value per group, repeated on each grid row)."""
    pred, g, extra = _grouped(pred, group_cols)
    per_fold = roc_on_grid(spark, pred, score_col, label_col, g + [fold_col], n_grid)
    mean = per_fold.groupBy(*g, "i", "x").agg(F.avg("tpr").alias("tpr"))
    mean = mean.withColumn("tpr", F.when(F.col("i") == 0, F.lit(0.0)).when(F.col("i") == n_grid - 1, F.lit(1.0))
                           .otherwise(F.col("tpr")))
    # the grid has n_grid rows per group: previous point by index join, the area by
    # a window over those n_grid rows
    prev = mean.select(*g, (F.col("i") + 1).alias("i"), F.col("x").alias("x0"), F.col("tpr").alias("t0"))
    seg = mean.join(prev, g + ["i"], "left").withColumn(
        "_s", F.coalesce((F.col("x") - F.col("x0")) * (F.col("tpr") + F.col("t0")) / 2, F.lit(0.0)))
    out = seg.withColumn("auc", F.sum("_s").over(Window.partitionBy(*g)))
    return out.select(*g, "i", F.round("x", digits).alias("x"), F.round("tpr", digits).alias("tpr"),
                      F.round("auc", digits).alias("auc")).drop(*extra)


SCORES = ("accuracy", "precision", "recall", "f1", "balanced_accuracy")


def fold_scores(pred: DataFrame, point_cols: Sequence[str], fold_col: str = "fold", label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Every score of every (point, fold) from one aggregate of pooled fold predictions: ``point, fold, metric, value``.
    Undefined ratios are 0."""
    n = lambda y, q: F.sum(F.when((F.col(label_col) == y) & (F.col(pred_col) == q), 1).otherwise(0)).cast("double")
    c = pred.groupBy(*point_cols, fold_col).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    precision, recall, specificity = share("tp", "fp"), share("tp", "fn"), share("tn", "fp")
    values = {"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": precision, "recall": recall,
              "f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), "balanced_accuracy": (recall + specificity) / 2}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in SCORES])).alias("s")
    return c.select(*point_cols, fold_col, each).select(*point_cols, fold_col, "s.*")


def search_table(pred: DataFrame, point_cols: Sequence[str], refit: str = "f1", digits: int = 9, **columns) -> DataFrame:
    """``point, metric, mean, std, rank, best``: mean and population std over the folds of every score, the rank of the
    point by it, and whether the point is the first by ``refit`` (ties to the smallest point)."""
    if refit not in SCORES:
        raise ValueError(refit)
    t = fold_scores(pred, point_cols, **columns).groupBy(*point_cols, "metric") \
        .agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("std"))
    # windows over one row per point and metric
    t = t.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(F.desc("mean"))))
    first = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("mean"), *point_cols))
    t = t.withColumn("_first", (first == 1) & (F.col("metric") == refit))
    return t.withColumn("best", F.max("_first").over(Window.partitionBy(*point_cols))).drop("_first")
