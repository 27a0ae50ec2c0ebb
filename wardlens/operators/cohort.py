"""Cluster profiles: counts, rates, shares, means, rollups, correlations, category
counts, top categories, dissimilarity / overlap, term counts and summaries.

Every operator is a grouped aggregate (map-side partial aggregation) or a
window over already-aggregated rows whose count is bounded by the number of
clusters, categories or features -- never by the number of stays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.operators.ordered import gini, upper_median

# Pairwise tables are built for at most this many groups (clusters).
MAX_PAIR_GROUPS = 2000


def group_means(df: DataFrame, group_col: str, cols: Sequence[str], digits: int = 6) -> DataFrame:
    return df.groupBy(group_col).agg(*[F.round(F.avg(c), digits).alias(c) for c in cols])


def rollup_means_long(df: DataFrame, group_col: str, cols: Sequence[str], all_label: str = "All Data",
                      digits: int = 6) -> DataFrame:
    """Mean of each column per group plus the all-rows mean (one rollup pass),
    unpivoted to ``(group, feature, mean)``."""
    r = df.rollup(group_col).agg(F.grouping(group_col).alias("_g"), *[F.avg(c).alias(c) for c in cols])
    r = r.withColumn(group_col, F.when(F.col("_g") == 1, F.lit(all_label)).otherwise(F.col(group_col).cast("string")))
    stack = "stack({n}, {pairs}) AS (feature, mean)".format(
        n=len(cols), pairs=", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols))
    return r.selectExpr(group_col, stack).withColumn("mean", F.round("mean", digits))


def class_weights(df: DataFrame, label_col: str = "label", group_cols: Sequence[str] = ()) -> DataFrame:
    """negatives / positives per group (null when no positive)."""
    return df.groupBy(*group_cols).agg(
        F.sum(F.when(F.col(label_col) == 0, 1).otherwise(0)).cast("long").alias("n_neg"),
        F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("long").alias("n_pos")) \
        .withColumn("class_weight", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double")))


def label_correlations(df: DataFrame, cols: Sequence[str], label_col: str = "label",
                       digits: int = 6) -> DataFrame:
    """Pearson correlation of each column with the label, long form; null for a
    constant column (population covariance over population deviations)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        y = F.col(label_col).cast("double")
        # deviations over the same complete pairs as the covariance
        both = x.isNotNull() & y.isNotNull()
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))).alias(c))
    wide = df.agg(*aggs)
    stack = "stack({n}, {pairs}) AS (feature, corr)".format(
        n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols))
    return wide.selectExpr(stack).withColumn("corr", F.round("corr", digits))


def extremes(df: DataFrame, value_col: str, key_col: str, k: int = 5) -> DataFrame:
    """Rows among the ``k`` largest or ``k`` smallest values (ties by key), sorted
    by value.  Input is one row per feature, so the windows are small."""
    hi = F.row_number().over(Window.orderBy(F.col(value_col).desc_nulls_last(), key_col))
    lo = F.row_number().over(Window.orderBy(F.col(value_col).asc_nulls_last(), key_col))
    return df.where(F.col(value_col).isNotNull()).withColumn("_hi", hi).withColumn("_lo", lo) \
        .where((F.col("_hi") <= k) | (F.col("_lo") <= k)).drop("_hi", "_lo")


def category_counts(df: DataFrame, group_col: str, array_col: str, item: str = "category") -> DataFrame:
    """Rows per (group, item) after exploding the item array."""
    return df.select(group_col, F.explode(array_col).alias(item)).groupBy(group_col, item) \
        .agg(F.count(F.lit(1)).alias("n"))


def top_k_per_group(counts: DataFrame, group_col: str, item: str, k: int = 10, value: str = "n") -> DataFrame:
    """The ``k`` most frequent items per group, ties broken by item; ranks 1..k."""
    w = Window.partitionBy(group_col).orderBy(F.col(value).desc(), F.col(item))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dissimilarity(counts: DataFrame, group_col: str, item: str, value: str = "n",
                  n_groups: int | None = None) -> DataFrame:
    """Sum over all unordered pairs of groups and all items of ``|n_i - n_j|``
    (a missing item counts 0), and the number of (pair, item) with both present.

    For one item with counts sorted ascending over all ``k`` groups (zeros for
    absent groups), ``sum_{i<j} |x_i - x_j| = sum_r (2r - k - 1) x_r``; absent
    zeros add nothing, so only the present counts are ranked -- within one item,
    i.e. at most ``k`` rows per window.  Overlaps per item are ``C(m, 2)``.
    """
    # with r_all = k - m + r: (2 r_all - k - 1) x = k x + (2r - 2m - 1) x, so k enters only
    # through k * sum(x) and is counted in the same final aggregate (no extra job).
    counts = counts.where(F.col(group_col).isNotNull())
    w_cnt = Window.partitionBy(item)
    w_rank = Window.partitionBy(item).orderBy(F.col(value), F.col(group_col))
    ranked = counts.withColumn("_m", F.count(F.lit(1)).over(w_cnt)).withColumn("_r", F.row_number().over(w_rank))
    terms = ranked.select(item, group_col, F.col(value).alias("_x"),
                          ((2 * F.col("_r") - 2 * F.col("_m") - 1) * F.col(value)).alias("_t"),
                          F.when(F.col("_r") == 1, F.col("_m") * (F.col("_m") - 1) / 2).otherwise(0).alias("_o"))
    # groups without a name are left out here and in the pair table alike
    k = F.lit(n_groups) if n_groups is not None else F.countDistinct(group_col)
    agg = terms.agg((k * F.sum("_x") + F.sum("_t")).cast("long").alias("score"),
                    F.sum("_o").cast("long").alias("overlap"), k.alias("_k"))
    pairs = F.col("_k") * (F.col("_k") - 1) / 2
    return agg.select("score", "overlap",
                      F.round(F.try_divide(F.col("overlap").cast("double"), pairs.cast("double")), 6).alias("mean_overlap"))


def pair_dissimilarity(counts: DataFrame, group_col: str, item: str, value: str = "n") -> DataFrame:
    """Per unordered pair of groups: ``sum |n_i - n_j|`` over the union of items and
    the number of shared items.  Pairs of groups (clusters), not of rows: the
    output has ``C(k, 2)`` rows; the work is a full outer join per pair on item."""
    # the distinct groups are the clusters (bounded, checked); their pairs are
    # listed from that short list, so the plan has equi-joins only
    names = [r[0] for r in counts.select(group_col).distinct().limit(MAX_PAIR_GROUPS + 1).collect()]
    if len(names) > MAX_PAIR_GROUPS:
        raise ValueError(f"more than {MAX_PAIR_GROUPS} groups: pairwise table too large")
    names = sorted(n for n in names if n is not None)
    spark = counts.sparkSession
    gtype = dict(counts.dtypes)[group_col]
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1:]],
                                  f"ga {gtype}, gb {gtype}")
    a = counts.select(F.col(group_col).alias("ga"), F.col(item).alias("it"), F.col(value).alias("na"))
    b = counts.select(F.col(group_col).alias("gb"), F.col(item).alias("it"), F.col(value).alias("nb"))
    from wardlens.operators.codes import bounded_broadcast
    pairs = bounded_broadcast(pairs)   # C(k, 2) rows for k groups, checked
    pa = pairs.join(a, "ga")
    pb = pairs.join(b, "gb")
    full = pa.join(pb, ["ga", "gb", "it"], "full_outer")
    return full.groupBy("ga", "gb").agg(
        F.sum(F.abs(F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0)))).cast("long").alias("score"),
        F.sum((F.col("na").isNotNull() & F.col("nb").isNotNull()).cast("int")).cast("long").alias("overlap"))


def term_counts(df: DataFrame, group_col: str, text_col: str, lower: bool = True) -> DataFrame:
    """Word frequency per group over whole texts (split on non-word characters)."""
    t = F.lower(F.col(text_col)) if lower else F.col(text_col)
    words = df.select(group_col, F.explode(F.split(t, r"[^\p{L}\p{N}]+")).alias("term"))
    return words.where(F.length("term") > 0).groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("n"))


def metric_summary(report: DataFrame, group_cols: Sequence[str], metrics: Sequence[str],
                   digits: int = 6, support_col: str | None = "support") -> DataFrame:
    """Mean and upper median of each metric per group (e.g. per class over clusters),
    long form ``(group..., metric, mean, median)``; with a support column also the
    support-weighted mean, so a one-row cluster does not weigh like a large one."""
    weighted = support_col is not None and support_col in report.columns
    stack = "stack({n}, {pairs}) AS (metric, value{w})".format(
        n=len(metrics), w=", _w" if weighted else "",
        pairs=", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" + (f", CAST(`{support_col}` AS DOUBLE)" if weighted else "")
                        for m in metrics))
    long = report.selectExpr(*group_cols, stack)
    aggs = [F.round(F.avg("value"), digits).alias("mean")]
    if weighted:
        aggs.append(F.round(F.try_divide(F.sum(F.col("value") * F.col("_w")), F.sum("_w")), digits).alias("weighted_mean"))
    means = long.groupBy(*group_cols, "metric").agg(*aggs)
    med = upper_median(long, "value", list(group_cols) + ["metric"], name="median")
    return means.join(med, list(group_cols) + ["metric"], "left")


def gini_by_group(df: DataFrame, value_col: str, group_col: str, digits: int = 6) -> DataFrame:
    return gini(df, value_col, [group_col]).withColumn("gini", F.round("gini", digits))


def importance_stats(df: DataFrame, feature_col: str = "feature", value_col: str = "importance",
                     top_col: str | None = "in_top") -> DataFrame:
    """Mean and population std of an importance over repeated fits, and how often a
    feature was in the top list."""
    aggs = [F.avg(value_col).alias("mean"), F.stddev_pop(value_col).alias("std")]
    if top_col:
        aggs.append(F.sum(F.col(top_col).cast("int")).cast("long").alias("times_in_top"))
    return df.groupBy(feature_col).agg(*aggs)


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str,
                    how: str = "left") -> DataFrame:
    """Join two frames row by row in declared orders (the safe form of an index
    join): both sides get a distributed row number, then an equi-join on it."""
    from wardlens.operators.ordered import row_numbers
    a = row_numbers(left, left_order, name="_pos")
    b = row_numbers(right, right_order, name="_pos")
    return a.join(b, "_pos", how).drop("_pos")


def pivot_report(report: DataFrame, class_col: str = "class", metrics: Sequence[str] = ("precision", "recall", "f1"),
                 classes: Sequence = (0, 1), group_cols: Sequence[str] = ()) -> DataFrame:
    """Metric x class table: one row per (group, metric), one column per class."""
    stack = "stack({n}, {p}) AS (metric, value)".format(
        n=len(metrics), p=", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics))
    long = report.selectExpr(*group_cols, class_col, stack)
    return long.groupBy(*group_cols, "metric").pivot(class_col, list(classes)).agg(F.first("value")) \
        .select(*group_cols, "metric", *[F.col(str(c)).alias(f"class_{c}") for c in classes])


def count_concentration(df: DataFrame, group_col: str, item_col: str, digits: int = 6) -> DataFrame:
    """Order-free concentration of the items within each group: Gini of the item
    counts and Shannon entropy (natural log) of the item shares.

    Entropy is one aggregate over the (group, item) counts:
    ``H = ln N - sum(n ln n) / N`` with ``N = sum(n)``."""
    counts = df.groupBy(group_col, item_col).agg(F.count(F.lit(1)).alias("n"))
    g = gini(counts, "n", [group_col]).withColumn("gini", F.round("gini", digits))
    ent = counts.groupBy(group_col).agg(
        F.round(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n"), digits).alias("entropy"),
        F.count(F.lit(1)).alias("n_items"))
    return g.join(ent, group_col, "inner")
