"""Ordered operators without single-task windows.

A window with no PARTITION BY, or partitioned by a key that may hold a third of
all rows, runs in one task.  ``running_totals`` computes inclusive running sums
over an order with the work spread over range buckets:

1. cut the order column at approximate quantiles (a bounded list on the driver),
2. per (group, bucket) totals -> offsets by a window over at most B rows per group,
3. a window partitioned by (group, bucket) adds the local running sum to the offset.

Callers aggregate to one row per (group, order key) first (distinct scores,
distinct values), so equal keys never straddle buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import shuffle_partitions

BUCKET = "_wl_bucket"
# Upper bound on range buckets (each bucket is one window task).
MAX_BUCKETS = 8192


def _with_bucket(df: DataFrame, key: str, n_buckets: int) -> DataFrame:
    """Add the range bucket of ``key``: boundaries at approximate quantiles (a
    bounded list on the driver), looked up by binary search (``Bucketizer``)."""
    if n_buckets <= 1:
        return df.withColumn(BUCKET, F.lit(0))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.approxQuantile(key, probs, 1.0 / (4 * n_buckets))
    bounds = sorted({float(b) for b in bounds if b is not None and b == b})
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf")] + bounds + [float("inf")]
    out = Bucketizer(splits=splits, inputCol=key, outputCol=BUCKET, handleInvalid="keep").transform(df)
    return out.withColumn(BUCKET, F.col(BUCKET).cast("int"))


def _grouped(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Give an ungrouped input one constant group so every step stays an equi-join."""
    parts = list(group_cols)
    if parts:
        return df, parts, []
    return df.withColumn("_wl_all", F.lit(0)), ["_wl_all"], ["_wl_all"]


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), descending: bool = False,
                   n_buckets: int | None = None, prefix: str = "cum_",
                   with_totals: bool = False) -> DataFrame:
    """Add ``cum_<c>`` = inclusive running sum of each ``c`` over ``order_col``
    (and ``tot_<c>``, the group total, with ``with_totals``).

    ``(partition_cols, order_col)`` must be unique.  ``descending`` sums from the
    largest key down.  Buckets default to the shuffle partition count.  Group
    totals ride on the offsets join (keyed by group and bucket), so callers never
    join a per-group total back on a key that may be constant.
    """
    spark = df.sparkSession
    parts = list(partition_cols)
    key = "_wl_key"
    src = df.withColumn(key, (-F.col(order_col) if descending else F.col(order_col)).cast("double"))
    if n_buckets is None:
        n_buckets = min(shuffle_partitions(spark), MAX_BUCKETS)
    if n_buckets > 1:
        src = src.persist(StorageLevel.MEMORY_AND_DISK)
    if n_buckets <= 1:
        # one bucket: no offsets, a plain window per group (only for small inputs)
        w1 = (Window.partitionBy(*parts) if parts else Window.partitionBy()).orderBy(key) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = src
        for c in sum_cols:
            out = out.withColumn(f"{prefix}{c}", F.sum(c).over(w1))
            if with_totals:
                wg = Window.partitionBy(*parts) if parts else Window.partitionBy()
                out = out.withColumn(f"tot_{c}", F.sum(c).over(wg))
        return out.drop(key)
    src = _with_bucket(src, key, n_buckets)
    gb = parts + [BUCKET]
    totals = src.groupBy(*gb).agg(*[F.sum(c).alias(f"_wl_t_{c}") for c in sum_cols])
    w_off = Window.partitionBy(*parts).orderBy(BUCKET) if parts else Window.orderBy(BUCKET)
    w_off = w_off.rowsBetween(Window.unboundedPreceding, -1)
    # at most n_buckets rows per group here
    w_grp = Window.partitionBy(*parts) if parts else Window.partitionBy()
    offsets = totals.select(*gb, *[F.coalesce(F.sum(f"_wl_t_{c}").over(w_off), F.lit(0)).alias(f"_wl_o_{c}")
                                   for c in sum_cols],
                            *([F.sum(f"_wl_t_{c}").over(w_grp).alias(f"tot_{c}") for c in sum_cols]
                              if with_totals else []))
    w = Window.partitionBy(*gb).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # null-safe: a null group is a group like any other
    named = offsets.select(*[F.col(c).alias(f"_wl_k_{c}") for c in gb], *[c for c in offsets.columns if c not in gb])
    same = None
    for c in gb:
        eq = src[c].eqNullSafe(named[f"_wl_k_{c}"])
        same = eq if same is None else same & eq
    out = src.join(named, same, "inner").drop(*[f"_wl_k_{c}" for c in gb])
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_wl_o_{c}") + F.sum(c).over(w))
    return out.drop(key, BUCKET, *[f"_wl_o_{c}" for c in sum_cols])


def row_numbers(df: DataFrame, order_col: str, partition_cols: Sequence[str] = (),
                name: str = "row_number", descending: bool = False,
                n_buckets: int | None = None, size_col: str | None = None) -> DataFrame:
    """1-based row number over a unique numeric order, spread over buckets
    (with ``size_col``, also the group size)."""
    out = running_totals(df.withColumn("_wl_one", F.lit(1).cast("long")), order_col, ["_wl_one"],
                         partition_cols, descending=descending, n_buckets=n_buckets,
                         with_totals=size_col is not None)
    out = out.withColumnRenamed("cum__wl_one", name).drop("_wl_one")
    return out.withColumnRenamed("tot__wl_one", size_col) if size_col else out


def ntile_folds(df: DataFrame, order_col: str, k: int, partition_cols: Sequence[str] = (),
                name: str = "fold", n_buckets: int | None = None) -> DataFrame:
    """``ntile(k) OVER (PARTITION BY p ORDER BY o) - 1`` without a one-task window.

    Blocks are cut in order; the first ``n mod k`` blocks are one row larger.
    """
    parts = list(partition_cols)
    ranked = row_numbers(df, order_col, parts, name="_wl_rn", n_buckets=n_buckets, size_col="_wl_n")
    r = F.col("_wl_rn") - 1
    q = F.floor(F.col("_wl_n") / k)
    rem = F.col("_wl_n") % k
    big = (q + 1) * rem
    fold = F.when(r < big, F.floor(r / (q + 1))).otherwise(rem + F.floor((r - big) / F.greatest(q, F.lit(1))))
    return ranked.withColumn(name, fold.cast("int")).drop("_wl_rn", "_wl_n")


def upper_median(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                 name: str = "median", n_buckets: int | None = None) -> DataFrame:
    """``sorted(values)[n // 2]`` per group (the upper median for even n).

    Distinct values are counted first (partial aggregation), then the running
    count finds the first value whose cumulative count reaches ``n // 2 + 1``.
    """
    parts = list(group_cols)
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*parts, value_col).agg(F.count(F.lit(1)).alias("_wl_c"))
    cum = running_totals(counts, value_col, ["_wl_c"], parts, n_buckets=n_buckets, with_totals=True)
    t = F.floor(F.col("tot__wl_c") / 2) + 1
    hit = cum.where((F.col("cum__wl_c") >= t) & (F.col("cum__wl_c") - F.col("_wl_c") < t))
    return hit.select(*parts, F.col(value_col).alias(name))


def gini(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), name: str = "gini",
         shift_negative: bool = True, epsilon: float = 1e-7,
         n_buckets: int | None = None) -> DataFrame:
    """Gini coefficient per group: values shifted to >= 0, plus ``epsilon``, sorted,
    ``sum((2i - n - 1) x_i) / (n sum x)``.

    Ties do not change the sum, so rows are first reduced to (value, count); the
    ranks of a run of ``c`` equal values starting after ``C`` rows sum to
    ``c*C + c(c+1)/2``.
    """
    parts = list(group_cols)
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*parts, value_col).agg(F.count(F.lit(1)).alias("_wl_c"))
    cum = running_totals(counts, value_col, ["_wl_c"], parts, n_buckets=n_buckets)
    # sum_i (2i - n - 1)(x_i + s + eps) = 2A - (n + 1) B with A = sum(rank_sum * x), B = sum(c * x):
    # the shift s and eps cancel in the numerator; they only enter the denominator.
    x = F.col(value_col).cast("double")
    c = F.col("_wl_c").cast("double")
    before = (F.col("cum__wl_c") - F.col("_wl_c")).cast("double")
    rank_sum = c * before + c * (c + 1) / 2
    agg = cum.groupBy(*parts).agg(F.sum(rank_sum * x).alias("_a"), F.sum(c * x).alias("_b"),
                                  F.sum(c).alias("_n"), F.min(x).alias("_min"))
    shift = F.when(F.lit(shift_negative) & (F.col("_min") < 0), -F.col("_min")).otherwise(F.lit(0.0))
    num = 2 * F.col("_a") - (F.col("_n") + 1) * F.col("_b")
    den = F.col("_n") * (F.col("_b") + F.col("_n") * (shift + F.lit(epsilon)))
    return agg.select(*parts, (num / den).alias(name))
