"""Feature attribution: named importances, stability over refits, permutation
importance, exact linear contributions and sampled Shapley values.

Permutation variants of all features are built in one frame keyed
by ``feature`` and scored by a single ``model.transform``; the row shuffle is a
join of two distributed row numberings (id order against hash order), never a
driver-side shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators.boosting import list_array
from wardlens.operators.ensemble import Ensemble, ensemble_of
from wardlens.operators.evaluate import roc_auc
from wardlens.operators.folds import hash_bits, hash_numbers
from wardlens.operators.ordered import row_numbers
from wardlens.session import shuffle_partitions

#: Vectors that are scored at a time.
TOGETHER = 20_000


def named_importances(model, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Tree importances zipped with feature names, ranked (1 = most important)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    rows = sorted(((f, float(v)) for f, v in zip(features, imp)), key=lambda r: (-r[1], r[0]))
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(rows) if top is None or i < top]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


def importance_runs(fit_with_seed, df: DataFrame, features: Sequence[str], seeds: Sequence[int],
                    top: int = 7, threads: int = 4) -> DataFrame:
    """Importances of repeated fits (one per seed, in a thread pool), long form with an
    in-top flag; runs x features rows, made into one frame."""
    from concurrent.futures import ThreadPoolExecutor

    def one(seed):
        imp = fit_with_seed(seed, df).featureImportances.toArray()
        ranked = sorted(((f, float(v)) for f, v in zip(features, imp)), key=lambda r: (-r[1], r[0]))
        return [(f, v, i + 1, int(seed), i < top) for i, (f, v) in enumerate(ranked)]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        rows = [r for part in pool.map(one, seeds) for r in part]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, rank int, run int, in_top boolean")


def _hash(col, salt: int):
    return hash_bits(col, salt)


def permutation_importance(model, df: DataFrame, features: Sequence[str], key: str, label_col: str = "label",
                           seed: int = 1, features_col: str = "features") -> DataFrame:
    """Drop in ROC area when one column is shuffled across rows, per feature.

    The shuffle pairs the row ranked i in key order with the row ranked i in a
    seeded hash order; all features are permuted in one frame and scored once.
    """
    base = df.select(key, label_col, *features)
    by_key = row_numbers(base, key, name="_rn")
    by_hash = row_numbers(base.withColumn("_h", _hash(key, seed)), "_h", name="_rn") \
        .select("_rn", *[F.col(f).alias(f"_p_{f}") for f in features])
    paired = by_key.join(by_hash, "_rn", "inner")
    # every variant (none, or one feature taken from the partner row) as one explode
    structs = [F.struct(F.lit(f or "_none_").alias("feature"),
                        *[(F.col(f"_p_{c}") if c == f else F.col(c)).alias(c) for c in features])
               for f in [None, *features]]
    variants = paired.select(key, label_col, F.explode(F.array(*structs)).alias("_v")) \
        .select(key, label_col, "_v.*")
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=list(features), outputCol=features_col, handleInvalid="keep").transform(variants)
    scored = model.transform(x).withColumn("score", vector_to_array("probability")[1])
    auc = roc_auc(scored, "score", label_col, ["feature"])
    # one row per feature here: the unpermuted area by a window over these rows
    from pyspark.sql import Window
    base = F.max(F.when(F.col("feature") == "_none_", F.col("auc"))).over(Window.partitionBy())
    return auc.withColumn("base_auc", base).where(F.col("feature") != "_none_") \
        .select("feature", F.round(F.col("base_auc") - F.col("auc"), 9).alias("importance"))


def linear_contributions(df: DataFrame, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Exact Shapley values of a linear score: ``w_j (x_j - mean_j)``; mean |value|
    per feature over all rows (one aggregate for the means, one for the result)."""
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    cols = [F.abs(F.lit(float(w)) * (F.col(f) - F.lit(float(means[f] or 0.0)))).alias(f)
            for f, w in zip(features, weights)]
    wide = df.select(*cols).agg(*[F.avg(f).alias(f) for f in features])
    stack = "stack({n}, {p}) AS (feature, mean_abs)".format(n=len(features), p=", ".join(f"'{f}', `{f}`" for f in features))
    return wide.selectExpr(stack)


def sampled_shapley(model, rows: DataFrame, background: Sequence[Sequence[float]], features: Sequence[str],
                    key: str, n_perm: int = 8, features_col: str = "features", weights: Sequence[int] | None = None) -> DataFrame:
    """Sampled Shapley values (Strumbelj and Kononenko, 2014) of the positive-class
    probability, averaged as mean |value| per feature.

    For each row and sample m: a feature order and a background row are drawn
    from a hash of (key, m), background rows in proportion to ``weights``; the model scores the background row with the
    first 0, 1, ... features of the order taken from x, and a feature's value is the rise of the score where it joins.
    The vectors of boosted trees are scored in the row's own task by patterns of steps (``ensemble.py``); for other models
    rows x samples x (features + 1) vectors are exploded and scored by one ``transform``.  Only one row a key and its
    sums are shuffled after it.
    """
    nf, spark = len(features), rows.sparkSession
    trees = ensemble_of(getattr(model, "model", model), nf)
    if trees:
        return _mean_values(_tree_values(trees, rows, background, features, key, n_perm, weights or [1] * len(background)), features, n_perm)
    bg = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in background])
    x = rows.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    # a row is some hundred vectors: every core gets rows
    x = x.repartition(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("_m"))
    upto = [sum((weights or [1] * len(background))[:i + 1]) for i in range(len(background))]
    x = x.withColumn("_h", hash_bits(key, F.col("_m")) % int(upto[-1]))
    drawn = sum((F.when(F.col("_h") >= int(u), 1).otherwise(0) for u in upto), F.lit(0))
    # random order: sort features by a hash of (key, m, feature)
    order = F.sort_array(F.array(*[F.struct(hash_bits(key, F.concat_ws(":", F.col("_m").cast("string"), F.lit(f"f{i}"))).alias("r"), F.lit(i).alias("i"))
                                   for i in range(nf)]))
    x = x.withColumn("_z", F.element_at(bg, drawn + 1)).withColumn("_order", order["i"])
    x = x.withColumn("_pos", F.array(*[F.array_position("_order", F.lit(i)) for i in range(nf)]))
    x = x.select(key, "_x", "_z", "_order", "_pos", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("_t"))
    vector = F.array(*[F.when(F.col("_pos")[i] <= F.col("_t"), F.col("_x")[i]).otherwise(F.col("_z")[i]) for i in range(nf)])
    # the score with t features adds to the t-th and takes from the next
    steps = x.select(key, F.when(F.col("_t") > 0, F.get("_order", F.col("_t") - 1)).alias("_up"),
                     F.get("_order", F.col("_t")).alias("_down"), array_to_vector(vector).alias(features_col))
    scored = model.transform(steps).withColumn("_p", vector_to_array("probability")[1])
    phi = scored.groupBy(key).agg(*[F.sum(F.when(F.col("_up") == i, F.col("_p")).when(F.col("_down") == i, -F.col("_p"))).alias(f"_s{i}")
                                    for i in range(nf)])
    return _mean_values(phi, features, n_perm)


def _mean_values(phi: DataFrame, features: Sequence[str], n_perm: int) -> DataFrame:
    """``feature, mean_abs, mean`` of each key's sums over its samples."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"_s{i}") / n_perm).alias("phi")) for i, f in enumerate(features)])
    return phi.select(F.explode(each).alias("_e")).groupBy("_e.feature") \
        .agg(F.avg(F.abs("_e.phi")).alias("mean_abs"), F.avg("_e.phi").alias("mean"))


def _tree_values(trees: Ensemble, rows: DataFrame, background: Sequence[Sequence[float]], features: Sequence[str], key: str,
                 n_perm: int, weights: Sequence[int]) -> DataFrame:
    """``key, _s0, _s1, ...``: each key's sums of the score's rises, with the draws of ``hash_bits``."""
    nf, spark = len(features), rows.sparkSession
    upto = np.cumsum(np.asarray(weights, np.int64))
    other = trees.steps(np.asarray([[float(v) for v in b] for b in background]).reshape(-1, nf))
    salts = [b"%d" % m for m in range(n_perm)] + [b"%d:f%d" % (m, i) for m in range(n_perm) for i in range(nf)]
    x = rows.select(key, F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary").alias("_k"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    x = x.repartition(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)))
    step = max(1, TOGETHER // (n_perm * (nf + 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch["_k"].to_pylist(), batch["_x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, nf)
            sums = np.zeros((len(keys), nf))
            for low in range(0, len(keys), step):
                part = slice(low, low + step)
                n = len(keys[part])
                drawn = hash_numbers(keys[part], salts)
                z = np.searchsorted(upto, drawn[:, :n_perm].ravel() % upto[-1], side="right")
                # order of the features by hash; ties by their place
                order = np.argsort(drawn[:, n_perm:].reshape(-1, nf), axis=1, kind="stable")
                subsets = np.zeros((len(order), nf + 1), np.int64)
                np.cumsum(1 << order, axis=1, out=subsets[:, 1:])
                p = trees.mixed([np.repeat(s, n_perm) for s in trees.steps(values[part])], [s[z] for s in other], subsets)
                cell = np.repeat(np.arange(n), n_perm)[:, None] * nf + order
                sums[part] = np.bincount(cell.ravel(), np.diff(p, axis=1).ravel(), n * nf).reshape(n, nf)
            yield pa.RecordBatch.from_arrays([batch[key], list_array(sums)], [key, "_s"])
    ddl = f"`{key}` {x.schema[key].dataType.simpleString()}, _s array<double>"
    return x.mapInArrow(run, ddl).groupBy(key).agg(*[F.sum(F.col("_s")[i]).alias(f"_s{i}") for i in range(nf)])
