"""Registered queries on bagged trees: out-of-bag score and exact contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators import evaluate
from wardlens.operators import forest as fo
from wardlens.plans.catalog import FEATURES, _stay_features, register


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardlens.session import tmp_output_dir
    path = tmp_output_dir(spark, "stays")
    _stay_features(spark, sf_dir).select("hadm_id", "label", *FEATURES).write.parquet(path)
    return spark.read.parquet(path)


@register("forest_oob_score")
def forest_oob_score(spark: SparkSession, sf_dir: str, trees: int = 20) -> DataFrame:
    """Out-of-bag score of a forest: rows, rows that some tree did not see, accuracy and ROC area over these, beside
    the accuracy on the rows that the trees saw."""
    df = _rows(spark, sf_dir)
    model = fo.fit_forest(df, FEATURES, trees, "hadm_id")
    s = fo.scores(df, model, ["label"]).checkpoint(eager=True)
    right = lambda c: ((F.col(c) > 0.5).cast("int") == F.col("label")).cast("double")
    table = s.agg(F.count(F.lit(1)).alias("n"), F.count("oob_score").alias("n_scored"),
                  F.avg(F.when(F.col("oob_score").isNotNull(), right("oob_score"))).alias("oob_accuracy"), F.avg(right("score")).alias("seen_accuracy"))
    area = evaluate.roc_auc(s.where("oob_score IS NOT NULL").select("label", F.col("oob_score").alias("score"))).select(F.col("auc").alias("oob_auc"))
    return table.join(area, F.lit(True), "left")   # one row on each side


@register("forest_contributions")
def forest_contributions(spark: SparkSession, sf_dir: str, trees: int = 20) -> DataFrame:
    """Exact tree contributions of every stay: per feature the mean and the mean size, and the largest gap over all
    stays between base + contributions and the score."""
    df = _rows(spark, sf_dir)
    model = fo.fit_forest(df, FEATURES, trees, "hadm_id")
    phi = fo.contributions(df, model, ["hadm_id"]).join(fo.scores(df, model, ["hadm_id"]), "hadm_id")
    total = F.aggregate("contributions", F.lit(fo.base_score(model)), lambda a, v: a + v)
    each = phi.select(F.abs(total - F.col("score")).alias("gap"), F.posexplode("contributions").alias("at", "phi"))
    names = F.array(*[F.lit(f) for f in FEATURES])
    return each.groupBy("at").agg(F.avg("phi").alias("mean"), F.avg(F.abs("phi")).alias("mean_abs"), F.max("gap").alias("largest_gap")) \
        .select(F.element_at(names, F.col("at") + 1).alias("feature"), "mean", "mean_abs", "largest_gap")
