"""Registered queries on sparse stay x category matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators.sparse import sparse_svd, tfidf_long
from wardlens.plans.catalog import DICT_CTE, SETS_CTE, _stored_sets, register
from wardlens.session import spread

_TFIDF_SQL = f"""
WITH {DICT_CTE}, {SETS_CTE}, t AS (SELECT hadm_id, u.item FROM sets, unnest(sets.cats) u(item)),
f AS (SELECT item, ln((1.0 + (SELECT count(*) FROM sets)) / (1.0 + count(*))) + 1 AS idf FROM t GROUP BY item),
w AS (SELECT hadm_id, item, idf, sqrt(sum(idf * idf) OVER (PARTITION BY hadm_id)) AS norm FROM t JOIN f USING (item))
SELECT hadm_id, item, round(idf / norm, 9) AS weight FROM w"""


@register("category_tfidf_long", _TFIDF_SQL)
def category_tfidf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tf-idf of the stays' category sets with the category named: one row per present (stay, category)."""
    return tfidf_long(_stored_sets(spark, sf_dir), "hadm_id", "categories").select("hadm_id", "item", F.round("weight", 9).alias("weight"))


@register("category_svd")
def category_svd(spark: SparkSession, sf_dir: str, dims: int = 10) -> DataFrame:
    """Truncated SVD of the sparse tf-idf matrix: every stay's projection, the singular values and the share of the
    matrix's squares that they hold."""
    t = tfidf_long(_stored_sets(spark, sf_dir), "hadm_id", "categories").select(F.col("hadm_id").alias("row"), F.col("item").alias("col"), F.col("weight").alias("value"))
    t = spread(t, "tfidf")   # read by the fit and by the sum of squares
    s, rows = sparse_svd(t, dims)
    square = t.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    return rows.select(F.col("id").alias("hadm_id"), F.array(*[F.col(c) for c in rows.columns if c != "id"]).cast("array<double>").alias("svd"),
                       F.array(*[F.lit(float(v)) for v in s]).cast("array<double>").alias("singular_values"), F.lit(float((s * s).sum() / square) if square else 0.0).alias("share"))
