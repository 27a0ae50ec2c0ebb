"""Registered queries on k-means for all k: the elbow, and one weighted step with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators import kmeans as km
from wardlens.plans import bindings as B
from wardlens.plans.catalog import register

STEP_KS = (1, 2, 3, 4)
# the first centres: the vectors with the lowest ids, k of them; the weight of a row depends on its label
_WEIGHT = "1 + label % 3"
_STEP_SQL = f"""
WITH e AS (SELECT vec_id, CAST({_WEIGHT} AS DOUBLE) AS w, embedding FROM embeddings),
x AS (SELECT vec_id, w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM e),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS centre FROM embeddings ORDER BY vec_id LIMIT {max(STEP_KS)}),
c AS (SELECT s.centre, x.dim, x.v FROM s JOIN x USING (vec_id)),
d AS (SELECT x.vec_id, c.centre, sum((x.v - c.v) * (x.v - c.v)) AS d2 FROM x JOIN c USING (dim) GROUP BY x.vec_id, c.centre),
ks AS (SELECT unnest([{", ".join(map(str, STEP_KS))}]) AS k),
a AS (SELECT k, vec_id, arg_min(centre, (d2, centre)) AS centre, min(d2) AS d2 FROM ks JOIN d ON d.centre < ks.k GROUP BY k, vec_id),
m AS (SELECT a.k, a.centre, x.dim, sum(x.v * x.w) / sum(x.w) AS mean FROM a JOIN x USING (vec_id) GROUP BY 1, 2, 3),
q AS (SELECT k, centre, sum(mean * mean) AS q FROM m GROUP BY 1, 2)
SELECT CAST(a.k AS INTEGER) AS k, CAST(a.centre AS INTEGER) AS centre, CAST(count(*) AS BIGINT) AS n, sum(e.w) AS weight,
       round(sum(e.w * a.d2), 5) AS inertia, round(any_value(q.q), 6) AS moved_norm2
FROM a JOIN e USING (vec_id) JOIN q ON q.k = a.k AND q.centre = a.centre GROUP BY a.k, a.centre"""


@register("kmeans_weighted_step", _STEP_SQL)
def kmeans_weighted_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of weighted k-means for k = 1 to 4 at once, from the vectors with the lowest ids: rows, weight and inertia
    of every (k, centre) and the squared norm of where its centre moves."""
    emb = B.table(spark, sf_dir, "embeddings")
    rows = km.usable(emb, "embedding", "vec_id", F.expr(_WEIGHT))
    first = np.array([r["v"] for r in rows.orderBy("key").limit(max(STEP_KS)).collect()])
    cells = km.step_sums(rows, {(k, 0): first[:k] for k in STEP_KS}, first.shape[1])
    by = cells.groupBy("k", "centre").agg(F.sum("n").cast("long").alias("n"), F.sum("weight").alias("weight"), F.sum("cost").alias("inertia"),
                                          F.sum(F.col("total") * F.col("total")).alias("q")).where("n > 0")
    return by.select("k", "centre", "n", "weight", F.round("inertia", 5).alias("inertia"), F.round(F.col("q") / (F.col("weight") * F.col("weight")), 6).alias("moved_norm2"))


@register("kmeans_all_k")
def kmeans_all_k(spark: SparkSession, sf_dir: str, max_k: int = 10) -> DataFrame:
    """Weighted k-means for k = 1 to 10, ten starts each, all at once: per (k, centre) its weight, share and centre, with the k's inertia and
    number of iterations."""
    got = km.kmeans_all(B.table(spark, sf_dir, "embeddings"), "embedding", "vec_id", range(1, max_k + 1), F.expr(_WEIGHT))
    rows = [(k, i, float(got.weights[k][i]), float(got.weights[k][i] / got.weights[k].sum()), c.tolist(), float(got.inertia[k]), got.iterations[k])
            for k, cs in got.centres.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "k int, centre int, weight double, share double, position array<double>, inertia double, iterations int")
