"""Registered queries on keys, lists, lookups and search tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.columns import replace_text, squeeze_blanks
from wardlens.operators import codes, evaluate
from wardlens.operators.ordered import ntile_folds
from wardlens.plans import bindings as B
from wardlens.plans.catalog import _CH_TITLES, _STAY_CH_CTE, _paths, _stay_chapters, register

PRIMARY = f"(SELECT hadm_id, min(icd9_code) AS icd9_code FROM ({B.SQL_DIAG}) d WHERE seq_num = 1 GROUP BY hadm_id)"
BLOCK = 200


@register("priority_code_blocks", f"""
WITH r AS (SELECT s.priority, p.icd9_code, row_number() OVER (PARTITION BY s.priority ORDER BY s.hadm_id) AS pos
           FROM ({B.SQL_STAYS}) s JOIN {PRIMARY} p ON p.hadm_id = s.hadm_id)
SELECT priority, CAST((pos - 1) // {BLOCK} AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS n, string_agg(icd9_code, ',' ORDER BY pos) AS codes
FROM r GROUP BY 1, 2""")
def priority_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority cluster the primary codes of its stays in stay order, repeats kept, in blocks of bounded size."""
    st = B.stays(spark, sf_dir).select("hadm_id", "priority").join(codes.primary_diagnosis(B.diagnoses(spark, sf_dir)), "hadm_id")
    b = codes.ordered_blocks(st, "priority", "hadm_id", "icd9_code", BLOCK)
    return b.select("priority", "block", F.size("values").cast("long").alias("n"), F.array_join("values", ",").alias("codes"))


@register("type_names", """
SELECT replace(p_type, ' ', '_') AS type_name, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) = p_name AS plain, CAST(count(*) AS BIGINT) AS n
FROM part GROUP BY 1, 2""")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text replaced in a column; names that have no superfluous blanks."""
    p = B.table(spark, sf_dir, "part")
    return p.groupBy(replace_text("p_type", " ", "_").alias("type_name"), (squeeze_blanks("p_name") == F.col("p_name")).alias("plain")).agg(F.count(F.lit(1)).alias("n"))


@register("two_key_join", f"""
WITH big AS (SELECT subject_id, hadm_id, total_price FROM ({B.SQL_STAYS}) s WHERE total_price > 100000)
SELECT s.priority, CAST(count(*) AS BIGINT) AS n_stays, CAST(count(big.hadm_id) AS BIGINT) AS n_matched, CAST(sum(CASE WHEN big.hadm_id IS NULL THEN label ELSE 0 END) AS BIGINT) AS n_pos_unmatched
FROM ({B.SQL_STAYS}) s LEFT JOIN big ON big.subject_id = s.subject_id AND big.hadm_id = s.hadm_id GROUP BY s.priority""")
def two_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join on subject and stay together (one exchange on both keys, skew handled by the optimiser)."""
    st = B.stays(spark, sf_dir)
    big = st.where("total_price > 100000").select("subject_id", "hadm_id", F.lit(1).alias("hit"))
    return st.join(big, ["subject_id", "hadm_id"], "left").groupBy("priority").agg(
        F.count(F.lit(1)).alias("n_stays"), F.count("hit").alias("n_matched"),
        F.sum(F.when(F.col("hit").isNull(), F.col("label")).otherwise(0)).cast("long").alias("n_pos_unmatched"))


@register("stays_with_external_codes", f"""
SELECT s.hadm_id, s.label FROM ({B.SQL_STAYS}) s WHERE EXISTS (SELECT 1 FROM ({B.SQL_DIAG}) d WHERE d.hadm_id = s.hadm_id AND d.icd9_code LIKE 'E%')""")
def stays_with_external_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays with at least one external-cause code (semi-join: a stay comes once however many codes match)."""
    ext = B.diagnoses(spark, sf_dir).where(F.col("icd9_code").startswith("E")).select("hadm_id")
    return B.stays(spark, sf_dir).join(ext, "hadm_id", "left_semi").select("hadm_id", "label")


# The prefixes of the comorbidity lookup used here and the category of each.
PREFIXES = [("4", "heart"), ("41", "ischaemic"), ("410", "infarct"), ("25", "diabetes"), ("250", "diabetes"), ("58", "renal"), ("E", "external")]
FLAGS = ["heart", "ischaemic", "infarct", "diabetes", "renal", "external"]


@register("comorbidity_flags", f"""
WITH p(prefix, category) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PREFIXES)}),
d AS ({B.SQL_DIAG}), c AS (SELECT DISTINCT icd9_code FROM d),
m AS (SELECT c.icd9_code, arg_max(p.category, length(p.prefix)) AS category FROM c JOIN p ON starts_with(c.icd9_code, p.prefix) GROUP BY 1)
SELECT d.hadm_id, {", ".join(f"CAST(max(CASE WHEN m.category = '{n}' THEN 1 ELSE 0 END) AS INTEGER) AS {n}" for n in FLAGS)}
FROM d LEFT JOIN m ON m.icd9_code = d.icd9_code GROUP BY d.hadm_id""")
def comorbidity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0 / 1 column for each comorbidity of a stay, by the longest prefix of its codes."""
    return codes.prefix_flags(B.diagnoses(spark, sf_dir), spark.createDataFrame(PREFIXES, "prefix string, category string"), FLAGS)


@register("priority_distinct_codes", f"""
WITH d AS (SELECT s.priority, x.icd9_code FROM ({B.SQL_STAYS}) s JOIN ({B.SQL_DIAG}) x ON x.hadm_id = s.hadm_id)
SELECT CASE WHEN GROUPING(priority) = 1 THEN 'All Data' ELSE priority END AS priority, CAST(count(DISTINCT icd9_code) AS BIGINT) AS n_codes, true AS sketch_within_3_pct
FROM d GROUP BY ROLLUP (priority)""")
def priority_distinct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of the code matrix per cluster and over all: exact, and whether the merged sketches (one small sketch a
    cluster, united for the total) come within 3 per cent."""
    d = B.stays(spark, sf_dir).select("hadm_id", "priority").join(B.diagnoses(spark, sf_dir).select("hadm_id", "icd9_code"), "hadm_id")
    pairs = d.select("priority", "icd9_code").distinct()
    exact = pairs.groupBy("priority").agg(F.count("icd9_code").alias("n_codes")) \
        .unionByName(pairs.select("icd9_code").distinct().agg(F.lit("All Data").alias("priority"), F.count("icd9_code").alias("n_codes")))
    sketches = d.groupBy("priority").agg(F.hll_sketch_agg("icd9_code", F.lit(14)).alias("sketch"))
    about = sketches.select("priority", F.hll_sketch_estimate("sketch").alias("about")) \
        .unionByName(sketches.agg(F.lit("All Data").alias("priority"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about")))
    return exact.join(about, "priority").select("priority", "n_codes", (F.abs(F.col("about") - F.col("n_codes")) <= 0.03 * F.col("n_codes")).alias("sketch_within_3_pct"))


CUTS = (500.0, 1000.0, 2000.0, 4000.0)
_FOLDED = f"(SELECT doc_id, label, score, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS fold FROM ({B.SQL_DOC_SCORES}) s)"


def _share(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({a} + {b}, 0), 0.0)"


_P, _R, _S = _share("tp", "fp"), _share("tp", "fn"), _share("tn", "fp")
_METRICS = {"accuracy": "(tp + tn) / (tp + tn + fp + fn)", "precision": _P, "recall": _R, "f1": f"coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0.0)",
            "balanced_accuracy": f"({_R} + {_S}) / 2"}


@register("cut_search_scores", f"""
WITH p AS (SELECT c.cut, f.fold, f.label, CASE WHEN f.score < c.cut THEN 0 ELSE 1 END AS pred FROM {_FOLDED} f, (VALUES {", ".join(f"({c})" for c in CUTS)}) c(cut)),
n AS (SELECT cut, fold, CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
      CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM p GROUP BY cut, fold),
v AS ({" UNION ALL ".join(f"SELECT cut, '{m}' AS metric, {e} AS value FROM n" for m, e in _METRICS.items())}),
t AS (SELECT CAST(cut AS DOUBLE) AS cut, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std FROM v GROUP BY cut, metric),
b AS (SELECT cut FROM t WHERE metric = 'f1' ORDER BY mean DESC, cut LIMIT 1)
SELECT cut, metric, mean, std, CAST(rank() OVER (PARTITION BY metric ORDER BY mean DESC) AS INTEGER) AS rank, cut IN (SELECT cut FROM b) AS best FROM t""")
def cut_search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several scores of every point of a search from one aggregate over its pooled fold predictions; the point to refit
    on is the best by one of them."""
    folded = ntile_folds(B.doc_scores(spark, sf_dir), "doc_id", 5, ["label"])
    pred = folded.select("fold", "label", "score", F.explode(F.array(*[F.lit(c) for c in CUTS])).alias("cut")) \
        .withColumn("pred", F.when(F.col("score") < F.col("cut"), 0).otherwise(1))
    return evaluate.search_table(pred, ["cut"], refit="f1")


PRICE_CUT = 150000.0


@register("chapter_performance", f"""
WITH {_STAY_CH_CTE}, ti(name, descr) AS (VALUES {_CH_TITLES}),
p AS (SELECT j.cluster, j.label, CASE WHEN s.total_price < {PRICE_CUT} THEN 0 ELSE 1 END AS pred FROM j JOIN ({B.SQL_STAYS}) s ON s.hadm_id = j.hadm_id WHERE j.cluster IS NOT NULL),
c AS (SELECT cluster, sum(label * pred) AS tp, sum((1 - label) * pred) AS fp, sum(label * (1 - pred)) AS fn, count(*) AS n FROM p GROUP BY cluster)
SELECT c.cluster, ti.descr, CAST(n AS BIGINT) AS n_stays, round({_share("tp", "fp")}, 9) AS precision, round({_share("tp", "fn")}, 9) AS recall
FROM c LEFT JOIN ti ON ti.name = c.cluster""")
def chapter_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, precision and recall of a fixed rule per described cluster (the table behind the performance chart)."""
    st = _stay_chapters(spark, sf_dir).where(F.col("cluster").isNotNull()).select("hadm_id", "cluster", "label") \
        .join(B.stays(spark, sf_dir).select("hadm_id", "total_price"), "hadm_id") \
        .withColumn("pred", F.when(F.col("total_price") < PRICE_CUT, 0).otherwise(1))
    rep = evaluate.class_report(st, group_cols=["cluster"]).where("class = 1").select("cluster", "precision", "recall")
    size = st.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_stays"))
    desc = codes.node_descriptions(_paths(spark), 1).withColumnRenamed("code", "cluster")
    return size.join(rep, "cluster").join(codes.bounded_broadcast(desc), "cluster", "left").select("cluster", "descr", "n_stays", "precision", "recall")
