"""Registered queries over the driver's test tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (SQL text over
the pre-registered views).  Column names and types agree; floats are rounded in
both to the same digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.operators import codes, cohort, evaluate
from wardlens.operators.folds import hash_sql
from wardlens.operators.ordered import ntile_folds
from wardlens.plans import bindings as B
from wardlens.plans.hierarchy_data import BLOCKS, CHAPTERS, hierarchy_json

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ helpers
def _paths(spark: SparkSession) -> DataFrame:
    return codes.hierarchy_paths(spark, hierarchy_json())


def _interval_rows(names, truncated=False):
    rows = []
    for i, n in enumerate(names):
        s, dash, e = n.partition("-")
        if not dash:
            continue
        if truncated:
            s = s[:-1]
        if s and e:
            rows.append((i, int(s), int(e), n))
    return rows


def _iv_cte(names, truncated=False) -> str:
    vals = ", ".join(f"({o}, {lo}, {hi}, '{n}')" for o, lo, hi, n in _interval_rows(names, truncated))
    return f"iv(ord, lo, hi, name) AS (VALUES {vals})"


LOOKUP_CTE = ("lk AS (SELECT CAST(r.range AS INTEGER) AS code3, arg_min(iv.name, iv.ord) AS cluster "
              "FROM range(1000) r JOIN iv ON r.range BETWEEN iv.lo AND iv.hi GROUP BY 1)")


def _code3_sql(c: str) -> str:
    return f"CASE WHEN {c} LIKE 'E%' OR {c} LIKE 'V%' THEN NULL ELSE TRY_CAST(substr({c}, 1, 3) AS INTEGER) END"


def _profile_sql(names, truncated=False) -> str:
    return f"""
WITH {_iv_cte(names, truncated)}, {LOOKUP_CTE},
prim AS (SELECT hadm_id, min(icd9_code) AS icd9_code FROM ({B.SQL_DIAG}) d WHERE seq_num = 1 GROUP BY hadm_id),
st AS ({B.SQL_STAYS}),
j AS (SELECT st.label, lk.cluster FROM prim JOIN st ON st.hadm_id = prim.hadm_id
      LEFT JOIN lk ON lk.code3 = {_code3_sql('prim.icd9_code')})
SELECT cluster, CAST(count(*) AS BIGINT) AS n_stays, CAST(sum(label) AS BIGINT) AS n_pos,
       round(sum(label) / count(*), 6) AS pos_rate,
       round(count(*) / sum(count(*)) OVER (), 6) AS share_stays,
       round(sum(label) / NULLIF(sum(sum(label)) OVER (), 0), 6) AS share_pos
FROM j GROUP BY cluster"""


def _profile(spark, sf_dir, depth, truncated=False):
    intervals = codes.hierarchy_intervals(_paths(spark), depth, truncated)
    st = codes.stay_clusters(spark, B.stays(spark, sf_dir), B.diagnoses(spark, sf_dir), intervals)
    return codes.cluster_profile(st)


CHAPTER_NAMES = [n for n, _ in CHAPTERS]


# ------------------------------------------------------------------ hierarchy clusters
@register("hierarchy_profile", _profile_sql(CHAPTER_NAMES))
def hierarchy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: stay -> chapter of its primary code; per chapter stays, positives,
    rate and shares (null chapter kept for E/V codes)."""
    return _profile(spark, sf_dir, 1)


@register("hierarchy_profile_truncated", _profile_sql(CHAPTER_NAMES, truncated=True))
def hierarchy_profile_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same with interval starts cut by one character (parity mode)."""
    return _profile(spark, sf_dir, 1, truncated=True)


@register("block_profile", _profile_sql(BLOCKS))
def block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same at depth 2 (blocks); single-code blocks give no interval; gap codes null."""
    return _profile(spark, sf_dir, 2)


# ------------------------------------------------------------------ category sets
DICT_CTE = f"dict AS (SELECT icd9_code, arg_max(category, line_no) AS category FROM ({B.SQL_DICT}) x GROUP BY icd9_code)"
SETS_CTE = (f"sets AS (SELECT s.hadm_id, coalesce(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), []) AS cats "
            f"FROM ({B.SQL_STAYS}) s LEFT JOIN ({B.SQL_DIAG}) d ON d.hadm_id = s.hadm_id LEFT JOIN dict ON dict.icd9_code = d.icd9_code "
            f"GROUP BY s.hadm_id)")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category set of every stay; empty where no code is known."""
    known = codes.category_sets(B.diagnoses(spark, sf_dir), B.code_dictionary(spark, sf_dir))
    return codes.attach_codes(B.stays(spark, sf_dir).select("hadm_id"), known, col="categories")


def _stored_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_sets`` written once, for fits that read them many times."""
    from wardlens.session import spread
    return spread(_sets(spark, sf_dir), "sets")


@register("stay_categories", f"""
WITH {DICT_CTE}, {SETS_CTE}
SELECT hadm_id, array_to_string(cats, ',') AS categories, CAST(len(cats) AS BIGINT) AS n_categories FROM sets""")
def stay_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sets(spark, sf_dir)
    return s.select("hadm_id", F.array_join("categories", ",").alias("categories"),
                    F.size("categories").cast("long").alias("n_categories"))


def _priority_counts(spark, sf_dir):
    s = _sets(spark, sf_dir)
    st = B.stays(spark, sf_dir).select("hadm_id", "priority")
    return cohort.category_counts(st.join(s, "hadm_id"), "priority", "categories")


COUNTS_CTE = (f"{DICT_CTE}, {SETS_CTE}, st AS ({B.SQL_STAYS}), "
              "c AS (SELECT st.priority, u.category, count(*) AS n FROM st JOIN sets ON sets.hadm_id = st.hadm_id, "
              "unnest(sets.cats) u(category) GROUP BY 1, 2)")


@register("category_top10", f"""
WITH {COUNTS_CTE}
SELECT priority, category, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY priority ORDER BY n DESC, category) AS rank FROM c) t WHERE rank <= 10""")
def category_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most frequent categories per priority cluster."""
    return cohort.top_k_per_group(_priority_counts(spark, sf_dir), "priority", "category", 10)


_PAIR_CTE = ("g AS (SELECT DISTINCT priority FROM c), pairs AS (SELECT a.priority AS pa, b.priority AS pb "
             "FROM g a JOIN g b ON a.priority < b.priority), "
             "ca AS (SELECT p.pa, p.pb, c.category, c.n FROM pairs p JOIN c ON c.priority = p.pa), "
             "cb AS (SELECT p.pa, p.pb, c.category, c.n FROM pairs p JOIN c ON c.priority = p.pb), "
             "f AS (SELECT coalesce(ca.pa, cb.pa) AS pa, coalesce(ca.pb, cb.pb) AS pb, ca.n AS na, cb.n AS nb "
             "FROM ca FULL OUTER JOIN cb ON ca.pa = cb.pa AND ca.pb = cb.pb AND ca.category = cb.category)")


@register("cluster_dissimilarity", f"""
WITH {COUNTS_CTE}, {_PAIR_CTE}
SELECT CAST(sum(abs(coalesce(na, 0) - coalesce(nb, 0))) AS BIGINT) AS score,
       CAST(sum(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS overlap,
       round(sum(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN 1 ELSE 0 END) / (SELECT count(*) FROM pairs), 6) AS mean_overlap
FROM f""")
def cluster_dissimilarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of |count differences| over cluster pairs and categories, and overlaps."""
    return cohort.dissimilarity(_priority_counts(spark, sf_dir), "priority", "category")


@register("pair_dissimilarity", f"""
WITH {COUNTS_CTE}, {_PAIR_CTE}
SELECT pa AS ga, pb AS gb, CAST(sum(abs(coalesce(na, 0) - coalesce(nb, 0))) AS BIGINT) AS score,
       CAST(sum(CASE WHEN na IS NOT NULL AND nb IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS overlap
FROM f GROUP BY 1, 2""")
def pair_dissimilarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.pair_dissimilarity(_priority_counts(spark, sf_dir), "priority", "category")


# ------------------------------------------------------------------ features and profiles
TRIPLE_COLS = ["quantity", "price", "discount"]
FEATURES = ["total_price", "acct_balance"] + [f"{c}_{s}" for c in TRIPLE_COLS for s in ("min", "mean", "max")]


def _stay_features(spark, sf_dir):
    from wardlens.operators.features import measurement_triples
    tri = measurement_triples(B.measurements(spark, sf_dir), "hadm_id", TRIPLE_COLS)
    measured = [f"{c}_{s}" for c in TRIPLE_COLS for s in ("min", "mean", "max")]
    # every stay, also those without a known customer; 0 where nothing was measured
    return B.stays(spark, sf_dir, with_customer=True).join(tri, "hadm_id", "left").na.fill(0, ["acct_balance", *measured])


TRIPLES_SQL = ("SELECT l_orderkey AS hadm_id, " + ", ".join(
    f"min({s}) AS {c}_min, avg({s}) AS {c}_mean, max({s}) AS {c}_max"
    for c, s in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount")))
    + " FROM lineitem GROUP BY l_orderkey")
FILLED_SQL = ", ".join(f"coalesce(tri.{c}_{s}, 0) AS {c}_{s}" for c in TRIPLE_COLS for s in ("min", "mean", "max"))
FEAT_CTE = f"tri AS ({TRIPLES_SQL}), sf AS (SELECT s.* REPLACE (coalesce(s.acct_balance, 0) AS acct_balance), {FILLED_SQL} FROM ({B.SQL_STAYS_C}) s LEFT JOIN tri USING (hadm_id))"


@register("stay_triples", f"SELECT hadm_id, " + ", ".join(
    f"round({c}_{s}, 6) AS {c}_{s}" for c in TRIPLE_COLS for s in ("min", "mean", "max")) + f" FROM ({TRIPLES_SQL}) t")
def stay_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardlens.operators.features import measurement_triples
    t = measurement_triples(B.measurements(spark, sf_dir), "hadm_id", TRIPLE_COLS)
    return t.select("hadm_id", *[F.round(f"{c}_{s}", 6).alias(f"{c}_{s}") for c in TRIPLE_COLS
                                 for s in ("min", "mean", "max")])


@register("segment_means", f"""
WITH {FEAT_CTE},
r AS (SELECT CASE WHEN GROUPING(segment) = 1 THEN 'All Data' ELSE segment END AS segment,
      {", ".join(f"avg({c}) AS {c}" for c in FEATURES)} FROM sf GROUP BY ROLLUP (segment))
""" + " UNION ALL ".join(f"SELECT segment, '{c}' AS feature, round(CAST({c} AS DOUBLE), 6) AS mean FROM r"
                         for c in FEATURES))
def segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every feature per segment beside the all-data mean (rollup), long form."""
    return cohort.rollup_means_long(_stay_features(spark, sf_dir), "segment", FEATURES)


@register("label_correlations", f"WITH {FEAT_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(covar_pop({c}, label) / NULLIF(stddev_pop({c}) * stddev_pop(label), 0), 6) AS corr "
    f"FROM sf" for c in FEATURES))
def label_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.label_correlations(_stay_features(spark, sf_dir), FEATURES)


@register("priority_class_weights", f"""
SELECT priority, CAST(sum(1 - label) AS BIGINT) AS n_neg, CAST(sum(label) AS BIGINT) AS n_pos,
       round(sum(1 - label) / NULLIF(sum(label), 0), 9) AS class_weight FROM ({B.SQL_STAYS}) s GROUP BY priority""")
def priority_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = cohort.class_weights(B.stays(spark, sf_dir), "label", ["priority"])
    return w.withColumn("class_weight", F.round("class_weight", 9))


# ------------------------------------------------------------------ folds
@register("stratified_folds", f"""
SELECT doc_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS INTEGER) AS fold
FROM ({B.SQL_DOC_SCORES}) s""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 stratified folds, no shuffle: each class cut in id order into blocks."""
    return ntile_folds(B.doc_scores(spark, sf_dir).select("doc_id", "label"), "doc_id", 5, ["label"])


@register("fold_class_weights", f"""
WITH f AS (SELECT label, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS fold FROM ({B.SQL_DOC_SCORES}) s),
k AS (SELECT DISTINCT fold FROM f)
SELECT CAST(k.fold AS INTEGER) AS fold, CAST(sum(CASE WHEN f.label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       CAST(sum(CASE WHEN f.label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       round(sum(CASE WHEN f.label = 0 THEN 1 ELSE 0 END) / NULLIF(sum(CASE WHEN f.label = 1 THEN 1 ELSE 0 END), 0), 9) AS class_weight
FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold""")
def fold_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """negatives / positives of the training part (all other folds) of each fold."""
    folds = ntile_folds(B.doc_scores(spark, sf_dir).select("doc_id", "label"), "doc_id", 5, ["label"])
    per = folds.groupBy("fold").agg(F.sum(1 - F.col("label")).alias("neg"), F.sum("label").alias("pos"))
    # totals by a window over the k per-fold rows (bounded by k)
    w = Window.partitionBy()
    j = per.withColumn("tneg", F.sum("neg").over(w)).withColumn("tpos", F.sum("pos").over(w))
    return j.select("fold", (F.col("tneg") - F.col("neg")).cast("long").alias("n_neg"),
                    (F.col("tpos") - F.col("pos")).cast("long").alias("n_pos"),
                    F.round(F.try_divide((F.col("tneg") - F.col("neg")).cast("double"),
                                         (F.col("tpos") - F.col("pos")).cast("double")), 9).alias("class_weight"))


# ------------------------------------------------------------------ evaluation
_AUC_SQL = """
WITH s AS ({src}),
r AS (SELECT {g}, label, rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0 AS rk FROM s)
SELECT {g}, round((sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
             / NULLIF(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0), 9) AS auc FROM r GROUP BY {g}"""


@register("doc_auc", _AUC_SQL.format(src=B.SQL_DOC_SCORES, g="lang"))
def doc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC area of n_chars as a score for quality, per language (mean-rank ties)."""
    return evaluate.roc_auc(B.doc_scores(spark, sf_dir), group_cols=["lang"])


@register("line_auc", _AUC_SQL.format(src=B.SQL_LINE_SCORES, g="grp"))
def line_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC area with heavy ties (11 distinct discounts over all lines)."""
    return evaluate.roc_auc(B.line_scores(spark, sf_dir), group_cols=["grp"])


_CURVE_CTE = """sc AS (SELECT {g}, score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM ({src}) s GROUP BY {g}, score),
cu AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER (PARTITION BY {g}) AS P,
       sum(n_neg) OVER (PARTITION BY {g}) AS N FROM sc
       WINDOW w AS (PARTITION BY {g} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("line_roc", ("WITH " + _CURVE_CTE + """
SELECT {g}, score AS threshold, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp,
       round(fp / NULLIF(N, 0), 9) AS fpr, round(tp / NULLIF(P, 0), 9) AS tpr FROM cu
UNION ALL SELECT DISTINCT {g}, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0, 0.0 FROM sc""")
          .format(g="grp", src=B.SQL_LINE_SCORES))
def line_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC points per distinct discount, per line status, plus the origin."""
    return evaluate.roc_curve(B.line_scores(spark, sf_dir), group_cols=["grp"])


@register("doc_pr", ("WITH " + _CURVE_CTE + """
SELECT {g}, score AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / NULLIF(P, 0), 9) AS recall FROM cu
UNION ALL SELECT DISTINCT {g}, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM sc""").format(g="lang", src=B.SQL_DOC_SCORES))
def doc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pr_curve(B.doc_scores(spark, sf_dir), group_cols=["lang"])


@register("doc_average_precision", ("WITH " + _CURVE_CTE + """
SELECT {g}, round(sum(n_pos / NULLIF(P, 0) * (tp / (tp + fp))), 9) AS average_precision FROM cu GROUP BY {g}""")
          .format(g="lang", src=B.SQL_DOC_SCORES))
def doc_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(B.doc_scores(spark, sf_dir), group_cols=["lang"])


@register("line_roc_trapezoid", ("WITH " + _CURVE_CTE + """
SELECT {g}, round(sum((fp / NULLIF(N, 0) - (fp - n_neg) / NULLIF(N, 0)) * (tp / NULLIF(P, 0) + (tp - n_pos) / NULLIF(P, 0)) / 2), 9) AS auc FROM cu GROUP BY {g}""")
          .format(g="grp", src=B.SQL_LINE_SCORES))
def line_roc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc_trapezoid(B.line_scores(spark, sf_dir), group_cols=["grp"])


DOC_CUT = 2000.0
_PRED_CTE = f"p AS (SELECT lang, label, CASE WHEN score < {DOC_CUT} THEN 0 ELSE 1 END AS pred FROM ({B.SQL_DOC_SCORES}) s)"
_CNT_CTE = ("c AS (SELECT lang, sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn, "
            "sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp, "
            "sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, "
            "sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp FROM p GROUP BY lang)")


def _doc_pred(spark, sf_dir):
    from wardlens.functions.columns import threshold
    return B.doc_scores(spark, sf_dir).withColumn("pred", threshold("score", DOC_CUT))


def _rep_sql(a, b, d, cls):
    p = f"coalesce({a} / NULLIF({a} + {b}, 0), 0.0)"
    r = f"coalesce({a} / NULLIF({a} + {d}, 0), 0.0)"
    f1 = f"coalesce(2 * {p} * {r} / NULLIF({p} + {r}, 0), 0.0)"
    return (f"SELECT lang, {cls} AS class, round({p}, 9) AS precision, round({r}, 9) AS recall, "
            f"round({f1}, 9) AS f1, CAST({a} + {d} AS BIGINT) AS support FROM c")


REPORT_SQL = f"WITH {_PRED_CTE}, {_CNT_CTE} {_rep_sql('tp', 'fp', 'fn', 1)} UNION ALL {_rep_sql('tn', 'fn', 'fp', 0)}"


@register("doc_confusion", f"""WITH {_PRED_CTE}
SELECT g.lang, CAST(cell.l AS INTEGER) AS label, CAST(cell.q AS INTEGER) AS pred, CAST(count(p.label) AS BIGINT) AS n
FROM (SELECT DISTINCT lang FROM p) g CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) cell(l, q)
LEFT JOIN p ON p.lang = g.lang AND p.label = cell.l AND p.pred = cell.q GROUP BY 1, 2, 3""")
def doc_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix per language at a fixed cut, all four cells."""
    return evaluate.confusion_matrix(_doc_pred(spark, sf_dir), group_cols=["lang"])


@register("doc_class_report", REPORT_SQL)
def doc_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and class: precision, recall, f1 (0 when undefined), support."""
    return evaluate.class_report(_doc_pred(spark, sf_dir), group_cols=["lang"])


@register("report_summary", f"""
WITH rep AS ({REPORT_SQL}),
l AS (SELECT class, 'precision' AS metric, precision AS value, CAST(support AS DOUBLE) AS w FROM rep UNION ALL
      SELECT class, 'recall', recall, support FROM rep UNION ALL SELECT class, 'f1', f1, support FROM rep UNION ALL
      SELECT class, 'support', CAST(support AS DOUBLE), support FROM rep),
o AS (SELECT *, row_number() OVER (PARTITION BY class, metric ORDER BY value) AS rn,
      count(*) OVER (PARTITION BY class, metric) AS n FROM l)
SELECT class, metric, round(avg(value), 6) AS mean, round(sum(value * w) / NULLIF(sum(w), 0), 6) AS weighted_mean,
       max(CASE WHEN rn = n // 2 + 1 THEN value END) AS median
FROM o GROUP BY class, metric""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and upper median of each metric over the language clusters, per class."""
    rep = evaluate.class_report(_doc_pred(spark, sf_dir), group_cols=["lang"])
    return cohort.metric_summary(rep, ["class"], ["precision", "recall", "f1", "support"])


# ------------------------------------------------------------------ hierarchy ids, parents, Gini
def _stay_chapters(spark, sf_dir):
    intervals = codes.hierarchy_intervals(_paths(spark), 1)
    st = B.stays(spark, sf_dir).select("hadm_id", "priority", "label")
    return codes.stay_clusters(spark, st, B.diagnoses(spark, sf_dir), intervals)


_CH_IDS = ", ".join(f"('{n}', {i})" for i, n in enumerate(CHAPTER_NAMES))
_STAY_CH_CTE = f"""{_iv_cte(CHAPTER_NAMES)}, {LOOKUP_CTE},
prim AS (SELECT hadm_id, min(icd9_code) AS icd9_code FROM ({B.SQL_DIAG}) d WHERE seq_num = 1 GROUP BY hadm_id),
st AS ({B.SQL_STAYS}),
j AS (SELECT st.hadm_id, st.priority, st.label, lk.cluster FROM prim JOIN st ON st.hadm_id = prim.hadm_id
      LEFT JOIN lk ON lk.code3 = {_code3_sql('prim.icd9_code')})"""


@register("hierarchy_id_gini", f"""
WITH {_STAY_CH_CTE}, ch(name, id) AS (VALUES {_CH_IDS}),
ids AS (SELECT j.priority, coalesce(ch.id, {len(CHAPTER_NAMES)} + row_number() OVER (PARTITION BY j.priority, ch.id IS NULL ORDER BY j.hadm_id) - 1) AS id
        FROM j LEFT JOIN ch ON ch.name = j.cluster),
g AS (SELECT priority, id + 1e-7 AS x, row_number() OVER (PARTITION BY priority ORDER BY id) AS i,
      count(*) OVER (PARTITION BY priority) AS n FROM ids)
SELECT priority, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini FROM g GROUP BY priority""")
def hierarchy_id_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gini of hierarchy-chapter ids (first-seen order; unmapped stays take the
    next free ids in stay order) within each priority cluster."""
    id_map = codes.first_seen_ids(
        _paths(spark).select("path_idx", F.col("path")[1]["code"].alias("cluster")), "cluster", "path_idx",
        n_buckets=1)   # the hierarchy is a fixed reference tree
    from pyspark import StorageLevel
    st = _stay_chapters(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)   # read by three passes below
    ids = codes.ids_with_fallback(st, "cluster", id_map, "hadm_id", partition_cols=["priority"])
    return cohort.gini_by_group(ids, "id", "priority")


_BLOCK_ALL = ", ".join(f"({int(b.partition('-')[0])}, {int(b.partition('-')[2] or b)}, '{b}')" for b in BLOCKS)


@register("block_parent_counts", f"""
WITH bl(lo, hi, name) AS (VALUES {_BLOCK_ALL}),
prim AS (SELECT hadm_id, min(icd9_code) AS icd9_code FROM ({B.SQL_DIAG}) d WHERE seq_num = 1 GROUP BY hadm_id),
j AS (SELECT bl.name AS parent FROM prim LEFT JOIN bl ON {_code3_sql('prim.icd9_code')} BETWEEN bl.lo AND bl.hi)
SELECT parent, CAST(count(*) AS BIGINT) AS n_stays FROM j GROUP BY parent""")
def block_parent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node -> depth-2 ancestor lookup (equi-join on the 3-digit leaf code), stays per block."""
    parents = codes.node_parents(_paths(spark), 2).where(F.col("code").isNotNull())
    prim = codes.primary_diagnosis(B.diagnoses(spark, sf_dir)).withColumn("code", F.substring("icd9_code", 1, 3))
    j = prim.join(codes.bounded_broadcast(parents), "code", "left")
    return j.groupBy("parent").agg(F.count(F.lit(1)).alias("n_stays"))


# ------------------------------------------------------------------ text
@register("doc_terms", r"""
SELECT lang, term, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) t
WHERE length(term) > 0 GROUP BY lang, term""")
def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequency per language over the whole texts (the table behind a word cloud)."""
    return cohort.term_counts(B.table(spark, sf_dir, "documents").select("lang", "text"), "lang", "text")


# ------------------------------------------------------------------ features
Z_COLS = ["total_price", "quantity_mean", "price_mean", "discount_mean"]


@register("stay_zscores", f"WITH {FEAT_CTE} SELECT hadm_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / NULLIF(stddev_pop({c}) OVER (), 0), 6) AS z_{c}" for c in Z_COLS) + " FROM sf")
def stay_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-scores with the population std, fitted with one aggregate."""
    from wardlens.operators.features import zscore
    f = _stay_features(spark, sf_dir).select("hadm_id", *Z_COLS)
    z = zscore(f, Z_COLS, prefix="z_")
    return z.select("hadm_id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in Z_COLS])


# The five order priorities of the test data, sorted; the first is dropped.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("stay_onehot", f"SELECT hadm_id, label, " + ", ".join(
    f"CAST(priority = '{v}' AS INTEGER) AS \"priority_{v}\"" for v in PRIORITIES[1:]) + f" FROM ({B.SQL_STAYS}) s")
def stay_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dummy coding of the priority: one 0/1 column per level, first level dropped."""
    from wardlens.operators.features import one_hot
    return one_hot(B.stays(spark, sf_dir).select("hadm_id", "label", "priority"), ["priority"])


SPLIT_SQL = f"CASE WHEN {hash_sql('doc_id')} % 1000000 < 200000 THEN 'test' ELSE 'train' END"


@register("train_test_split", f"SELECT doc_id, label, {SPLIT_SQL} AS split FROM ({B.SQL_DOC_SCORES}) s")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeatable 80/20 split by an arithmetic hash of the id."""
    from wardlens.operators.folds import hash_split
    return hash_split(B.doc_scores(spark, sf_dir).select("doc_id", "label"), "doc_id", 0.2)


# ------------------------------------------------------------------ mean ROC over folds
@register("doc_mean_roc", f"""
WITH s AS (SELECT score, label, ntile(5) OVER (PARTITION BY label ORDER BY doc_id) - 1 AS fold FROM ({B.SQL_DOC_SCORES}) x),
sc AS (SELECT fold, score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM s GROUP BY fold, score),
cu AS (SELECT fold, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER (PARTITION BY fold) AS P,
       sum(n_neg) OVER (PARTITION BY fold) AS N FROM sc
       WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pts AS (SELECT fold, fp / NULLIF(N, 0) AS fpr, tp / NULLIF(P, 0) AS tpr FROM cu UNION ALL SELECT DISTINCT fold, 0.0, 0.0 FROM sc),
grid AS (SELECT CAST(range AS INTEGER) AS i, range * (CAST(1 AS DOUBLE) / 99) AS x FROM range(100)),
fl AS (SELECT DISTINCT fold FROM sc),
lf AS (SELECT g.i, g.x, f.fold, (SELECT max(fpr) FROM pts WHERE pts.fold = f.fold AND fpr <= g.x) AS l
       FROM grid g CROSS JOIN fl f),
lr AS (SELECT lf.*, (SELECT max(tpr) FROM pts WHERE pts.fold = lf.fold AND fpr = lf.l) AS lt,
       (SELECT min(fpr) FROM pts WHERE pts.fold = lf.fold AND fpr > lf.x) AS r FROM lf),
v AS (SELECT lr.*, (SELECT min(tpr) FROM pts WHERE pts.fold = lr.fold AND fpr = lr.r) AS rt FROM lr),
it AS (SELECT i, x, fold, CASE WHEN l = x OR r IS NULL THEN lt ELSE lt + (x - l) * (rt - lt) / (r - l) END AS tpr FROM v),
m AS (SELECT i, x, CASE WHEN i = 0 THEN 0.0 WHEN i = 99 THEN 1.0 ELSE avg(tpr) END AS tpr FROM it GROUP BY i, x),
a AS (SELECT sum((x - px) * (tpr + pt) / 2) AS auc FROM (SELECT x, tpr, lag(x) OVER (ORDER BY i) AS px,
      lag(tpr) OVER (ORDER BY i) AS pt FROM m) q WHERE px IS NOT NULL)
SELECT i, round(x, 9) AS x, round(tpr, 9) AS tpr, round(auc, 9) AS auc FROM m, a""")
def doc_mean_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROC of the 5 stratified folds on a 100-point grid, ends fixed, with its area."""
    folds = ntile_folds(B.doc_scores(spark, sf_dir), "doc_id", 5, ["label"])
    return evaluate.mean_roc(spark, folds, "fold")


# ------------------------------------------------------------------ more evaluation tables
@register("doc_report_averages", f"""
WITH {_PRED_CTE}, {_CNT_CTE}, rep AS ({_rep_sql('tp', 'fp', 'fn', 1)} UNION ALL {_rep_sql('tn', 'fn', 'fp', 0)})
SELECT lang, 'macro' AS average, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
       round(avg(f1), 9) AS f1, CAST(sum(support) AS BIGINT) AS support FROM rep GROUP BY lang
UNION ALL SELECT lang, 'weighted', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
       round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM rep GROUP BY lang
UNION ALL SELECT lang, 'micro', round((tp + tn) / (tp + tn + fp + fn), 9), round((tp + tn) / (tp + tn + fp + fn), 9),
       round((tp + tn) / (tp + tn + fp + fn), 9), CAST(tp + tn + fp + fn AS BIGINT) FROM c""")
def doc_report_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_averages(_doc_pred(spark, sf_dir), group_cols=["lang"])


@register("doc_baseline_report", f"""
WITH p AS (SELECT lang, label, 0 AS pred FROM ({B.SQL_DOC_SCORES}) s), {_CNT_CTE}
{_rep_sql('tp', 'fp', 'fn', 1)} UNION ALL {_rep_sql('tn', 'fn', 'fp', 0)}""")
def doc_baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the all-negative predictor (undefined precision reported as 0)."""
    p = B.doc_scores(spark, sf_dir).withColumn("pred", F.lit(0))
    return evaluate.class_report(p, group_cols=["lang"])


@register("doc_accuracy", f"WITH {_PRED_CTE} SELECT lang, round(avg(CAST(label = pred AS DOUBLE)), 9) AS accuracy FROM p GROUP BY lang")
def doc_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_doc_pred(spark, sf_dir), group_cols=["lang"]).withColumn("accuracy", F.round("accuracy", 9))


@register("doc_misclassified", f"WITH {_PRED_CTE.replace('SELECT lang,', 'SELECT doc_id, lang,')} "
          "SELECT doc_id, lang, label, pred FROM p WHERE pred <> label")
def doc_misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose prediction differs from the label."""
    return _doc_pred(spark, sf_dir).where(F.col("pred") != F.col("label")).select("doc_id", "lang", "label", "pred")


_PROB_SQL = f"(1 - exp(-score / {DOC_CUT}))"


@register("doc_sensitivity_specificity", f"""
SELECT lang, round(sum(round_even(least(greatest(label * {_PROB_SQL}, 0), 1), 0)) / (sum(label) + 1e-7), 9) AS sensitivity,
       round(sum(round_even(least(greatest((1 - label) * (1 - {_PROB_SQL}), 0), 1), 0)) / (sum(1 - label) + 1e-7), 9) AS specificity
FROM ({B.SQL_DOC_SCORES}) s GROUP BY lang""")
def doc_sensitivity_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft sensitivity / specificity of a probability derived from the score."""
    p = B.doc_scores(spark, sf_dir).withColumn("prob", 1 - F.exp(-F.col("score") / DOC_CUT))
    out = evaluate.sensitivity_specificity(p, group_cols=["lang"])
    return out.select("lang", F.round("sensitivity", 9).alias("sensitivity"), F.round("specificity", 9).alias("specificity"))


@register("doc_specificity_at_80", ("WITH " + _CURVE_CTE + """,
pts AS (SELECT {g}, fp / NULLIF(N, 0) AS fpr, tp / NULLIF(P, 0) AS tpr FROM cu UNION ALL SELECT DISTINCT {g}, 0.0, 0.0 FROM sc)
SELECT {g}, round(max(1 - fpr), 9) AS specificity FROM pts WHERE tpr >= 0.8 GROUP BY {g}""")
          .format(g="lang", src=B.SQL_DOC_SCORES))
def doc_specificity_at_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best specificity among ROC points reaching sensitivity 0.8."""
    out = evaluate.specificity_at_sensitivity(B.doc_scores(spark, sf_dir), 0.8, group_cols=["lang"])
    return out.withColumn("specificity", F.round("specificity", 9))


@register("doc_pr_trapezoid", ("WITH " + _CURVE_CTE + """
SELECT {g}, round(sum((tp / NULLIF(P, 0) - (tp - n_pos) / NULLIF(P, 0)) * (tp / (tp + fp) + CASE WHEN tp - n_pos + fp - n_neg = 0 THEN 1.0
       ELSE (tp - n_pos) / (tp - n_pos + fp - n_neg) END) / 2), 9) AS pr_auc FROM cu GROUP BY {g}""")
          .format(g="lang", src=B.SQL_DOC_SCORES))
def doc_pr_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pr_area_trapezoid(B.doc_scores(spark, sf_dir), group_cols=["lang"])


@register("correlation_extremes", f"""
WITH {FEAT_CTE}, c AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(covar_pop({c}, label) / NULLIF(stddev_pop({c}) * stddev_pop(label), 0), 6) AS corr FROM sf"
    for c in FEATURES) + """),
r AS (SELECT *, row_number() OVER (ORDER BY corr DESC, feature) AS hi, row_number() OVER (ORDER BY corr ASC, feature) AS lo
      FROM c WHERE corr IS NOT NULL)
SELECT feature, corr FROM r WHERE hi <= 5 OR lo <= 5""")
def correlation_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most positive and five most negative label correlations, merged."""
    return cohort.extremes(cohort.label_correlations(_stay_features(spark, sf_dir), FEATURES), "corr", "feature", 5)


@register("category_set_ops", f"""
WITH {COUNTS_CTE},
a AS (SELECT category FROM c WHERE priority = '1-URGENT'), b AS (SELECT category FROM c WHERE priority = '2-HIGH')
SELECT CAST((SELECT count(*) FROM (SELECT category FROM a UNION SELECT category FROM b) u) AS BIGINT) AS n_union,
       CAST((SELECT count(*) FROM (SELECT category FROM a INTERSECT SELECT category FROM b) i) AS BIGINT) AS n_both,
       CAST((SELECT count(*) FROM (SELECT category FROM a EXCEPT SELECT category FROM b) e) AS BIGINT) AS n_only_a,
       CAST((SELECT count(*) FROM (SELECT category FROM b EXCEPT SELECT category FROM a) e) AS BIGINT) AS n_only_b""")
def category_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union / intersection / differences of the category keys of two clusters."""
    c = _priority_counts(spark, sf_dir)
    a = c.where(F.col("priority") == "1-URGENT").select("category")
    b = c.where(F.col("priority") == "2-HIGH").select("category")
    both = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), "category", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n_union"),
                    F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).cast("long").alias("n_both"),
                    F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).cast("long").alias("n_only_a"),
                    F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).cast("long").alias("n_only_b"))


@register("stay_sample", f"""
SELECT hadm_id, label FROM ({B.SQL_STAYS}) s ORDER BY {hash_sql('hadm_id')}, hadm_id LIMIT 50""")
def stay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample of 50 stays (the sampling operator: order by hash, take n)."""
    from wardlens.operators.folds import hash_sample
    return hash_sample(B.stays(spark, sf_dir).select("hadm_id", "label"), "hadm_id", 50)


# ------------------------------------------------------------------ clustering
@register("centre_assignment", """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label AS k, pos, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY label, pos),
d AS (SELECT e.vec_id, c.k, sum((CAST(e.v AS DOUBLE) - c.m) * (CAST(e.v AS DOUBLE) - c.m)) AS dist
      FROM e JOIN c ON c.pos = e.pos GROUP BY e.vec_id, c.k)
SELECT vec_id, CAST(arg_min(k, dist) AS INTEGER) AS cluster, round(min(dist), 6) AS dist FROM d GROUP BY vec_id""")
def centre_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding to the nearest of the per-label mean vectors (given centres)."""
    from wardlens.operators.cluster import group_centres, nearest_centre
    emb = B.table(spark, sf_dir, "embeddings")
    ids, centres = group_centres(emb, "embedding", "label")
    out = nearest_centre(emb.select("vec_id", "embedding"), "embedding", centres, ids)
    return out.select("vec_id", F.col("cluster").cast("int").alias("cluster"), F.round("dist", 6).alias("dist"))


_MODES_CTE = (f"{DICT_CTE}, {SETS_CTE}, "
              f"hs AS (SELECT cats, min({hash_sql('hadm_id')}) AS h FROM sets GROUP BY cats), "
              "modes AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, cats AS m FROM hs ORDER BY h LIMIT 3), "
              "d AS (SELECT s.hadm_id, s.cats, modes.k, len(s.cats) + len(modes.m) - 2 * len(list_intersect(s.cats, modes.m)) AS cost "
              "FROM sets s CROSS JOIN modes), "
              "a AS (SELECT hadm_id, any_value(cats) AS cats, CAST(arg_min(k, cost * 100 + k) AS INTEGER) AS cluster, "
              "CAST(min(cost) AS INTEGER) AS cost FROM d GROUP BY hadm_id)")


def _kmodes_step(spark, sf_dir):
    from wardlens.operators.cluster import initial_modes, kmodes_assign
    from pyspark import StorageLevel
    sets = _sets(spark, sf_dir) \
        .persist(StorageLevel.MEMORY_AND_DISK)   # read by the seed pass and the assignment
    modes = initial_modes(sets, "categories", "hadm_id", 3)
    return kmodes_assign(sets, "categories", modes)


@register("kmodes_assign", f"WITH {_MODES_CTE} SELECT hadm_id, cluster, cost FROM a")
def kmodes_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One k-modes assignment step: each stay's category set to the nearest of three
    seed modes by set mismatch (ties to the lowest cluster)."""
    return _kmodes_step(spark, sf_dir).select("hadm_id", "cluster", "cost")


@register("kmodes_update", f"""
WITH {_MODES_CTE}, sz AS (SELECT cluster, count(*) AS size FROM a GROUP BY cluster),
it AS (SELECT cluster, u.item, count(*) AS n FROM a, unnest(a.cats) u(item) GROUP BY 1, 2)
SELECT it.cluster, it.item, CAST(it.n AS BIGINT) AS n, CAST(sz.size AS BIGINT) AS size FROM it JOIN sz USING (cluster)
WHERE 2 * it.n > sz.size""")
def kmodes_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One k-modes update step: per cluster the categories held by more than half."""
    from wardlens.operators.cluster import kmodes_update as upd
    return upd(_kmodes_step(spark, sf_dir), "categories")


@register("kmodes_clusters")
def kmodes_clusters(spark: SparkSession, sf_dir: str, n_init: int = 100, max_iter: int = 100) -> DataFrame:
    """Full k-modes (k = 3, 100 restarts advanced together, one pass per iteration) on
    the stays' category sets: stay, cluster, cost."""
    from wardlens.operators.cluster import kmodes
    sets = _sets(spark, sf_dir)
    assigned, _, _, _ = kmodes(sets, "categories", "hadm_id", k=3, n_init=n_init, max_iter=max_iter)
    return assigned.select("hadm_id", "cluster", "cost")


@register("kmodes_cluster_sizes")
def kmodes_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and positive rates of the k-modes clusters (cluster profile of CLU4)."""
    assigned = kmodes_clusters(spark, sf_dir)
    st = B.stays(spark, sf_dir).select("hadm_id", "label")
    return codes.cluster_profile(assigned.join(st, "hadm_id"), "cluster")


@register("kmeans_elbow")
def kmeans_elbow(spark: SparkSession, sf_dir: str, max_k: int = 10) -> DataFrame:
    """Inertia of k-means for k = 1..10 on the embeddings, ten starts each, all k and starts at once."""
    from wardlens.operators.kmeans import kmeans_all
    got = kmeans_all(B.table(spark, sf_dir, "embeddings"), "embedding", "vec_id", range(1, max_k + 1))
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(got.inertia.items())], "k int, inertia double")


@register("kmeans_labels")
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means (k = 4) cluster per stay on z-scored features; with the cluster sizes."""
    from wardlens.operators.cluster import kmeans_fit
    from wardlens.operators.features import assemble, zscore
    f = _stay_features(spark, sf_dir).select("hadm_id", *FEATURES)
    x = assemble(zscore(f, FEATURES), FEATURES)
    model = kmeans_fit(x, "features", 4, seed=7)
    out = model.transform(x).select("hadm_id", "cluster")
    sizes = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return out.join(sizes, "cluster")


# ------------------------------------------------------------------ fits, search, attribution
def _model_frame(spark, sf_dir):
    """Stay features + label + fold (5 stratified) + 80/20 split, ready for fits; written once, as fits, folds and
    scores read it many times."""
    from wardlens.operators.folds import hash_split
    from wardlens.session import tmp_output_dir
    f = _stay_features(spark, sf_dir).select("hadm_id", "label", "priority", *FEATURES)
    f = hash_split(ntile_folds(f, "hadm_id", 5, ["label"]), "hadm_id", 0.2)
    path = tmp_output_dir(spark, "model_frame")
    f.write.parquet(path)
    spark.catalog.clearCache()   # the folds' ranks
    return spark.read.schema(f.schema).parquet(path)


def _fit(kind, train, **params):
    from wardlens.operators.models import add_class_weight, make_estimator, scaled_pipeline
    weighted = kind not in ("mlp",)
    tr = add_class_weight(train) if weighted else train
    est = make_estimator(kind, weight_col="weight" if weighted else None, n_features=len(FEATURES), **params)
    return scaled_pipeline(FEATURES, est).fit(tr)


def _logistic_reports(df, cluster_col):
    """Per cluster with both classes in both parts: class-weighted logistic fit on the
    80 % part (all clusters advance together), class report on the 20 % part (one frame
    keyed by cluster); and the skipped clusters as a column."""
    from wardlens.functions.columns import threshold
    from wardlens.operators.models import skipped_column
    from wardlens.operators.newton import grouped_logistic
    df = df.select("label", "split", *dict.fromkeys([cluster_col, *FEATURES]))
    scored, skipped, _ = grouped_logistic(df, cluster_col, FEATURES, test=F.col("split") == "test")
    preds = scored.where(F.col("split") == "test").select(cluster_col, "label", threshold("score", 0.5).alias("pred"))
    rep = evaluate.class_report(preds, group_cols=[cluster_col])
    return rep.select(*[c for c in rep.columns if c != cluster_col], cluster_col), skipped_column(skipped)


@register("cluster_model_reports")
def cluster_model_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority cluster: class-weighted logistic fit on the 80 % part, class
    report (precision / recall / f1 / support) on the 20 % part; ``skipped`` names
    the clusters without both classes in both parts."""
    rep, skipped = _logistic_reports(_model_frame(spark, sf_dir), "priority")
    return rep.withColumn("skipped", skipped)


@register("cluster_report_summary")
def cluster_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and upper median over clusters of every metric, per class; ``skipped`` as above."""
    rep, skipped = _logistic_reports(_model_frame(spark, sf_dir), "priority")
    return cohort.metric_summary(rep, ["class"], ["precision", "recall", "f1", "support"]).withColumn("skipped", skipped)


@register("oof_evaluation")
def oof_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of a weighted logistic fit (5 stratified folds), pooled:
    ROC area, average precision and PR area."""
    from wardlens.operators.models import out_of_fold
    df = _model_frame(spark, sf_dir)
    pooled = out_of_fold(df, "fold", lambda tr: _fit("logistic", tr), "logistic", k=5).cache()
    return evaluate.curve_areas(pooled)


@register("grid_search_results")
def grid_search_results(spark: SparkSession, sf_dir: str, max_iter: int = 100) -> DataFrame:
    """Exhaustive grid over the logistic penalty with 5-fold mean / std ROC area and rank."""
    from wardlens.operators.models import add_class_weight, grid_search, make_estimator
    from wardlens.operators.features import assemble
    df = add_class_weight(assemble(_model_frame(spark, sf_dir), FEATURES)).cache()
    est = make_estimator("logistic", weight_col="weight", maxIter=max_iter)
    _, res, _ = grid_search(df, est, {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}, "fold")
    return res


# The stages of the original search that have a Spark parameter (not those of the L1 penalty).
SEARCH_STAGES = ({"maxIter": range(50, 250, 10)},
                 {"maxDepth": range(1, 10), "minInstancesPerNode": range(1, 10)},
                 {"minInfoGain": [i / 10 for i in range(5)]},
                 {"subsamplingRate": [i / 10 for i in range(1, 10)], "featureSubsetStrategy": [str(i / 10) for i in range(1, 10)]})


@register("staged_search_progress")
def staged_search_progress(spark: SparkSession, sf_dir: str, stages=SEARCH_STAGES, folds: int = 5) -> DataFrame:
    """Coordinate search for boosted trees: rounds, then depth x min rows per node, then
    min gain, then row x column sampling, each stage from the best so far; score per stage."""
    from wardlens.operators.models import add_class_weight, make_estimator, staged_search
    from wardlens.operators.features import assemble
    df = _model_frame(spark, sf_dir).drop("fold")
    df = add_class_weight(assemble(ntile_folds(df, "hadm_id", folds, ["label"]), FEATURES)).cache()
    _, prog = staged_search(df, lambda p: make_estimator("gbt", weight_col="weight", **p), stages, "fold")
    return prog


@register("model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven model kinds fitted on the same 80 % part; ROC area and f1 of the
    positive class on the 20 % part, side by side."""
    from wardlens.functions.columns import threshold
    from wardlens.operators.models import KINDS, score_column
    df = _model_frame(spark, sf_dir).cache()
    train, test = df.where(F.col("split") == "train"), df.where(F.col("split") == "test")
    preds = None
    for kind in KINDS:
        cut = 0.0 if kind == "linear_svc" else 0.5
        p = score_column(_fit(kind, train).transform(test), kind).select(
            F.lit(kind).alias("model"), "label", "score", threshold("score", cut).alias("pred"))
        preds = p if preds is None else preds.unionByName(p)
    # one frame keyed by model: areas and the positive-class f1 grouped by it
    auc = evaluate.roc_auc(preds, group_cols=["model"])
    f1 = evaluate.class_report(preds, group_cols=["model"]).where(F.col("class") == 1) \
        .select("model", F.col("f1").alias("f1_pos"))
    return auc.join(f1, "model").select("model", "auc", "f1_pos")


@register("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-forest importances, named and ranked."""
    from wardlens.operators.attribution import named_importances
    model = _fit("random_forest", _model_frame(spark, sf_dir))
    return named_importances(model.stages[-1], FEATURES)


@register("importance_stability")
def importance_stability(spark: SparkSession, sf_dir: str, refits: int = 500, trees: int = 20) -> DataFrame:
    """Mean, population std and top-7 count of forest importances over 500 refits: one forest of refits x trees, whose
    blocks of ``trees`` are the refits."""
    from wardlens.operators.forest import fit_forest, importance_blocks
    from wardlens.operators.models import add_class_weight
    df = add_class_weight(_stay_features(spark, sf_dir).select("hadm_id", "label", *FEATURES))
    model = fit_forest(df, FEATURES, refits * trees, "hadm_id", weight_col="weight")
    return cohort.importance_stats(importance_blocks(df, model, trees))


@register("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC-area drop of a fitted logistic model when each feature is shuffled."""
    from wardlens.operators.attribution import permutation_importance as perm
    df = _model_frame(spark, sf_dir).cache()
    model = _fit("logistic", df.where(F.col("split") == "train"))
    test = df.where(F.col("split") == "test")
    return perm(_AssembledModel(model), test, FEATURES, "hadm_id")


class _AssembledModel:
    """Adapter: a pipeline whose first stage assembles ``FEATURES`` itself."""

    def __init__(self, model):
        self.model = model

    def transform(self, df):
        return self.model.transform(df.drop("features"))


@register("linear_contributions")
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact contributions of a linear score (standardised features): mean |w (x - mean)|."""
    from wardlens.operators.attribution import linear_contributions as lin
    df = _model_frame(spark, sf_dir)
    model = _fit("logistic", df)
    # weights of raw features: those of the fitted scaler's units over its own deviations
    std = model.stages[1].std.toArray()
    w = [float(v / d) if d else 0.0 for v, d in zip(model.stages[-1].coefficients.toArray(), std)]
    return lin(df, FEATURES, w)


SHAPLEY_ORDERS = -(-(2 * len(FEATURES) + 2048) // (2 * len(FEATURES)))   # an order scores 2 M vectors


@register("sampled_shapley")
def sampled_shapley(spark: SparkSession, sf_dir: str, n_perm: int = SHAPLEY_ORDERS) -> DataFrame:
    """Sampled Shapley values of a boosted-tree probability for every stay, against a
    10-centre k-means background of all stays; as many sampled feature orders a stay as
    give the kernel explainer's 2 M + 2048 scores (M features)."""
    from pyspark.ml import PipelineModel
    from wardlens.operators.attribution import sampled_shapley as shap
    from wardlens.operators.cluster import background_summary
    from wardlens.operators.features import assemble
    df = _model_frame(spark, sf_dir).cache()
    model = _fit("gbt", df)
    inner = PipelineModel(stages=model.stages[1:])
    bg = background_summary(assemble(df, FEATURES, out="features"), "features", k=10).collect()
    background = [r["centre"] for r in bg]
    return shap(_RenamedModel(inner), df, background, FEATURES, "hadm_id", n_perm=n_perm, weights=[r["n"] for r in bg])


class _RenamedModel:
    """Adapter: feed an assembled ``features`` vector to the scaler stage."""

    def __init__(self, model):
        self.model = model

    def transform(self, df):
        return self.model.transform(df.withColumnRenamed("features", "_raw"))


@register("pca_variance")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained variance ratio per principal component of the standardised stay
    features, its running sum, and the component count chosen by the below-one rule."""
    from wardlens.operators.features import assemble, components_below_one, pca, zscore
    df = assemble(zscore(_stay_features(spark, sf_dir), FEATURES), FEATURES)
    _, ev = pca(df, len(FEATURES))
    k = components_below_one(ev)
    rows, cum = [], 0.0
    for i, v in enumerate(ev):
        cum += v
        rows.append((i, float(v), float(cum), i == k))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double, chosen boolean")


@register("svd_singular_values")
def svd_singular_values(spark: SparkSession, sf_dir: str, dims: int = 50) -> DataFrame:
    """Rank-50 truncated SVD of the embedding matrix: the projected rows, all singular
    values and the explained variance ratio."""
    from pyspark.ml.functions import array_to_vector
    from wardlens.operators.features import explained_ratio, truncated_svd
    emb = B.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    width = emb.first()["features"].size
    proj, s = truncated_svd(emb, min(dims, width))
    return proj.select("vec_id", "svd", F.lit(float(s[0])).alias("top_singular_value"),
                       F.array(*[F.lit(float(v)) for v in s]).alias("singular_values"),
                       F.lit(explained_ratio(proj, width, len(s))).alias("explained_ratio"))


@register("category_tfidf")
def category_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tf-idf (smoothed idf + 1, l2 rows) of the stays' category sets and the binary
    incidence vectors, as arrays."""
    from wardlens.operators.features import incidence_vectors, tfidf
    sets = _stored_sets(spark, sf_dir)
    t = tfidf(sets, "categories")
    bow, _ = incidence_vectors(t, "categories")
    from pyspark.ml.functions import vector_to_array
    return bow.select("hadm_id", vector_to_array("tfidf").alias("tfidf"), vector_to_array("bow").alias("bow"))


# ------------------------------------------------------------------ reports, descriptions, sinks
@register("report_pivot", f"""
WITH rep AS ({REPORT_SQL}),
l AS (SELECT lang, class, 'precision' AS metric, precision AS value FROM rep UNION ALL
      SELECT lang, class, 'recall', recall FROM rep UNION ALL SELECT lang, class, 'f1', f1 FROM rep)
SELECT lang, metric, max(CASE WHEN class = 0 THEN value END) AS class_0, max(CASE WHEN class = 1 THEN value END) AS class_1
FROM l GROUP BY lang, metric""")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-language report pivoted to metric x class."""
    rep = evaluate.class_report(_doc_pred(spark, sf_dir), group_cols=["lang"])
    return cohort.pivot_report(rep, group_cols=["lang"])


_CH_TITLES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in CHAPTERS)


@register("cluster_descriptions", f"""
WITH {_STAY_CH_CTE}, ti(name, descr) AS (VALUES {_CH_TITLES})
SELECT j.cluster, ti.descr, CAST(count(*) AS BIGINT) AS n_stays, round(avg(j.label), 6) AS pos_rate
FROM j LEFT JOIN ti ON ti.name = j.cluster GROUP BY j.cluster, ti.descr""")
def cluster_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter clusters with their description from the hierarchy, size and rate."""
    desc = codes.node_descriptions(_paths(spark), 1).withColumnRenamed("code", "cluster")
    st = _stay_chapters(spark, sf_dir)
    prof = st.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_stays"), F.round(F.avg("label"), 6).alias("pos_rate"))
    return prof.join(codes.bounded_broadcast(desc), "cluster", "left").select("cluster", "descr", "n_stays", "pos_rate")


@register("cluster_split_roundtrip", f"""
WITH {_STAY_CH_CTE}
SELECT coalesce(cluster, '__HIVE_DEFAULT_PARTITION__') AS cluster, CAST(count(*) AS BIGINT) AS n_stays,
       CAST(sum(label) AS BIGINT) AS n_pos FROM j GROUP BY 1""")
def cluster_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays written as one directory per chapter (partitionBy) under the
    checkpoint folder, read back; counts per directory."""
    from wardlens.session import tmp_output_dir
    from wardlens.sources.io import write_by_value
    path = tmp_output_dir(spark, "cluster_split")
    write_by_value(_stay_chapters(spark, sf_dir).select("hadm_id", "label", "cluster"), path, "cluster")
    back = spark.read.option("basePath", path).parquet(path)
    back = back.withColumn("cluster", F.coalesce(F.col("cluster").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    return back.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_stays"), F.sum("label").cast("long").alias("n_pos"))


@register("stay_code_lists", f"""
WITH d AS ({B.SQL_DIAG}), l AS (SELECT hadm_id, list_sort(list(DISTINCT icd9_code)) AS codes FROM d GROUP BY hadm_id)
SELECT s.hadm_id, coalesce(array_to_string(l.codes, ','), '') AS codes, CAST(coalesce(len(l.codes), 0) AS INTEGER) AS n_codes
FROM ({B.SQL_STAYS}) s LEFT JOIN l ON l.hadm_id = s.hadm_id""")
def stay_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stay with its sorted distinct codes; stays without diagnoses get an
    empty list (left lookup)."""
    lists = codes.code_lists(B.diagnoses(spark, sf_dir))
    out = codes.attach_codes(B.stays(spark, sf_dir).select("hadm_id"), lists)
    return out.select("hadm_id", F.array_join("codes", ",").alias("codes"), F.size("codes").alias("n_codes"))


@register("som_clusters")
def som_clusters(spark: SparkSession, sf_dir: str, side: int = 30) -> DataFrame:
    """Self-organising map (30 x 30, batch, 2 rough + 2 fine epochs) on the
    variance-normalised category incidence of every stay; units clustered by
    k-means (k = 3); stay -> unit -> cluster."""
    from pyspark.ml.functions import vector_to_array
    from wardlens.operators.cluster import som_clusters as som
    from wardlens.operators.features import incidence_vectors
    from wardlens.session import spread
    sets = _stored_sets(spark, sf_dir)
    bow, vocab = incidence_vectors(sets, "categories")
    x = bow.select("hadm_id", vector_to_array("bow").alias("v"))
    n = len(vocab)
    stats = x.select(F.posexplode("v").alias("i", "b")).groupBy("i").agg(F.avg("b").alias("m"), F.stddev_pop("b").alias("s")) \
        .orderBy("i").collect()   # one row per category (bounded by the vocabulary)
    m = [r["m"] for r in stats]
    sd = [r["s"] or 1.0 for r in stats]
    z = x.select("hadm_id", F.transform("v", lambda b, i: (b - F.element_at(F.array(*[F.lit(v) for v in m]), i + 1))
                                        / F.element_at(F.array(*[F.lit(v) for v in sd]), i + 1)).alias("v"))
    return som(spread(z, "incidence") if n else z, "v", "hadm_id", side, side, k=3, rough_epochs=2, finetune_epochs=2)


@register("cluster_cross_tab", f"""
WITH {_STAY_CH_CTE}
SELECT priority, cluster, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY priority, cluster""")
def cluster_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays per (priority cluster, hierarchy chapter)."""
    return codes.cluster_cross_tab(_stay_chapters(spark, sf_dir), "priority", "cluster")


@register("chapter_model_reports")
def chapter_model_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hierarchy chapter with both classes in both parts: class-weighted logistic
    fit on the 80 % part, class report on the 20 % part; then mean, support-weighted
    mean and upper median per class and metric over the chapters; ``skipped`` names
    the other chapters."""
    ch = _stay_chapters(spark, sf_dir).select("hadm_id", "cluster")
    df = _model_frame(spark, sf_dir).join(ch, "hadm_id", "inner").where(F.col("cluster").isNotNull())
    rep, skipped = _logistic_reports(df, "cluster")
    return cohort.metric_summary(rep, ["class"], ["precision", "recall", "f1", "support"]).withColumn("skipped", skipped)


@register("chapter_concentration", f"""
WITH {_STAY_CH_CTE},
c AS (SELECT priority, cluster, count(*) AS n FROM j GROUP BY priority, cluster),
g AS (SELECT priority, n + 1e-7 AS x, row_number() OVER (PARTITION BY priority ORDER BY n) AS i,
      count(*) OVER (PARTITION BY priority) AS m FROM c),
gi AS (SELECT priority, round(sum((2 * i - m - 1) * x) / (max(m) * sum(x)), 6) AS gini FROM g GROUP BY priority),
en AS (SELECT priority, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, CAST(count(*) AS BIGINT) AS n_items
       FROM c GROUP BY priority)
SELECT gi.priority, gi.gini, en.entropy, en.n_items FROM gi JOIN en USING (priority)""")
def chapter_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free spread of hierarchy chapters within each priority cluster: Gini of
    the chapter counts and entropy of the chapter shares (beside the id-based Gini)."""
    return cohort.count_concentration(_stay_chapters(spark, sf_dir), "priority", "cluster")


@register("stay_category_incidence", f"""
WITH {DICT_CTE}, {SETS_CTE}
SELECT DISTINCT hadm_id, u.item FROM sets, unnest(sets.cats) u(item)""")
def stay_category_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary stay x category incidence in long form (one row per present pair)."""
    from wardlens.operators.features import incidence_long
    sets = _sets(spark, sf_dir)
    return incidence_long(sets, "hadm_id", "categories")


@register("kmeans_label_categories")
def kmeans_label_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories per k-means label (k = 4 on the standardised stay features): stays
    per (cluster, category), for every cluster (not only the last)."""
    labels = kmeans_labels(spark, sf_dir).select("hadm_id", "cluster")
    sets = _sets(spark, sf_dir)
    return cohort.category_counts(labels.join(sets, "hadm_id"), "cluster", "categories")


# ------------------------------------------------------------------ boosted trees with leaf penalties
SPLIT_BINS = 16
SPLIT_L1, SPLIT_L2, SPLIT_CHILD = 0.5, 1.0, 20.0


def _split_sql() -> str:
    bins = SPLIT_BINS
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN hi.{c} > lo.{c} THEN CAST(greatest(least(floor((sf.{c} - lo.{c}) / ((hi.{c} - lo.{c}) / {bins})), {bins - 1}), 0) AS INTEGER) "
        f"ELSE 0 END AS bin, sf.label FROM sf, lo, hi" for c in FEATURES)
    def part(g, h):
        return f"power(greatest(abs({g}) - {SPLIT_L1}, 0), 2) / ({h} + {SPLIT_L2})"
    return f"""
WITH {FEAT_CTE}, lo AS (SELECT {", ".join(f"min({c}) AS {c}" for c in FEATURES)} FROM sf), hi AS (SELECT {", ".join(f"max({c}) AS {c}" for c in FEATURES)} FROM sf),
c AS (SELECT feature, bin, sum(0.5 - label) AS g, count(*) * 0.25 AS h FROM ({cells}) x GROUP BY feature, bin),
w AS (SELECT feature, bin, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht
      FROM c WINDOW u AS (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT feature, bin, CAST(gl AS DOUBLE) AS g_left, CAST(hl AS DOUBLE) AS h_left,
       CASE WHEN hl >= {SPLIT_CHILD} AND ht - hl >= {SPLIT_CHILD} THEN round(CAST(({part("gl", "hl")} + {part("(gt - gl)", "(ht - hl)")} - {part("gt", "ht")}) / 2 AS DOUBLE), 6) END AS gain
FROM w"""


@register("first_split_table", _split_sql())
def first_split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split that the first boosting round weighs: gradient and hessian of the left side and the penalised gain,
    per feature and bin (one aggregate of binned rows)."""
    from wardlens.operators import boosting as bo
    df = _stay_features(spark, sf_dir)
    edges = bo.width_edges(df, FEATURES, SPLIT_BINS)
    cells = bo.first_cells(df, FEATURES, edges, SPLIT_BINS)
    p = bo.Penalties(l1=SPLIT_L1, l2=SPLIT_L2, min_child_weight=SPLIT_CHILD)
    return bo.split_table(cells, p).withColumn("gain", F.round("gain", 6))


@register("boosted_round_scores")
def boosted_round_scores(spark: SparkSession, sf_dir: str, counts=range(50, 250, 10), folds: int = 5) -> DataFrame:
    """The search over the number of rounds: one ensemble per fold, all folds fitted together, and every number of rounds
    scored as a prefix of it in one pass; per number of rounds the pooled out-of-fold ROC area and log loss.  The counts are
    those of the original search's first stage (240 rounds of three jobs each)."""
    from wardlens.operators import boosting as bo
    from wardlens.operators.models import add_class_weight
    df = add_class_weight(_model_frame(spark, sf_dir).select("hadm_id", "label", "fold", *FEATURES)).checkpoint(eager=True)
    model = bo.fit_boosted(df, FEATURES, max(counts), bo.Penalties(), weight_col="weight", fold_col="fold", folds=folds)
    scored = bo.score_prefixes(df, model, list(counts), "fold", ["label"]).checkpoint(eager=True)
    right = F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))
    loss = scored.groupBy("rounds").agg(F.avg(-F.log(F.greatest(right, F.lit(1e-15)))).alias("log_loss"))
    return evaluate.roc_auc(scored, group_cols=["rounds"]).join(loss, "rounds").select("rounds", "auc", "log_loss")


@register("cluster_newton_sums", f"WITH {FEAT_CTE} " + " UNION ALL ".join(
    f"SELECT priority, '{t}' AS term, round(sum((0.5 - label) * {x}), 4) AS gradient, round(sum(0.25 * {x} * {x}), 2) AS curvature FROM sf GROUP BY priority"
    for t, x in [("intercept", "1.0"), *((c, c) for c in ("quantity_mean", "discount_mean"))]))
def cluster_newton_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First Newton step of the grouped logistic fit: gradient and curvature of every cluster's coefficients, one scan
    for all clusters."""
    from wardlens.operators.newton import first_step_sums
    s = first_step_sums(_stay_features(spark, sf_dir), "priority", ["quantity_mean", "discount_mean"])
    return s.select("priority", "term", F.round("gradient", 4).alias("gradient"), F.round("curvature", 2).alias("curvature"))


from wardlens.plans import centres, forests, spectra, tables  # noqa: E402, F401  (they register their queries)
