"""Hand-sized corner cases (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from wardlens.functions import columns as C
from wardlens.operators import codes, cohort, evaluate
from wardlens.operators.ordered import gini, ntile_folds, running_totals, upper_median


def _iv(spark, names, truncated=False):
    return codes.intervals_from_names(spark, names, truncated)


def _assign(spark, code, names, truncated=False):
    df = spark.createDataFrame([(code,)], "code string")
    return codes.assign_code_cluster(spark, df, "code", _iv(spark, names, truncated)).first()["cluster"]


def test_code_in_interval(spark):
    assert _assign(spark, "41401", ["320-389", "390-459"]) == "390-459"


def test_code_in_gap(spark):
    assert _assign(spark, "76501", ["740-759", "780-799"]) is None
    assert _assign(spark, "76501", ["740-759", "780-799"], truncated=True) == "780-799"


def test_external_supplementary_and_bad_codes(spark):
    for c in ("E8859", "V3000", "nan"):
        assert _assign(spark, c, ["001-139", "800-999"]) is None


def test_duplicate_dictionary_key_last_wins(spark):
    d = spark.createDataFrame([(1, "4280", "108"), (2, "4280", "109")], "line_no long, icd9_code string, category string")
    diag = spark.createDataFrame([(1, "4280"), (1, "zzz")], "hadm_id long, icd9_code string")
    out = codes.category_sets(diag, d).first()
    assert out["categories"] == ["109"]


def test_stratified_fold_sizes(spark):
    rows = [(i, 0) for i in range(9906)] + [(100000 + i, 1) for i in range(972)]
    df = spark.createDataFrame(rows, "id long, label int")
    f = ntile_folds(df, "id", 5, ["label"], n_buckets=4)
    got = {(r["label"], r["fold"]): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    assert [got[(0, k)] for k in range(5)] == [1982, 1981, 1981, 1981, 1981]
    assert [got[(1, k)] for k in range(5)] == [195, 195, 194, 194, 194]
    # published fold class weights of the first cluster
    from wardlens.operators.folds import train_class_weights
    w = sorted((r["fold"], r["class_weight"]) for r in train_class_weights(f).collect())
    assert abs(w[0][1] - 10.198198198198199) < 1e-12
    assert abs(w[2][1] - 10.186375321336762) < 1e-12


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert upper_median(df, "x").first()["median"] == 3.0


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(C.round_half_even("x")).collect()] == [0.0, 2.0, 2.0]


def test_constant_column(spark):
    from wardlens.operators.features import zscore
    df = spark.createDataFrame([(5.0, 0), (5.0, 1), (5.0, 0)], "x double, label int")
    assert [r["x"] for r in zscore(df, ["x"]).collect()] == [0.0, 0.0, 0.0]
    assert cohort.label_correlations(df, ["x"]).first()["corr"] is None


def test_undefined_precision_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    rep = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert rep[1]["precision"] == 0.0 and rep[1]["recall"] == 0.0 and rep[1]["f1"] == 0.0


def test_single_class_weight_null(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert cohort.class_weights(df).first()["class_weight"] is None


def test_tied_scores(spark):
    df = spark.createDataFrame([(0.3, 1), (0.3, 0), (0.3, 1), (0.3, 0)], "score double, label int")
    assert evaluate.roc_auc(df).first()["auc"] == 0.5
    assert evaluate.roc_auc_trapezoid(df).first()["auc"] == 0.5
    assert evaluate.roc_curve(df).count() == 2   # origin + one step


def test_gini_all_equal(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "x double")
    assert abs(gini(df, "x").first()["gini"]) < 1e-12


def test_gini_matches_formula(spark):
    import numpy as np
    vals = [3.0, -1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]
    a = np.array(vals) - min(vals) + 1e-7
    a.sort()
    i = np.arange(1, len(a) + 1)
    want = np.sum((2 * i - len(a) - 1) * a) / (len(a) * np.sum(a))
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert abs(gini(df, "x", n_buckets=3).first()["gini"] - want) < 1e-12


def test_label_from_null(spark):
    df = spark.createDataFrame([("Yes",), ("No",), (None,)], "f string")
    assert [r[0] for r in df.select(C.label_from_yes("f")).collect()] == [1, 0, 0]


def test_running_totals_buckets(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"), (F.col("id") % 3).alias("g"))
    out = running_totals(df, "k", ["v"], ["g"], n_buckets=7)
    bad = out.where(F.col("cum_v") != F.floor(F.col("k") / 3) + 1).count()
    assert bad == 0


def test_parse_printed_list(spark):
    df = spark.createDataFrame([("['4280', '5849']",), ("[]",), ("('108', '157')",)], "s string")
    got = [r[0] for r in df.select(C.parse_printed_list("s")).collect()[:2]]
    assert got == [["4280", "5849"], []]
    assert df.select(C.parse_printed_tuple("s")).collect()[2][0] == ["108", "157"]


def test_trim_quotes(spark):
    df = spark.createDataFrame([(" '4280' \t",)], "s string")
    assert df.select(C.trim_chars("s")).first()[0] == "4280"


def test_prefix_categories_longest_wins(spark):
    codes_df = spark.createDataFrame([("41401",), ("4280",), ("9999",)], "code string")
    pref = spark.createDataFrame([("41", "a"), ("414", "b"), ("428", "c")], "prefix string, category string")
    got = {r["code"]: r["category"] for r in codes.prefix_categories(codes_df, "code", pref).collect()}
    assert got == {"41401": "b", "4280": "c"}


def test_dissimilarity_matches_pairs(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 1), ("c", "z", 2)],
                                   "g string, item string, n long")
    tot = cohort.dissimilarity(counts, "g", "item").first()
    pairs = cohort.pair_dissimilarity(counts, "g", "item").agg(F.sum("score"), F.sum("overlap")).first()
    assert tot["score"] == pairs[0] and tot["overlap"] == pairs[1]


def test_count_concentration(spark):
    import math
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "z")] * 4, "g string, item string")
    got = {r["g"]: r for r in cohort.count_concentration(df, "g", "item").collect()}
    p = [0.75, 0.25]
    assert abs(got["a"]["entropy"] - round(-sum(q * math.log(q) for q in p), 6)) < 1e-12
    assert got["b"]["entropy"] == 0.0 and got["b"]["n_items"] == 1
    assert abs(got["b"]["gini"]) < 1e-12


def test_hash_fraction_is_repeatable_and_close(spark):
    from wardlens.operators.folds import hash_fraction
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = hash_fraction(df, "k", 0.1)
    b = hash_fraction(df.repartition(7), "k", 0.1)
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    assert 1700 < a.count() < 2300


def test_lookup_memo_keeps_interval_sets_apart(spark):
    a = codes.code3_lookup_local(spark, _iv(spark, ["740-759", "780-799"]))
    b = codes.code3_lookup_local(spark, _iv(spark, ["740-759", "780-799"], truncated=True))
    get = lambda df: {r["code3"]: r["cluster"] for r in df.collect()}
    assert 765 not in get(a) and get(b)[765] == "780-799"
    assert get(codes.code3_lookup_local(spark, _iv(spark, ["740-759", "780-799"]))) == get(a)
