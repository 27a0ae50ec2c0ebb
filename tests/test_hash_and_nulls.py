"""The key hash mixes, null groups are kept, and shared formulas hold with missing values."""

from pyspark.sql import functions as F

from wardlens.operators import cohort, evaluate
from wardlens.operators.folds import hash_bits, hash_fraction, hash_sample, hash_split
from wardlens.operators.ordered import ntile_folds, running_totals


def test_split_of_negative_large_and_text_keys(spark):
    for keys in (spark.range(-5000, 0), spark.range(10 ** 15, 10 ** 15 + 5000), spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"))):
        n = hash_split(keys, "id", 0.2).where("split = 'test'").count()
        assert 850 < n < 1150
    assert 5 < hash_split(spark.range(5000), "id", 0.004).where("split = 'test'").count() < 45
    assert 400 < hash_fraction(spark.range(5000), "id", 0.1, salt=3).count() < 600


def test_sample_is_not_the_lowest_ids_and_salts_differ(spark):
    ids = sorted(r[0] for r in hash_sample(spark.range(2000), "id", 50).collect())
    assert ids[-1] > 1000 and ids != list(range(50))
    orders = {tuple(r[0] for r in spark.range(300).orderBy(hash_bits("id", s)).limit(5).collect()) for s in range(10)}
    assert len(orders) == 10


def test_null_groups_do_not_depend_on_the_buckets(spark):
    rows = [(i, None if i % 3 == 0 else "a", float(i % 7), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grp string, score double, label int")
    counts = {n: sorted(map(str, running_totals(df.select("id", "grp", F.lit(1).alias("x")), "id", ["x"], ["grp"], n_buckets=n).select("id", "cum_x").collect()))
              for n in (1, 4, 200)}
    assert counts[1] == counts[4] == counts[200] and len(counts[1]) == 60
    assert ntile_folds(df, "id", 5, ["grp"], n_buckets=4).count() == 60
    assert evaluate.roc_auc(df, group_cols=["grp"]).count() == 2


def test_correlation_with_missing_values_is_over_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (None, 1), (4.0, 1), (None, 0), (0.5, 0)], "x double, label int")
    got = cohort.label_correlations(df, ["x"]).first()["corr"]
    want = df.where("x is not null").agg(F.corr("x", "label")).first()[0]
    assert abs(got - want) < 1e-6


def test_soft_sensitivity_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.9)], "label int, prob double")
    assert abs(evaluate.sensitivity_specificity(df).first()["sensitivity"] - 0.5) < 1e-6
