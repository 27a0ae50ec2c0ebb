"""Readers and writers on files in a fresh temp folder."""

import os
import tempfile

from pyspark.sql import functions as F

from wardlens.operators import cohort
from wardlens.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="wl-test-")


def test_skip_junk_lines_and_strip_quotes(spark):
    d = _tmp()
    p = os.path.join(d, "dict.csv")
    with open(p, "w") as f:
        f.write("junk line\n")
        f.write("\"'ICD-9-CM CODE'\",\"'CCS CATEGORY'\",\"'CCS CATEGORY DESCRIPTION'\"\n")
        f.write("more junk\n")
        f.write("\"'4280 '\",\"'108 '\",\"'Heart failure'\"\n")
        f.write("\"'4280 '\",\"'109 '\",\"'Other'\"\n")
    df = io.read_skipping_lines(spark, p, skip=(0, 2))
    assert df.columns == ["line_no", "ICD-9-CM CODE", "CCS CATEGORY", "CCS CATEGORY DESCRIPTION"]
    rows = [(r[1], r[2]) for r in df.orderBy("line_no").collect()]
    assert rows == [("4280", "108"), ("4280", "109")]


def test_headerless_and_index_drop(spark):
    d = _tmp()
    p = os.path.join(d, "r.csv")
    with open(p, "w") as f:
        f.write(",f1_score,precision,recall,support\nclass one,0.5,0.75,0.375,40.0\n")
    df = io.read_headerless(spark, p, ["class", "f1", "precision", "recall", "support"],
                            ["string", "double", "double", "double", "double"], skip_header=True)
    assert df.first()["support"] == 40.0
    t = io.read_table(spark, p)
    assert "_c0" in t.columns and "_c0" not in io.drop_index_columns(t).columns


def test_partitioned_write_roundtrip_and_append(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y", "z"]), (3, "a", [])],
                               "id long, cluster string, codes array<string>")
    io.write_by_value(df, os.path.join(d, "split"), "cluster")
    back = spark.read.parquet(os.path.join(d, "split"))
    assert back.where(F.col("cluster") == "a").count() == 2
    assert sorted(back.where(F.col("id") == 2).first()["codes"]) == ["y", "z"]
    io.write_table(df.drop("codes"), os.path.join(d, "app"), "csv", "overwrite")
    io.write_table(df.drop("codes"), os.path.join(d, "app2"), "csv", "append")
    io.write_table(df.drop("codes"), os.path.join(d, "app2"), "csv", "append")
    assert spark.read.option("header", True).csv(os.path.join(d, "app2")).count() == 6


def test_keyed_files(spark):
    d = _tmp()
    for key in ("390-459", "460-519"):
        with open(os.path.join(d, f"Y_cluster_{key}.csv"), "w") as f:
            f.write("label\n0\n1\n")
    with open(os.path.join(d, "mean_results.csv"), "w") as f:
        f.write("label\n9\n")
    df = io.read_keyed_files(spark, os.path.join(d, "*.csv"), exclude=["mean_results.csv"])
    got = sorted((r["cluster"], r["n"]) for r in df.groupBy("cluster").agg(F.count("*").alias("n")).collect())
    assert got == [("390-459", 2), ("460-519", 2)]


def test_lines_are_numbered_across_blocks(spark):
    p = os.path.join(_tmp(), "many.txt")
    want = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    with open(p, "w") as f:
        f.write("\n".join(want) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = io.numbered_lines(spark, p)
        assert [r["value"] for r in lines.orderBy("line_no").collect()] == want
        assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_paired_files_name_what_they_skip(spark):
    d = _tmp()
    files = {"X_c_a b.csv": "p,q\n1,2.5\n\n3,4.5\n", "Y_c_a b.csv": "0\n1\n",
             "X_c_broken.csv": "p,q\n1,2\n1,2,3\n", "Y_c_broken.csv": "0\n1\n",
             "X_c_typed.csv": "p,q\n1,two\n", "Y_c_typed.csv": "0\n",
             "X_c_empty.csv": "", "Y_c_empty.csv": "1\n",
             "X_c_header.csv": "p,q\n", "Y_c_header.csv": "",
             "X_c_alone.csv": "p,q\n5,6\n", "Y_c_only.csv": "1\n",
             "X_c_short.csv": "p,q\n5,6\n7,8\n", "Y_c_short.csv": "1\n"}
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    rows, skipped = io.read_paired_files(spark, os.path.join(d, "X_*.csv"), "p int, q double", os.path.join(d, "Y_*.csv"))
    assert sorted(map(tuple, rows.select("cluster", "row_no", "p", "q", "label").collect())) == [("a b", 0, 1, 2.5, 0), ("a b", 1, 3, 4.5, 1)]
    assert {r["cluster"]: r["reason"] for r in skipped.collect()} == {
        "broken": "features: 1 lines do not fit the schema; no features", "typed": "features: 1 lines do not fit the schema; no features",
        "empty": "features: empty or not readable; no features", "header": "features: no rows; labels: empty or not readable", "alone": "no labels", "only": "no features",
        "short": "2 rows of features, 1 of labels"}


def test_parse_report_text(spark):
    text = ("             precision    recall  f1-score   support\n\n"
            "   Class One       0.50      0.25      0.33        40\n"
            "   Class Two       0.75      0.60      0.67        10\n\n"
            "avg / total       0.55      0.32      0.40        50\n")
    df = io.parse_report_text(spark, spark.createDataFrame([(text,)], "value string"))
    rows = sorted((r["class"], r["precision"], r["support"]) for r in df.collect())
    assert rows == [("Class One", 0.5, 40.0), ("Class Two", 0.75, 10.0)]


def test_usable_groups(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("c", 1)], "g string, label int")
    assert [r[0] for r in io.usable_groups(df, "g").select("g").distinct().collect()] == ["a"]


def test_positional_join(spark):
    a = spark.createDataFrame([(10, "x"), (30, "z"), (20, "y")], "k long, v string")
    b = spark.createDataFrame([(3, 1), (1, 0), (2, 1)], "i long, label int")
    got = sorted((r["v"], r["label"]) for r in cohort.positional_join(a, b, "k", "i").collect())
    assert got == [("x", 0), ("y", 1), ("z", 1)]


def test_model_save_load(spark):
    from wardlens.operators.models import make_estimator, scaled_pipeline
    df = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, label int")
    model = scaled_pipeline(["x"], make_estimator("logistic", maxIter=5)).fit(df)
    p = os.path.join(_tmp(), "m")
    io.save_model(model, p)
    again = io.load_pipeline_model(p)
    assert again.transform(df).count() == 40
