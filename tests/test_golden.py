"""
of three k-modes clusters, read as files, summarised to mean and upper median.

Fixed values: the three published per-cluster reports and their published
mean and median rows.
"""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wardlens.operators import cohort
from wardlens.sources import io

REPORTS = {
    "kmodes 0": [("Not Readmitted", 0.87, 0.95, 0.81, 1976.0), ("    Readmitted", 0.33, 0.23, 0.57, 200.0)],
    "kmodes 1": [("Not Readmitted", 0.82, 0.94, 0.73, 3468.0), ("    Readmitted", 0.32, 0.22, 0.63, 410.0)],
    "kmodes 2": [("Not Readmitted", 0.69, 0.92, 0.55, 981.0), ("    Readmitted", 0.35, 0.23, 0.73, 181.0)],
}
MEAN = {"Readmitted": (0.3333333333333333, 0.22666666666666668, 0.6433333333333333, 263.6666666666667),
        "Not Readmitted": (0.7933333333333333, 0.9366666666666666, 0.6966666666666667, 2141.6666666666665)}
MEDIAN = {"Readmitted": (0.33, 0.23, 0.63, 200.0), "Not Readmitted": (0.82, 0.94, 0.73, 1976.0)}
METRICS = ["f1_score", "precision", "recall", "support"]


@pytest.fixture(scope="module")
def report_dir():
    d = tempfile.mkdtemp(prefix="wl-golden-")
    for name, rows in REPORTS.items():
        with open(os.path.join(d, f"{name}.csv"), "w") as f:
            f.write("class,f1_score,precision,recall,support\n")
            for r in rows:
                f.write(",".join(str(x) for x in r) + "\n")
    return d


def test_mean_and_upper_median_of_cluster_reports(spark, report_dir):
    schema = "class string, f1_score double, precision double, recall double, support double"
    rep = spark.read.schema(schema).option("header", True).csv(os.path.join(report_dir, "*.csv")) \
        .withColumn("cluster", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.csv$", 1)) \
        .withColumn("class", F.trim("class"))
    assert rep.select("cluster").distinct().count() == 3
    out = cohort.metric_summary(rep, ["class"], METRICS, digits=12).collect()
    got = {(r["class"], r["metric"]): (r["mean"], r["median"]) for r in out}
    for cls in MEAN:
        for i, m in enumerate(METRICS):
            mean, median = got[(cls, m)]
            assert abs(mean - MEAN[cls][i]) < 1e-9, (cls, m)
            assert median == MEDIAN[cls][i], (cls, m)


def test_keyed_reader_pairs_cluster_names(spark, report_dir):
    df = io.read_keyed_files(spark, os.path.join(report_dir, "*.csv"), key_pattern=r"kmodes (\d+)\.csv$")
    assert sorted(r[0] for r in df.select("cluster").distinct().collect()) == ["0", "1", "2"]
