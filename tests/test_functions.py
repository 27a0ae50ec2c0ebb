"""Column helpers and hierarchy operators on hand-made rows."""

import json

from pyspark.sql import functions as F

from wardlens.functions import columns as C
from wardlens.operators import codes


def test_interval_text(spark):
    df = spark.createDataFrame([("390-459",), ("042",), ("-5",), ("V01-V91",)], "n string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(C.split_interval("n")).collect()]
    assert got == [(390, 459), None, None, (None, None)]
    got_t = [tuple(r[0]) if r[0] else None for r in df.select(C.split_interval("n", True)).collect()]
    assert got_t[0] == (39, 459)


def test_small_helpers(spark):
    df = spark.createDataFrame([("a_b_c", None, 1.7, [1, 2])], "s string, n string, x double, a array<int>")
    r = df.select(C.first_token("s").alias("t"), C.none_text("n").alias("nn"), C.clip("x").alias("c"),
                  C.pad_to_width("a", 4).alias("p"), C.squeeze_blanks(F.lit("  a   b ")).alias("q")).first()
    assert (r["t"], r["nn"], r["c"], r["p"], r["q"]) == ("a", "None", 1.0, [1, 2, 0, 0], "a b")
    assert df.select(C.file_key(F.lit("/x/X_cluster_390-459.csv"))).first()[0] == "390-459"
    assert df.select(C.to_int(F.lit("12x"))).first()[0] is None


def test_linspace(spark):
    g = C.linspace(spark, 100).orderBy("i").collect()
    assert len(g) == 100 and g[0]["x"] == 0.0 and abs(g[-1]["x"] - 1.0) < 1e-12


PATHS = [
    [{"depth": 0, "code": None, "descr": "root"}, {"depth": 1, "code": "390-459", "descr": "Circ"},
     {"depth": 2, "code": "401-405", "descr": "Hyp"}, {"depth": 3, "code": "401", "descr": "Essential"}],
    [{"depth": 0, "code": None, "descr": "root"}, {"depth": 1, "code": "390-459", "descr": "Circ"},
     {"depth": 2, "code": "410-414", "descr": "Isch"}, {"depth": 3, "code": "414", "descr": "Other"}],
    [{"depth": 0, "code": None, "descr": "root"}, {"depth": 1, "code": "E000-E999", "descr": "Ext"}],
]


def test_hierarchy_parents_children_descriptions(spark):
    p = codes.hierarchy_paths(spark, json.dumps(PATHS))
    par = {r["code"]: r["parent"] for r in codes.node_parents(p, 2).collect()}
    assert par["401"] == "401-405" and par["414"] == "410-414"
    assert par["390-459"] == "410-414"          # last path wins
    assert par["E000-E999"] is None             # no depth-2 node on that path
    kids = codes.parent_children(p, 2).where(F.col("parent") == "401-405").count()
    assert kids == 4                             # repeats kept, root included
    d = {r["code"]: r["descr"] for r in codes.node_descriptions(p, 1).collect()}
    assert d == {"390-459": "Circ", "E000-E999": "Ext"}
    iv = [(r["lo"], r["hi"], r["name"]) for r in codes.hierarchy_intervals(p, 2).orderBy("ord").collect()]
    assert iv == [(401, 405, "401-405"), (410, 414, "410-414")]
    iv1 = [(r["lo"], r["hi"]) for r in codes.hierarchy_intervals(p, 1).orderBy("ord").collect()]
    assert iv1 == [(390, 459), (None, None)]     # non-numeric bounds: never matches a code


def test_ids_with_fallback(spark):
    df = spark.createDataFrame([(1, "a"), (2, "zz"), (3, "b"), (4, None)], "k long, v string")
    idm = spark.createDataFrame([("a", 0), ("b", 1)], "v string, id long")
    got = {r["k"]: r["id"] for r in codes.ids_with_fallback(df, "v", idm, "k").collect()}
    assert got == {1: 0, 2: 2, 3: 1, 4: 3}
    first = codes.first_seen_ids(spark.createDataFrame([("x", 5), ("y", 1), ("x", 0)], "v string, o long"), "v", "o")
    assert {r["v"]: r["id"] for r in first.collect()} == {"x": 0, "y": 1}
