"""Cases in which an operator once did less than the whole job."""

from pyspark.sql import functions as F

from sf_dirs import SF_MID, SF_SMALL
from wardlens.operators import attribution, cluster, cohort, forest, models
from wardlens.operators.features import incidence_vectors, tfidf
from wardlens.operators.models import fit_per_cluster, skipped_column
from wardlens.plans import catalog


def test_fit_per_cluster_has_no_row_floor(spark):
    rows = [("tiny", s, y) for s in ("train", "test") for y in (0, 1)] + [("one", "train", 0), ("one", "train", 1), ("one", "test", 1)] \
        + [("none", "test", 0)] * 30
    df = spark.createDataFrame(rows, "c string, split string, label int")
    out, skipped = fit_per_cluster(df, "c", lambda part: part.agg(F.count(F.lit(1)).alias("n")), test=F.col("split") == "test")
    assert [(r["c"], r["n"]) for r in out.collect()] == [("tiny", 4)]
    assert [c for c, _ in skipped] == ["none", "one"]
    assert skipped[0][1] == "not both classes in the train part and the test part" and skipped[1][1] == "not both classes in the test part"
    assert [tuple(r) for r in spark.range(1).select(skipped_column(skipped).alias("s")).first()["s"]] == skipped
    assert spark.range(1).select(skipped_column([]).alias("s")).first()["s"] == []


def test_every_chapter_is_reported_or_skipped(spark, monkeypatch):
    reports = []
    monkeypatch.setattr(cohort, "metric_summary", lambda rep, *a, f=cohort.metric_summary, **k: (reports.append(rep), f(rep, *a, **k))[1])
    skipped = {r["cluster"] for r in catalog.chapter_model_reports(spark, SF_MID).first()["skipped"]}
    fitted = {r[0] for r in reports[0].select("cluster").distinct().collect()}
    every = {r[0] for r in catalog._stay_chapters(spark, SF_MID).where("cluster IS NOT NULL").select("cluster").distinct().collect()}
    assert len(every) == 17 and fitted | skipped == every and not fitted & skipped


def test_kmodes_fills_an_empty_cluster(spark):
    sets = [["a"]] * 9 + [["b"]] * 9 + [["c"]] * 9 + [["a", "b"], ["b", "c"], ["d", "e", "f"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, cats array<string>")
    for k in (2, 3, 4):
        out, modes, cost, hist = cluster.kmodes(df, "cats", "id", k=k, n_init=4)
        rows = out.collect()
        assert {r["cluster"] for r in rows} == set(range(k)) and sum(r["cost"] for r in rows) == cost
        for run in {h[0] for h in hist}:
            costs = [h[2] for h in hist if h[0] == run]
            assert all(b <= a for a, b in zip(costs, costs[1:])), costs
    assert {r["cluster"] for r in cluster.kmodes(df.where("id < 9"), "cats", "id", k=3, n_init=2)[0].collect()} == {0}


def test_loops_have_the_reference_sizes(spark, monkeypatch):
    asked = {}
    for name in ("kmodes", "som_clusters"):
        monkeypatch.setattr(cluster, name, lambda *a, f=getattr(cluster, name), n=name, **k: (asked.update({n: (a[3:], k)}), f(*a, **k))[1])
    sizes = catalog.kmodes_clusters(spark, SF_SMALL).groupBy("cluster").count().collect()
    assert asked["kmodes"][1] == {"k": 3, "n_init": 100, "max_iter": 100} and len(sizes) == 3
    units = catalog.som_clusters(spark, SF_SMALL).select("unit").distinct().count()
    assert asked["som_clusters"][0] == (30, 30) and units > 100
    assert [r["k"] for r in catalog.kmeans_elbow(spark, SF_SMALL).orderBy("k").collect()] == list(range(1, 11))
    row = catalog.svd_singular_values(spark, SF_SMALL).first()
    s = row["singular_values"]
    assert len(row["svd"]) == len(s) == 50 and s == sorted(s, reverse=True) and s[0] == row["top_singular_value"] and 0.5 < row["explained_ratio"] <= 1


def test_searches_have_the_reference_sizes(spark, monkeypatch):
    asked = {}
    small = {"staged_search": lambda df, make, stages, fold, **k: (None, df.select(fold).distinct()),
             "grid_search": lambda df, est, *a, **k: (asked.update(max_iter=est.getMaxIter()), df, None)}
    monkeypatch.setattr(models, "staged_search", lambda df, make, stages, fold: (asked.update(stages=stages), small["staged_search"](df, make, stages, fold))[1])
    monkeypatch.setattr(models, "grid_search", small["grid_search"])
    assert catalog.staged_search_progress(spark, SF_SMALL).count() == 5
    assert [len(list(v)) for stage in asked["stages"] for v in stage.values()] == [20, 9, 9, 5, 9, 9]
    catalog.grid_search_results(spark, SF_SMALL)
    assert asked["max_iter"] == 100
    monkeypatch.setattr(forest, "fit_forest", lambda df, f, trees, *a, **k: (asked.update(trees=trees), trees)[1])
    monkeypatch.setattr(forest, "importance_blocks", lambda df, model, per_run: (asked.update(runs=model // per_run), df)[1])
    monkeypatch.setattr(cohort, "importance_stats", lambda runs: runs)
    catalog.importance_stability(spark, SF_SMALL)
    assert asked["trees"] == 10_000 and asked["runs"] == 500
    monkeypatch.setattr(attribution, "sampled_shapley", lambda *a, **k: (asked.update(k), a[1])[1])
    catalog.sampled_shapley(spark, SF_SMALL)
    assert asked["n_perm"] * 2 * len(catalog.FEATURES) >= 2 * len(catalog.FEATURES) + 2048


def test_every_stage_and_refit_runs(spark):
    stages = [{k: list(v)[:2] if k != "maxIter" else [2, 3] for k, v in s.items()} for s in catalog.SEARCH_STAGES]
    prog = catalog.staged_search_progress(spark, SF_SMALL, stages=stages, folds=2).orderBy("stage").collect()
    assert len(prog) == 4 and all(p in prog[-1]["params"] for s in stages for p in s)
    stable = catalog.importance_stability(spark, SF_SMALL, refits=5).collect()
    assert len(stable) == len(catalog.FEATURES) and sum(r["times_in_top"] for r in stable) == 5 * 7


def test_no_item_is_dropped_from_the_vocabulary(spark):
    df = spark.range(270_000).select(F.array(F.col("id").cast("string")).alias("items"))
    assert len(incidence_vectors(df, "items")[1]) == 270_000
    assert tfidf(df.limit(5), "items").count() == 5
