"""Invariants of the iterative and fitted operators (SURVEY section 5 (3))."""

import random

from pyspark.sql import functions as F

from wardlens.operators import attribution, cluster, evaluate, models
from wardlens.operators.features import assemble


def _sets(spark, n=300, seed=3):
    rnd = random.Random(seed)
    cats = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(n):
        base = cats[:4] if i % 3 == 0 else cats[4:8] if i % 3 == 1 else cats[8:]
        s = sorted(set(rnd.sample(base, 3) + ([rnd.choice(cats)] if rnd.random() < 0.3 else [])))
        rows.append((i, s))
    return spark.createDataFrame(rows, "id long, cats array<string>")


def test_kmodes_cost_never_rises(spark):
    df = _sets(spark)
    _, modes, cost, hist = cluster.kmodes(df, "cats", "id", k=3, n_init=2, max_iter=8)
    for run in {h[0] for h in hist}:
        costs = [h[2] for h in hist if h[0] == run]
        assert all(b <= a for a, b in zip(costs, costs[1:])), costs
    finals = {}
    for run, _, c in hist:
        finals[run] = c
    assert cost == min(finals.values())


def test_kmodes_assignment_is_nearest(spark):
    df = _sets(spark)
    modes = [["c0", "c1", "c2"], ["c4", "c5", "c6"], ["c8", "c9", "c10"]]
    rows = cluster.kmodes_assign(df, "cats", modes).collect()
    for r in rows:
        d = [len(set(r["cats"])) + len(m) - 2 * len(set(r["cats"]) & set(m)) for m in modes]
        assert r["cost"] == min(d) and r["cluster"] == d.index(min(d))


def test_nearest_centre_is_nearest(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    centres = [[0.0] * 4, [1.0] * 4, [0.5] * 4]
    for r in cluster.nearest_centre(df, "v", centres).collect():
        d = [sum((a - b) ** 2 for a, b in zip(r["v"], c)) for c in centres]
        assert r["cluster"] == d.index(min(d)) and abs(r["dist"] - min(d)) < 1e-9


def _separable(spark, n=400):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((i, y, rnd.gauss(2.0 * y, 0.7), rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "id long, label int, x1 double, x2 double")


def test_auc_above_half_on_separable_set_and_same_seed(spark):
    df = _separable(spark)
    fit = lambda d: models.scaled_pipeline(["x1", "x2"], models.make_estimator("gbt", maxIter=5)).fit(d)
    p1 = models.score_column(fit(df).transform(df), "gbt")
    p2 = models.score_column(fit(df).transform(df), "gbt")
    a1 = evaluate.roc_auc(p1).first()["auc"]
    assert a1 > 0.8
    assert a1 == evaluate.roc_auc(p2).first()["auc"]
    # rank formula equals the trapezoid area
    assert abs(a1 - evaluate.roc_auc_trapezoid(p1).first()["auc"]) < 1e-9


def test_out_of_fold_covers_every_row(spark):
    from wardlens.operators.ordered import ntile_folds
    df = ntile_folds(_separable(spark), "id", 4, ["label"])
    fit = lambda d: models.scaled_pipeline(["x1", "x2"], models.make_estimator("logistic")).fit(d)
    pooled = models.out_of_fold(df, "fold", fit, "logistic", k=4)
    assert pooled.count() == 400 and pooled.select("id").distinct().count() == 400


def test_shapley_linear_exact_sums_to_score_minus_mean(spark):
    df = _separable(spark)
    w = [0.7, -1.3]
    contrib = attribution.linear_contributions(df, ["x1", "x2"], w)
    got = {r["feature"]: r["mean_abs"] for r in contrib.collect()}
    m = df.agg(F.avg("x1"), F.avg("x2")).first()
    want = df.agg(F.avg(F.abs(0.7 * (F.col("x1") - m[0]))), F.avg(F.abs(-1.3 * (F.col("x2") - m[1])))).first()
    assert abs(got["x1"] - want[0]) < 1e-9 and abs(got["x2"] - want[1]) < 1e-9


def test_sampled_shapley_efficiency(spark):
    """Per row and sample the contributions add up to f(x) - f(background row)."""
    df = _separable(spark, 60)
    pipe = models.make_estimator("logistic", maxIter=20).fit(assemble(df, ["x1", "x2"]))
    bg = [[1.0, 0.0]]
    phi = attribution.sampled_shapley(pipe, df, bg, ["x1", "x2"], "id", n_perm=3)
    assert phi.count() == 2
    # efficiency: sum of mean contributions = mean f(x) - f(z)
    fx = models.score_column(pipe.transform(assemble(df, ["x1", "x2"])), "logistic").agg(F.avg("score")).first()[0]
    z = spark.createDataFrame([(1.0, 0.0)], "x1 double, x2 double")
    fz = models.score_column(pipe.transform(assemble(z, ["x1", "x2"])), "logistic").first()["score"]
    total = phi.agg(F.sum("mean")).first()[0]
    assert abs(total - (fx - fz)) < 1e-9


def test_grid_search_ranks(spark):
    from wardlens.operators.ordered import ntile_folds
    df = assemble(ntile_folds(_separable(spark), "id", 3, ["label"]), ["x1", "x2"])
    est = models.make_estimator("logistic", maxIter=10)
    _, res, rows = models.grid_search(df, est, {"regParam": [0.0, 1.0]}, "fold", parallelism=2)
    r = res.orderBy("rank").collect()
    assert len(r) == 2 and r[0]["mean_score"] >= r[1]["mean_score"] and r[0]["rank"] == 1


def test_som_best_unit_is_nearest_and_map_fits_clusters(spark):
    import numpy as np
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(3.0 * (i % 2), 0.2), rnd.gauss(0.0, 0.2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    w, _ = cluster.som_train(df, "v", "id", 3, 3, rough_epochs=2, finetune_epochs=2)
    got = cluster.som_best_unit(df, "v", w).collect()
    for r in got:
        d = ((w - np.array(r["v"])) ** 2).sum(1)
        assert r["unit"] == int(np.argmin(d))
    labels = cluster.som_clusters(df, "v", "id", 3, 3, k=2, rough_epochs=2, finetune_epochs=2).collect()
    by = {r["id"]: r["cluster"] for r in labels}
    # the two blobs land in different clusters
    assert len({by[i] for i in range(0, 200, 2)}) == 1 and by[0] != by[1]


def test_hot_group_is_split_across_buckets(spark):
    """A group holding a third of all rows is cut into range buckets: running
    sums stay exact and no single window partition holds the whole group."""
    from wardlens.operators.ordered import BUCKET, _with_bucket, running_totals
    n = 30000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 0)
                               .otherwise(F.col("id") % 97 + 1).alias("g"), F.lit(1).alias("v"))
    out = running_totals(df, "k", ["v"], ["g"], n_buckets=16, with_totals=True)
    hot = out.where(F.col("g") == 0)
    assert hot.where(F.col("cum_v") != F.floor(F.col("k") / 3) + 1).count() == 0
    assert hot.select(F.max("tot_v")).first()[0] == n // 3
    sizes = _with_bucket(df.withColumn("kd", F.col("k").cast("double")), "kd", 16) \
        .groupBy("g", BUCKET).count().where(F.col("g") == 0).select(F.max("count")).first()[0]
    assert sizes <= (n // 3) / 8        # the hot group is spread over many window partitions


def test_sampled_shapley_scores_each_step_of_an_order_once(spark):
    df = _separable(spark, 20)
    pipe = models.make_estimator("logistic", maxIter=5).fit(assemble(df, ["x1", "x2"]))

    class Counted:
        rows = 0

        def transform(self, vectors):
            self.rows = vectors.count()
            return pipe.transform(vectors)
    model = Counted()
    assert attribution.sampled_shapley(model, df, [[1.0, 0.0]], ["x1", "x2"], "id", n_perm=3).count() == 2
    assert model.rows == df.count() * 3 * (2 + 1)


def test_model_frame_is_read_from_one_stored_table(spark):
    from sf_dirs import SF_SMALL
    from wardlens.plans import catalog
    df = catalog._model_frame(spark, SF_SMALL)
    assert all("/model_frame-" in f for f in df.inputFiles())
    again = catalog._model_frame(spark, SF_SMALL)
    assert df.exceptAll(again).count() == 0 and df.count() == catalog._stay_features(spark, SF_SMALL).count()


def test_som_passes_sum_whole_batches(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(cluster, "SOM_ROWS", 7)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    w, grid = cluster.som_train(df, "v", "id", 2, 3, rough_epochs=1, finetune_epochs=0)
    start = np.array([r["v"] for r in df.orderBy(cluster.hash_bits("id"), "id").limit(6).collect()])
    best = ((x[:, None] - start) ** 2).sum(2).argmin(1)
    near = np.exp(-((grid[:, None] - grid) ** 2).sum(-1) / (2 * 1.5 ** 2))
    member = (best[:, None] == np.arange(6)).astype(float)
    assert np.allclose(w, near @ member.T @ x / (near @ member.sum(0))[:, None])
    units = {r["id"]: r["unit"] for r in cluster.som_best_unit(df, "v", w).collect()}
    assert [units[i] for i in range(150)] == ((x[:, None] - w) ** 2).sum(2).argmin(1).tolist()


def test_hash_numbers_equal_hash_bits(spark):
    from wardlens.operators.folds import hash_bits, hash_numbers
    keys, salts = ["", "7", "123456", "é" * 4, "x" * 70], ["0", "94:f10", "3:f1"]
    df = spark.createDataFrame([(i, k or None) for i, k in enumerate(keys)], "i int, k string")
    want = [list(r) for r in df.orderBy("i").select(*[hash_bits("k", s).alias(s) for s in salts]).collect()]
    assert hash_numbers([k.encode() for k in keys], [s.encode() for s in salts]).tolist() == want


def test_shapley_of_boosted_trees_makes_no_vectors_and_equals_the_vectors_way(spark):
    from pyspark.ml import PipelineModel
    df = _separable(spark, 50)
    df = df.unionByName(df.limit(7)).withColumn("x3", F.col("x1") * F.col("x2"))   # keys come twice
    names = ["x1", "x2", "x3"]
    fitted = models.scaled_pipeline(names, models.make_estimator("gbt", maxIter=4)).fit(df)
    inner = PipelineModel(stages=fitted.stages[1:])

    class Model:
        calls = 0

        def transform(self, vectors):
            self.calls += 1
            return inner.transform(vectors.withColumnRenamed("features", "_raw"))
    plain, known = Model(), Model()
    known.model = inner
    bg = [[0.0, 0.5, 1.0], [1.0, -1.0, 0.0], [0.3, 0.2, 0.1]]
    want = attribution.sampled_shapley(plain, df, bg, names, "id", n_perm=9, weights=[3, 1, 2]).orderBy("feature").collect()
    got = attribution.sampled_shapley(known, df, bg, names, "id", n_perm=9, weights=[3, 1, 2]).orderBy("feature").collect()
    assert plain.calls == 1 and known.calls == 0
    for a, b in zip(want, got):
        assert a["feature"] == b["feature"] and abs(a["mean"] - b["mean"]) < 1e-12 and abs(a["mean_abs"] - b["mean_abs"]) < 1e-12
    assert any(r["mean_abs"] > 0 for r in got)


def test_rounds_are_prefixes_of_one_fit_a_fold(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from wardlens.operators.ordered import ntile_folds
    df = _separable(spark, 300).withColumn("label", F.when(F.col("id") % 9 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    df = assemble(ntile_folds(df, "id", 2, ["label"]), ["x1", "x2"]).cache()
    est = models.make_estimator("gbt", subsamplingRate=0.7, maxIter=1)
    counts = [2, 3, 5]
    _, _, want = models.grid_search(df, est, {"maxIter": counts}, "fold")
    fits = []
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, d, fit=GBTClassifier._fit: (fits.append(self.getMaxIter()), fit(self, d))[1])
    best, _ = models.staged_search(df, lambda p: est, [{"maxIter": counts}], "fold")
    assert fits == [5, 5] and best in [p for p, _, _ in want]
    got = models.round_search(df, est, counts, "fold")
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[k] - w[k]) < 1e-9 for g, w in zip(got, want) for k in (1, 2))
