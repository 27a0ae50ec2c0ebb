"""Clustering: nearest-centre assignment, k-modes on category sets, k-means.

State that the iterations carry (centres, modes) is bounded by ``k x width``
and travels as literals in the plan, like Spark ML's broadcast centres; the
rows never leave the executors.  Each iteration is a fresh plan over the same
checkpointed input, so lineage does not grow with the iteration count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.operators.folds import HASH_MOD, hash_bits
from wardlens.session import ensure_checkpoint_dir

MAX_K = 10_000


def _sq_dist(vec: Column, centre: Sequence[float]) -> Column:
    c = F.array(*[F.lit(float(x)) for x in centre])
    return F.aggregate(F.zip_with(vec, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                       F.lit(0.0), lambda acc, x: acc + x)


def group_centres(df: DataFrame, vec_col: str, group_col: str) -> tuple[list, list[list[float]]]:
    """Mean vector per group, collected (bounded: groups x width).  Returns (ids, centres)."""
    n = df.select(group_col).distinct().count()
    if n > MAX_K:
        raise ValueError(f"{n} groups: too many centres")
    long = df.select(group_col, F.posexplode(vec_col).alias("pos", "v"))
    means = long.groupBy(group_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    rows = means.groupBy(group_col).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c")).collect()
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], [[x["m"] for x in r["c"]] for r in rows]


def nearest_centre(df: DataFrame, vec_col: str, centres: Sequence[Sequence[float]], ids: Sequence | None = None,
                   out: str = "cluster", dist: str = "dist") -> DataFrame:
    """Assign every row to its nearest centre (squared Euclidean; ties to the first)."""
    ids = list(ids) if ids is not None else list(range(len(centres)))
    dists = F.array(*[_sq_dist(F.col(vec_col), c) for c in centres])
    best = F.array_position(dists, F.array_min(dists))
    return df.withColumn("_d", dists).withColumn(out, F.element_at(F.array(*[F.lit(i) for i in ids]), best.cast("int"))) \
        .withColumn(dist, F.array_min("_d")).drop("_d")


# ---------------------------------------------------------------- k-modes on sets
def set_mismatch(x: Column, mode: Sequence[str]) -> Column:
    """Mismatches between two 0/1 incidence rows given as sets: |x| + |m| - 2|x n m|."""
    m = F.array(*[F.lit(v) for v in mode]).cast("array<string>")
    return F.size(x) + F.lit(len(mode)) - 2 * F.size(F.array_intersect(x, m))


def kmodes_assign(df: DataFrame, set_col: str, modes: Sequence[Sequence[str]], out: str = "cluster",
                  cost: str = "cost") -> DataFrame:
    """Nearest mode per row by set mismatch; ties go to the lowest cluster index."""
    costs = F.array(*[set_mismatch(F.col(set_col), m) for m in modes])
    best = F.array_position(costs, F.array_min(costs)) - 1
    return df.withColumn("_c", costs).withColumn(out, best.cast("int")).withColumn(cost, F.array_min("_c")).drop("_c")


def kmodes_update(assigned: DataFrame, set_col: str, cluster_col: str = "cluster") -> DataFrame:
    """New modes in long form: an item is in the mode of a cluster when more than
    half of its rows hold it (a tie means absent).  ``(cluster, item, n, size)``."""
    sizes = assigned.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    items = assigned.select(cluster_col, F.explode(F.array_distinct(set_col)).alias("item")) \
        .groupBy(cluster_col, "item").agg(F.count(F.lit(1)).alias("n"))
    return items.join(sizes, cluster_col, "inner").where(2 * F.col("n") > F.col("size"))


def _modes_from_long(long: DataFrame, k: int, cluster_col: str = "cluster") -> list[list[str]]:
    rows = long.groupBy(cluster_col).agg(F.sort_array(F.collect_list("item")).alias("m")).collect()
    by = {r[0]: list(r["m"]) for r in rows}
    return [by.get(i, []) for i in range(k)]


def initial_modes(df: DataFrame, set_col: str, key: str, k: int, run: int = 0) -> list[list[str]]:
    """``k`` distinct sets, first in a run-salted hash order of their first key."""
    h = hash_bits(key, run)
    firsts = df.groupBy(set_col).agg(F.min(h).alias("_h"))
    return [list(r[0]) for r in firsts.orderBy("_h").limit(k).collect()]


def _run_hash(key: str, run: Column) -> Column:
    return hash_bits(key, run)


def initial_modes_all_runs(base: DataFrame, set_col: str, key: str, k: int, n_init: int,
                           oversample: int = 50) -> dict[int, list[list[str]]]:
    """Seed modes of every run at once: per run the ``k`` distinct sets that come
    first in that run's hash order (as ``initial_modes``).

    Hash values are close to uniform, so the first ``k`` of ``n`` sets lie below
    ``MOD * oversample * k / n`` with overwhelming probability; only sets under
    that cut are ranked (a few hundred per run).  A run with fewer than ``k``
    survivors falls back to its own exact pass.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))).alias("run")
    per = base.select(key, set_col, runs).groupBy("run", set_col).agg(F.min(_run_hash(key, F.col("run"))).alias("_h"))
    n = base.select(set_col).distinct().count()
    cut = min(HASH_MOD, int(HASH_MOD * oversample * k / max(n, 1)) + 1)
    from pyspark.sql import Window
    w = Window.partitionBy("run").orderBy("_h", set_col)
    top = per.where(F.col("_h") < cut).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k) \
        .select("run", "_r", set_col).collect()   # at most n_init * k rows
    seeds: dict[int, list] = {r: [] for r in range(n_init)}
    for row in sorted(top, key=lambda r: (r["run"], r["_r"])):
        seeds[row["run"]].append(list(row[set_col]))
    for r in range(n_init):
        if len(seeds[r]) < min(k, n):
            seeds[r] = initial_modes(base, set_col, key, k, r)
        seeds[r] += [[] for _ in range(k - len(seeds[r]))]
    return seeds


def _modes_literal(modes_by_run: dict[int, list[list[str]]]) -> Column:
    """map<run, array<array<string>>> literal (bounded: runs x k x items)."""
    parts = []
    for r, modes in modes_by_run.items():
        parts += [F.lit(r), F.array(*[F.array(*[F.lit(v) for v in m]).cast("array<string>") for m in modes])]
    return F.create_map(*parts)


def _kmodes_pass(sets: DataFrame, set_col: str, modes_by_run: dict[int, list[list[str]]], k: int) -> DataFrame:
    """One pass over distinct sets with counts ``n``: ``(run, cluster, item, n, cost)``, rows
    that hold the item per run and cluster; the row without an item has the cluster's size and cost."""
    runs = sorted(modes_by_run)
    flat = [set(m) for r in runs for m in modes_by_run[r]]

    def step(batches):
        import numpy as np
        import pandas as pd
        run_of, cluster_of = np.repeat(np.array(runs, dtype="int32"), k), np.tile(np.arange(k, dtype="int32"), len(runs))
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = [list(v) for v in pdf[set_col].iloc[lo:lo + 2048]]
                n = pdf["n"].iloc[lo:lo + 2048].to_numpy().astype(float)
                names = sorted({v for row in part for v in row})
                at = {v: i for i, v in enumerate(names)}
                x = np.zeros((len(part), len(names)))
                for i, row in enumerate(part):
                    x[i, [at[v] for v in row]] = 1
                m = np.zeros((len(flat), len(names)))
                for j, mode in enumerate(flat):
                    m[j, [at[v] for v in mode if v in at]] = 1
                cost = x.sum(1)[:, None] + np.array([len(mode) for mode in flat])[None, :] - 2 * x @ m.T
                cost = cost.reshape(len(part), len(runs), k)
                held = np.zeros(cost.shape)   # the count of each set at its nearest mode, ties to the first
                np.put_along_axis(held, cost.argmin(2)[:, :, None], n[:, None, None], 2)
                size, total = held.sum(0).ravel(), (held * cost).sum(0).ravel()
                counts = held.reshape(len(part), -1).T @ x
                c, i = np.nonzero(counts)
                some = np.nonzero(size)[0]
                yield pd.DataFrame({"run": run_of[np.r_[some, c]], "cluster": cluster_of[np.r_[some, c]],
                                    "item": [None] * len(some) + [names[j] for j in i],
                                    "n": np.r_[size[some], counts[c, i]].astype("int64"),
                                    "cost": np.r_[total[some], np.zeros(len(c))].astype("int64")})
    return sets.mapInPandas(step, "run int, cluster int, item string, n long, cost long") \
        .groupBy("run", "cluster", "item").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))


def _farthest_sets(sets: DataFrame, set_col: str, modes_by_run: dict[int, list[list[str]]]) -> dict[int, list[str]]:
    """Per run the set with the largest mismatch to its nearest mode, where that is above 0."""
    x = sets.select(set_col, F.explode(F.array(*[F.lit(r) for r in modes_by_run])).alias("run"))
    costs = F.transform(F.element_at(_modes_literal(modes_by_run), F.col("run")),
                        lambda m: F.size(set_col) + F.size(m) - 2 * F.size(F.array_intersect(F.col(set_col), m)))
    far = x.groupBy("run").agg(F.max(F.struct(F.array_min(costs).alias("cost"), F.col(set_col).alias("s"))).alias("far")).collect()
    return {r["run"]: list(r["far"]["s"]) for r in far if r["far"]["cost"] > 0}


def kmodes(df: DataFrame, set_col: str, key: str, k: int = 3, n_init: int = 100, max_iter: int = 100):
    """K-modes with set dissimilarity and ``n_init`` hash-seeded restarts, all
    restarts advanced together: each iteration is one pass over the distinct sets with
    their counts (assignment against every active run's modes and one aggregate of
    per-(run, cluster, item) counts for the new modes).  The mode of a cluster without
    rows is reseeded by the set farthest from its nearest mode, one a run and iteration.
    A run stops when its modes were had before; the run with the fewest empty clusters,
    then the lowest total mismatch, wins.  Returns (assigned frame, modes,
    cost, history) where history lists (run, iteration, cost)."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(key, F.array_sort(F.array_distinct(set_col)).alias(set_col)).checkpoint(eager=True)   # reliable checkpoint, shared folder
    sets = base.where(F.col(set_col).isNotNull()).groupBy(set_col) \
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key)).checkpoint(eager=True)
    modes = initial_modes_all_runs(sets, set_col, key, k, n_init)
    active = sorted(modes)
    history, best, seen = [], {}, {r: set() for r in modes}
    for it in range(max_iter):
        if not active:
            break
        tot = _kmodes_pass(sets, set_col, {r: modes[r] for r in active}, k).persist(StorageLevel.MEMORY_AND_DISK)
        size, cost = {}, dict.fromkeys(active, 0)
        for row in tot.where(F.col("item").isNull()).collect():   # runs x k rows
            size[row["run"], row["cluster"]] = row["n"]
            cost[row["run"]] += row["cost"]
        new = {r: [[] for _ in range(k)] for r in active}
        if size:
            of = F.create_map(*[F.lit(v) for (r, c), n in size.items() for v in (r * k + c, n)])
            keep = tot.where(F.col("item").isNotNull() & (2 * F.col("n") > F.element_at(of, F.col("run") * k + F.col("cluster")))) \
                .groupBy("run", "cluster").agg(F.sort_array(F.collect_list("item")).alias("m")).collect()  # runs x k rows
            for row in keep:
                new[row["run"]][row["cluster"]] = list(row["m"])
        tot.unpersist()
        empty = {r: [c for c in range(k) if (r, c) not in size] for r in active}
        for r in active:
            history.append((r, it, cost[r]))
            seen[r].add(tuple(map(tuple, modes[r])))
            best[r] = min(best.get(r, (k + 1, 0, 0, [])), (len(empty[r]), cost[r], it, modes[r]))
            for c in empty[r]:   # a mode without rows stays until it is reseeded
                new[r][c] = modes[r][c]
        lacking = {r: new[r] for r in active if empty[r]}
        for r, s in (_farthest_sets(sets, set_col, lacking) if lacking else {}).items():
            new[r][empty[r][0]] = s
        active = [r for r in active if tuple(map(tuple, new[r])) not in seen[r]]
        modes |= {r: new[r] for r in active}
    run = min(best, key=lambda r: (*best[r][:2], r))
    # the modes the winning run's recorded cost was measured with
    return kmodes_assign(base, set_col, best[run][3]), best[run][3], best[run][1], history


# ---------------------------------------------------------------- k-means
def kmeans_fit(df: DataFrame, vec_col: str, k: int, seed: int = 1, max_iter: int = 20):
    from pyspark.ml.clustering import KMeans
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=vec_col, predictionCol="cluster").fit(df)


def cluster_sizes(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))


def background_summary(df: DataFrame, vec_col: str, k: int = 10, seed: int = 1) -> DataFrame:
    """k-means centres with their member counts: a weighted background sample."""
    model = kmeans_fit(df, vec_col, k, seed)
    sizes = cluster_sizes(model.transform(df)).collect()
    n = {r[0]: r[1] for r in sizes}
    rows = [(i, [float(v) for v in c], int(n.get(i, 0))) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cluster int, centre array<double>, n long")


# ---------------------------------------------------------------- self-organising map
#: Rows compared with the map at once.
SOM_ROWS = 1000


def _grid_coords(rows: int, cols: int):
    import numpy as np
    return np.array([(r, c) for r in range(rows) for c in range(cols)], dtype=float)


def _best_units(vectors, code):
    """Some rows at a time: their matrix and the nearest unit of each (ties to the first)."""
    import numpy as np
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, code.shape[1]))
    c2, twice = (code ** 2).sum(1), -2 * code.T
    for at in range(0, len(x), SOM_ROWS):
        part = x[at:at + SOM_ROWS]
        d = part @ twice
        d += c2
        yield part, d.argmin(1)


def som_train(df: DataFrame, vec_col: str, key: str, rows: int = 30, cols: int = 30,
              rough_epochs: int = 2, finetune_epochs: int = 2, sigma_rough: tuple = (None, None),
              sigma_fine: tuple = (None, 1.0)):
    """Batch self-organising map on a rectangular grid with a Gaussian neighbourhood.

    Each epoch is one distributed pass: the best unit of every row is found in
    ``mapInArrow`` (numpy on Arrow batches) against the broadcast codebook, and
    per-unit counts and sums come back through a ``groupBy`` on the unit.  Only
    the codebook (units x width, bounded) lives on the driver, where the
    neighbourhood-weighted update ``W = (H S) / (H N)`` is applied.  The codebook
    starts from the first rows in hash order.  Returns (codebook ndarray, grid coords).
    """
    import numpy as np
    import pyarrow as pa
    spark = df.sparkSession
    width = len(df.select(vec_col).first()[0])
    units = rows * cols
    h = hash_bits(key)
    init = [r[0] for r in df.orderBy(h, key).select(vec_col).limit(units).collect()]
    while len(init) < units:
        init.append(init[len(init) % max(len(init), 1)] if init else [0.0] * width)
    w = np.array(init, dtype=float)
    grid = _grid_coords(rows, cols)
    gd2 = ((grid[:, None, :] - grid[None, :, :]) ** 2).sum(-1)
    big = max(rows, cols) / 2.0
    schedule = []
    s0, s1 = sigma_rough[0] or big, sigma_rough[1] or max(big / 4, 1.0)
    schedule += list(np.linspace(s0, s1, rough_epochs)) if rough_epochs else []
    f0, f1 = sigma_fine[0] or s1, sigma_fine[1] or 1.0
    schedule += list(np.linspace(f0, f1, finetune_epochs)) if finetune_epochs else []
    out_schema = "unit int, n long, " + ", ".join(f"s{i} double" for i in range(width))
    for sigma in schedule:
        bw = spark.sparkContext.broadcast(w)

        def partial_sums(batches, bw=bw):
            acc_n = np.zeros(len(bw.value), dtype="int64")
            acc_s = np.zeros_like(bw.value)
            for batch in batches:
                for x, best in _best_units(batch[vec_col], bw.value):
                    acc_n += np.bincount(best, minlength=len(acc_n))
                    np.add.at(acc_s, best, x)
            hit = np.nonzero(acc_n)[0]
            if len(hit):
                yield pa.RecordBatch.from_pydict({"unit": hit.astype("int32"), "n": acc_n[hit]} | {f"s{i}": acc_s[hit, i] for i in range(width)})
        part = df.select(vec_col).mapInArrow(partial_sums, out_schema)
        tot = part.groupBy("unit").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
        n = np.zeros(units)
        s = np.zeros((units, width))
        for r in tot.collect():   # at most one row per unit
            n[r["unit"]] = r["n"]
            s[r["unit"]] = [r[f"s{i}"] for i in range(width)]
        hmat = np.exp(-gd2 / (2 * sigma * sigma))
        num, den = hmat @ s, hmat @ n
        upd = den > 1e-12
        w[upd] = num[upd] / den[upd][:, None]
        bw.unpersist()
    return w, grid


def som_best_unit(df: DataFrame, vec_col: str, codebook, out: str = "unit") -> DataFrame:
    """Best-matching unit per row (``mapInArrow`` against the broadcast codebook)."""
    import numpy as np
    import pyarrow as pa
    spark = df.sparkSession
    bw = spark.sparkContext.broadcast(np.asarray(codebook, dtype=float))
    from pyspark.sql.types import IntegerType, StructType
    schema = StructType(list(df.schema.fields)).add(out, IntegerType())

    def best(batches):
        for batch in batches:
            found = [unit for _, unit in _best_units(batch[vec_col], bw.value)]
            units = np.concatenate([np.zeros(0, "int64"), *found]).astype("int32")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units)], names=[*batch.schema.names, out])
    return df.mapInArrow(best, schema)


def som_clusters(df: DataFrame, vec_col: str, key: str, rows: int = 30, cols: int = 30, k: int = 3,
                 seed: int = 1, **train_args) -> DataFrame:
    """Train the map, cluster its units with k-means, label each row by the cluster
    of its best unit: ``(key, unit, cluster)``."""
    from pyspark.ml.linalg import Vectors
    spark = df.sparkSession
    w, _ = som_train(df, vec_col, key, rows, cols, **train_args)
    units = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(w)], ["unit", "features"])
    labels = kmeans_fit(units, "features", k, seed).transform(units).select("unit", "cluster")
    bmu = som_best_unit(df.select(key, vec_col), vec_col, w)
    return bmu.join(F.broadcast(labels), "unit").select(key, "unit", "cluster")   # units: rows x cols, bounded
