"""Weighted k-means for every k at once: (k, centre) is the key, one pass and one aggregate an iteration.

A row is compared with the centres of every k in one pass over the input; tasks add up weight, vector and squared
distance per (k, centre), and Spark merges these sums per (k, centre, dimension).  The driver holds the centres alone
(the sum of all k, times the starts and the width).  Every k is started several times, all starts advance together, and
the one with the least inertia is returned; a start whose centres rest drops out.  Starting centres are drawn as in
k-means++: the next one is the row with the least ``-ln(u) / (weight * squared distance)``, u from a hash of its key
and the start, which is a draw in proportion to weight times squared distance, for all starts by one aggregate; k starts
from the first k of them.

Squared distances come from one matrix product with the centres of all k, taken about their mean; where its rounding could
choose another centre or show in the distance, they are sums of squared differences, so k = 1 loses nothing to
cancellation.  Rows whose vector is null
or holds null or non-finite entries, or whose weight is null or not positive, are left out.  With fewer distinct vectors
than k, the centres that draw no row are dropped, and a centre that loses its rows stays where it was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.operators.mixing import mixed_uniform
from wardlens.session import spread

#: Distances held at once in a task (rows x centres x width).
CELLS = 2_000_000
#: A squared distance from a matrix product stands when its rounding error is below this share of it.
EXACT = 1e-10


@dataclass
class Clusters:
    """``centres[k]`` (centres x width), ``weights[k]`` of the rows of each, ``inertia[k]`` of the last pass."""

    centres: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    inertia: dict[int, float]
    iterations: dict[int, int]


def usable(df: DataFrame, vec_col: str, key_col: str, weight: Column | None = None) -> DataFrame:
    """``key, v array<double>, w`` of the rows that take part."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key_col).alias("key"), v.alias("v"), w.alias("w")).where(whole & (F.col("w") > 0) & (F.col("w") < float("inf")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances (rows x centres) of a few rows at a time."""
    step = max(1, CELLS // max(centres.size, 1))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        yield part, ((x[part, None, :] - centres[None]) ** 2).sum(2)


def _nearest(x: np.ndarray, centres: np.ndarray, product: np.ndarray, x2: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (ties to the first) and its squared distance for each row, from the products (centres x rows) and
    squared lengths of both about a common point."""
    rough = c2[:, None] - 2 * product
    which = rough.argmin(0)
    least = rough[which, np.arange(len(x))]
    # a product of n terms is off by n roundings of the lengths at most
    error = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (x2 + c2.max())
    d = least + x2
    unsure = np.flatnonzero(~(error <= EXACT * d) | ((rough <= least + 2 * error).sum(0) > 1))
    for part, exact in _distances(x[unsure], centres):
        which[unsure[part]], d[unsure[part]] = exact.argmin(1), exact.min(1)
    return which, d


def next_seeds(rows: DataFrame, centres: dict[int, np.ndarray], turn: int, seed: int, width: int) -> dict[int, np.ndarray]:
    """One more starting centre for each start; a start is missing where every row lies on one of its centres."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def race(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w, h = _matrix(batch["v"], width), batch["w"].to_numpy(), batch["h"].to_numpy()
            for run, c in shared.value.items():
                share = w.copy()
                if len(c):
                    for part, d in _distances(x, c):
                        share[part] *= d.min(1)
                u = mixed_uniform(h, run * 65_536 + turn)
                arrival = np.full(len(x), np.inf)
                np.divide(-np.log1p(-u), share, out=arrival, where=share > 0)
                if len(x) and np.isfinite(arrival).any():
                    best = batch.slice(int(np.argmin(arrival)), 1).select(["v"])
                    yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), best["v"], pa.array([arrival.min()])], names=["run", "v", "arrival"])
    drawn = rows.select("v", "w", F.xxhash64(F.col("key"), F.lit(seed)).alias("h")).mapInArrow(race, "run int, v array<double>, arrival double")
    found = drawn.groupBy("run").agg(F.min(F.struct("arrival", "v")).alias("m")).collect()   # one row a start
    return {r["run"]: np.array(r["m"]["v"]) for r in found}


def step_sums(rows: DataFrame, centres: dict[tuple[int, int], np.ndarray], width: int) -> DataFrame:
    """``k, run, centre, dim, total, weight, n, cost`` of one pass for ``centres[k, run]``: sums of the rows nearest to
    each centre (ties to the first), with weight, count and squared distances on dimension 0 alone."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(list(shared.value.values()))
        ends = np.cumsum([len(c) for c in shared.value.values()])
        middle = every.mean(0)
        moved = every - middle
        c2, sums = (moved ** 2).sum(1), np.zeros((len(every), width + 3))
        step = max(1, CELLS // len(every))
        for batch in batches:
            x, w = _matrix(batch["v"], width), batch["w"].to_numpy()
            weighted = np.concatenate([x * w[:, None], w[:, None], np.ones((len(x), 1))], 1)
            for at in range(0, len(x), step):
                xs, ws = x[at:at + step], w[at:at + step]
                near = xs - middle
                x2, product, member = (near ** 2).sum(1), moved @ near.T, np.zeros((len(every), len(near)))
                for end, c in zip(ends, shared.value.values()):
                    own = slice(end - len(c), end)
                    which, d = _nearest(xs, c, product[own], x2, c2[own])
                    member[own.start + which, np.arange(len(near))] = 1.0
                    sums[own, width + 2] += np.bincount(which, ws * d, len(c))
                sums[:, :width + 2] += member @ weighted[at:at + step]
        total = {at: sums[end - len(c):end] for end, (at, c) in zip(ends, shared.value.items())}
        for (k, run), t in total.items():
            rest = np.zeros((len(t), width, 3))
            rest[:, 0] = t[:, width:]
            size = len(t) * width
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(np.full(size, k), pa.int32()), "run": pa.array(np.full(size, run), pa.int32()),
                "centre": pa.array(np.repeat(np.arange(len(t)), width), pa.int32()), "dim": pa.array(np.tile(np.arange(width), len(t)), pa.int32()),
                "total": t[:, :width].ravel(), "weight": rest[:, :, 0].ravel(), "n": rest[:, :, 1].ravel(), "cost": rest[:, :, 2].ravel()})
    cells = rows.select("v", "w").mapInArrow(add, "k int, run int, centre int, dim int, total double, weight double, n double, cost double")
    return cells.groupBy("k", "run", "centre", "dim").agg(*[F.sum(c).alias(c) for c in ("total", "weight", "n", "cost")])


def kmeans_all(df: DataFrame, vec_col: str, key_col: str, ks: Sequence[int], weight: Column | None = None, seed: int = 1,
               max_iter: int = 100, tol: float = 1e-4, starts: int = 10) -> Clusters:
    """Centres, weights and inertia for every k of ``ks``: max(ks) small passes for the seeds, then one an iteration.

    A start rests when no centre moved further than ``tol`` or after ``max_iter`` moves; weights and inertia belong to
    the centres returned, those of the start with the least inertia (ties to the first).  k = 1 has one start."""
    rows = spread(usable(df, vec_col, key_col, weight), "kmeans")
    sizes = [r[0] for r in rows.select(F.size("v")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    out = Clusters({}, {}, {}, {})
    if not sizes:
        return out
    width = sizes[0]
    seeds = {run: np.zeros((0, width)) for run in range(starts)}
    for turn in range(max(ks)):
        found = next_seeds(rows, seeds, turn, seed, width)
        seeds = {run: np.vstack([c, found[run]]) if run in found else c for run, c in seeds.items()}
        if not found:
            break
    centres = {(int(k), run): seeds[run][:k].copy() for k in ks for run in range(starts if k > 1 else 1)}
    active, best = set(centres), {}
    for turn in range(max_iter + 1):
        now = {at: centres[at] for at in sorted(active)}
        total = {at: np.zeros((len(c), width + 2)) for at, c in now.items()}
        cells = step_sums(rows, now, width).toArrow()   # centres x width rows
        c = {n: cells[n].to_numpy() for n in cells.column_names}
        for at, t in total.items():
            own = (c["k"] == at[0]) & (c["run"] == at[1])
            t[c["centre"][own], c["dim"][own]] = c["total"][own]
            np.add.at(t[:, width], c["centre"][own], c["weight"][own])
            t[0, width + 1] = np.sort(c["cost"][own]).sum()
        for at, old in now.items():
            w, cost = total[at][:, width], total[at][0, width + 1]
            new = np.where(w[:, None] > 0, total[at][:, :width] / np.maximum(w[:, None], 1e-300), old)
            if turn == max_iter or np.sqrt(((new - old) ** 2).sum(1)).max() <= tol:
                active.discard(at)
                best[at] = (cost, w, turn)
            else:
                centres[at] = new
        if not active:
            break
    for k in sorted({k for k, _ in centres}):
        run = min((r for q, r in best if q == k), key=lambda r: (best[k, r][0], r))
        out.centres[k], (out.inertia[k], out.weights[k], out.iterations[k]) = centres[k, run], best[k, run]
    return out


def draw_background(clusters: Clusters, k: int, draws: int, seed: int = 1) -> list[int]:
    """``draws`` centre numbers of the k-centre result, drawn in proportion to the weight of their rows."""
    w = clusters.weights[k]
    return np.random.default_rng(seed).choice(len(w), draws, p=w / w.sum()).tolist()
