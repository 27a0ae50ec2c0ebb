"""Sparse matrices in long form ``(row, col, value)``: tf-idf and a truncated SVD without dense rows.

The SVD is a randomised range finder with subspace iterations.  With few columns (``FEW`` numbers in the iterate of ``l =
k + oversample`` numbers a column) the matrix is stored as one sparse row a record, and a step is one pass over it: a task
multiplies its rows with the iterate, which it has whole, and adds up the products of the result with itself and with its
rows.  With more columns a product with the matrix is a join on one index and a sum on the other, with partial sums before
each shuffle; the iterate is a table, and the driver sees ``l x l`` sums alone, whatever the number of rows or columns.
Both forms take the same steps.  The start of a column is drawn from its hash, so it does not follow the partitioning.
Each iterate is written or on the driver, so that a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.operators.codes import bounded_broadcast
from wardlens.operators.mixing import mixed_uniform
from wardlens.session import spread, tmp_output_dir

#: Directions below this share of the largest are noise of a Gram matrix in double precision.
FLOOR = 1e-13
#: Above this ratio of the smallest to the largest eigenvalue of a Gram matrix one of them makes columns orthonormal.
SOUND = 1e-4
#: Numbers of an iterate that every task may hold.
FEW = 100_000
#: Entries that a task multiplies at once.
ENTRIES = 200_000


def tfidf_long(df: DataFrame, key: str, array_col: str) -> DataFrame:
    """``key, item, weight``: count times ``ln((1 + n) / (1 + df)) + 1``, each row scaled to length one.  ``n`` counts
    all rows, also those with a null or empty array (they have no entry); null items are no items."""
    n = df.count()
    items = df.select(key, F.explode(array_col).alias("item")).where("item IS NOT NULL")
    known = items.distinct().groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    # rows meet by their key once: counts and lengths need no further shuffle
    tf = items.where(F.col(key).isNotNull()).repartition(key).groupBy(key, "item").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(bounded_broadcast(known), "item").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "item", (F.col("w") / norm).alias("weight"))


def _names(l: int) -> list[str]:
    return [f"v{i}" for i in range(l)]


def _apply(factor: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``factor (id, v0, ...)`` times a small matrix."""
    shared, width = factor.sparkSession.sparkContext.broadcast(matrix), matrix.shape[1]
    kind = factor.schema["id"].dataType.simpleString()
    old = [c for c in factor.columns if c != "id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.stack([batch[c].to_numpy() for c in old], 1) @ shared.value
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(y[:, i].copy()) for i in range(width)]], names=["id", *_names(width)])
    return factor.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in _names(width)))


def _gram(factor: DataFrame) -> np.ndarray:
    """Sums of products of the columns: each task adds up its rows, the driver sees ``l x l`` numbers."""
    names = [c for c in factor.columns if c != "id"]
    l = len(names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((l, l))
        for batch in batches:
            y = np.stack([batch[c].to_numpy() for c in names], 1)
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(l * l), pa.int32()), "s": total.ravel()})
    cells = factor.drop("id").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(l * l)
    out[cells["at"].to_numpy()] = cells["s"].to_numpy()
    return out.reshape(l, l)


def _stored(df: DataFrame) -> DataFrame:
    path = tmp_output_dir(df.sparkSession, "svd")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _directions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above the noise, largest first, and their vectors."""
    values, vectors = np.linalg.eigh(gram)
    keep = np.flatnonzero(values > FLOOR * max(values[-1], 0.0))[::-1] if values[-1] > 0 else np.zeros(0, int)
    return values[keep], vectors[:, keep]


def _orthonormal(factor: DataFrame) -> DataFrame:
    """The same column space with orthonormal columns (not written); twice where one Gram matrix loses many digits."""
    values, vectors = _directions(_gram(factor))
    first = vectors / np.sqrt(values)
    if not len(values):
        return factor.select("id")
    if values[-1] > SOUND * values[0]:
        return _apply(factor, first)
    values, vectors = _directions(_gram(_apply(factor, first)))
    return _apply(factor, first @ (vectors / np.sqrt(values)))


def _times(triples: DataFrame, factor: DataFrame, on: str, to: str) -> DataFrame:
    """Matrix (``to`` x ``on``) times factor (``on`` x l): a join and a sum."""
    names = [c for c in factor.columns if c != "id"]
    joined = triples.join(factor.withColumnRenamed("id", on), on)
    return _stored(joined.groupBy(F.col(to).alias("id")).agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names]))


def _products(batch: pa.RecordBatch, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time: which rows, their products with ``right``, and the columns and scaled results of their entries."""
    ends = np.cumsum(np.diff(batch["cols"].offsets.to_numpy()))
    cols, values = batch["cols"].flatten().to_numpy(), batch["vals"].flatten().to_numpy()
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + ENTRIES, side="right")))
        c, v = cols[base:ends[stop - 1]], values[base:ends[stop - 1], None]
        at = np.concatenate([[0], ends[start:stop - 1] - base])
        y = np.add.reduceat(v * right[c], at)
        yield slice(start, stop), y, c, v * np.repeat(y, np.diff(np.append(at, len(c))), axis=0)
        start = stop


def _step(packed: DataFrame, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With y = matrix x right: the Gram matrix of y, and the transposed matrix times y; one pass."""
    shared, l, small = packed.sparkSession.sparkContext.broadcast(right), right.shape[1], right.size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, back = np.zeros((l, l)), np.zeros(right.shape)
        for batch in batches:
            for _, y, c, entries in _products(batch, shared.value):
                gram += y.T @ y
                order = np.argsort(c, kind="stable")
                found, first = np.unique(c[order], return_index=True)
                back[found] += np.add.reduceat(entries[order], first)
        both = np.concatenate([back.ravel(), gram.ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(both)), pa.int32()), "s": both})
    cells = packed.select("cols", "vals").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()   # FEW numbers
    out = np.zeros(small + l * l)
    out[cells["at"].to_numpy()] = cells["s"].to_numpy()
    return out[small:].reshape(l, l), out[:small].reshape(right.shape)


def _project(packed: DataFrame, right: np.ndarray) -> DataFrame:
    """``id, v0, ...``: matrix times ``right``."""
    shared, names = packed.sparkSession.sparkContext.broadcast(right), _names(right.shape[1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, y, _, _ in _products(batch, shared.value):
                yield pa.RecordBatch.from_arrays([batch["row"].slice(part.start, part.stop - part.start), *[pa.array(y[:, i].copy()) for i in range(len(names))]], names=["id", *names])
    return packed.mapInArrow(run, f"id {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def _few_columns(triples: DataFrame, start: DataFrame, k: int, max_iter: int, tol: float) -> tuple[np.ndarray, DataFrame]:
    """The steps of ``sparse_svd`` with the iterate on the driver; ``start`` is the first one."""
    first = start.orderBy("id").toArrow()   # FEW numbers
    right = np.stack([first[c].to_numpy() for c in first.column_names[1:]], 1)
    place = start.sparkSession.createDataFrame([(c, i) for i, c in enumerate(first["id"].to_pylist())], f"col {start.schema['id'].dataType.simpleString()}, c int")
    # a row has each column once, so a record is no longer than the iterate
    packed = spread(triples.join(F.broadcast(place), "col").repartition("row").groupBy("row", "c").agg(F.sum("value").alias("value"))
                    .groupBy("row").agg(F.collect_list(F.struct("c", "value")).alias("e")).select("row", F.col("e.c").alias("cols"), F.col("e.value").alias("vals")), "svd")
    before = np.zeros(0)
    for _ in range(max_iter):
        gram, back = _step(packed, right)
        values, vectors = _directions(gram)
        if not len(values):
            return np.zeros(0), packed.select(F.col("row").alias("id")).limit(0)
        basis, turn = right @ (vectors / np.sqrt(values)), vectors / np.sqrt(values)
        if values[-1] <= SOUND * values[0]:
            gram, back = _step(packed, basis)
            values, vectors = _directions(gram)
            turn = vectors / np.sqrt(values)
            basis = basis @ turn
        back = back @ turn      # matrix x basis is orthonormal, this is the transposed matrix times it
        values, vectors = _directions(back.T @ back)
        s = np.sqrt(values)[:k]
        if len(s) == len(before) and np.abs(s - before).max() <= tol * s[0]:
            break
        before, right = s, back @ (vectors / np.sqrt(values))
    return s, _project(packed, basis @ (vectors[:, :len(s)] * s))


def sparse_svd(triples: DataFrame, k: int, oversample: int = 20, max_iter: int = 30, tol: float = 1e-9, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` largest singular values (fewer where the rank is lower) of ``triples(row, col, value)``, and ``id, v0,
    ...``: the rows times the right singular vectors.

    Repeated (row, col) entries add up; a null, NaN or infinite value, or a null index, leaves its entry out, and a row
    without entries does not appear.  The iterations end when no wanted value changes by more than ``tol`` of the
    largest.  Each takes two products, so a flat spectrum is better met by a larger ``oversample``."""
    rows = triples.select("row", "col", F.col("value").cast("double").alias("value")).where(
        "row IS NOT NULL AND col IS NOT NULL AND value IS NOT NULL AND abs(value) < double('inf') AND value <> 0")
    rows = _stored(rows)
    l = k + oversample
    kind = rows.schema["col"].dataType.simpleString()

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch["h"].to_numpy()
            parts = [pa.array(np.sqrt(-2 * np.log1p(-mixed_uniform(h, 2 * i))) * np.cos(2 * np.pi * mixed_uniform(h, 2 * i + 1))) for i in range(l)]
            yield pa.RecordBatch.from_arrays([batch["id"], *parts], names=["id", *_names(l)])
    columns = rows.select(F.col("col").alias("id")).distinct().select("id", F.xxhash64("id", F.lit(seed)).alias("h"))
    right = _stored(columns.mapInArrow(start, f"id {kind}, " + ", ".join(f"{n} double" for n in _names(l))))
    if right.count() * l <= FEW:
        return _few_columns(rows, right, k, max_iter, tol)
    before = np.zeros(0)
    for _ in range(max_iter):
        left = _orthonormal(_times(rows, right, "col", "row"))
        if left.columns == ["id"]:
            return np.zeros(0), left.limit(0)
        right = _times(rows, left, "row", "col")    # the matrix, transposed, times an orthonormal factor
        values, vectors = _directions(_gram(right))
        s = np.sqrt(values)[:k]
        if len(s) == len(before) and np.abs(s - before).max() <= tol * s[0]:
            break
        before, right = s, _apply(right, vectors / np.sqrt(values))
    # left (orthonormal) x rotation x s: the rows times the right singular vectors
    return s, _apply(left, vectors[:, :len(s)] * s)
