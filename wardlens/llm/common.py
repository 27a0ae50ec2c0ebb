"""Shared helpers: inputs, the shared scratch folder, Arrow batches and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.session import ensure_checkpoint_dir

#: Bytes of text that one task works on at a time.
CHUNK_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, unless their PYTHONPATH has it (as ``spark-submit --py-files`` would)."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_wardlens_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="wardlens-"), "wardlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "wardlens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._wardlens_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder (its scheme kept)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = CHUNK_CHARS, size: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``chars`` bytes of text (by the column ``size``, if given), or one row."""
    for batch in batches:
        sizes = pc.fill_null(column(batch, size) if size else pc.binary_length(column(batch, text)), 0)
        ends = np.cumsum(np.asarray(sizes).astype(np.int64))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def packed(texts: pa.Array) -> list[bytes | None]:
    """Each text compressed on its own; its size in bytes is needed to read it."""
    codec = pa.Codec("zstd")
    return [None if t is None else codec.compress(t, asbytes=True) for t in texts.cast(pa.binary()).to_pylist()]


def unpacked(data: pa.Array, sizes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    plain = [None if d is None else codec.decompress(d, n, asbytes=True) for d, n in zip(data.to_pylist(), sizes.to_pylist())]
    return pa.array(plain, pa.binary()).cast(pa.string())


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 mixing step on unsigned 64-bit values."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of the concatenated runs ``[start, start + len)``."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every id of ``edges(a, b)``: ``root`` is the smallest id reachable.

    Alternating star contraction: each node links its larger neighbours, then its smaller ones, to
    the smallest node it sees.  Every round is a shuffle on the node id with partial aggregation and is
    written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    e = stored(edges.where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        e = stored(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(m.select("u", F.col("m").alias("v"))).distinct(), name)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
