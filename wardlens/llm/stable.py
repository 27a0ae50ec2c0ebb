"""Embedding near-duplicates: p-stable hashing of normalised vectors, then exact cosine checks.

A table hashes a unit vector by ``k`` quantised projections ``floor((a . v + b) / WIDTH)`` with normal ``a`` and
uniform ``b``; vectors whose ``k`` numbers agree (as a 32-bit mix) share its bucket.  ``k`` rises with the logarithm
of the number of distinct vectors, so that a bucket holds about ``STRAY`` unrelated ones at every size, and there are
enough tables for a pair right at the threshold to meet with probability ``RECALL`` (closer pairs meet almost surely).

Equal vectors are one class with a count.  In a bucket all pairs are checked by their cosine in double precision.  A
pair is counted in the first table in which it meets, so nothing but a count and a forest of links for each
class leaves a task: pairs are never written.  Buckets beyond ``CELL`` classes are cut into chunks and every pair of
chunks is a unit of work of its own; blocks of pairs that all met in an earlier table are passed over.

Defined cases: vectors that are null, empty, zero or hold null or non-finite entries link with nothing; vectors of
different lengths do not link; ``-0.0`` is ``0.0``; rows without vec_id are vectors like others, name no component and are
never kept; repeated rows and repeated ids are vectors of their own; a vector without links is its own component;
empty input gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import column, components, rows, splitmix, stored

COSINE = 0.9
#: Width of a quantised projection, for unit vectors.
WIDTH = 2.5
#: Unrelated classes expected in a bucket; chance that a pair at the threshold meets in some table.
STRAY = 32
RECALL = 0.995
#: Classes of a bucket that are compared in one piece; rows of a block of cosines.
CELL = 2048
BLOCK = 512
#: Bytes of buckets that a task holds.
HELD_BYTES = 8_000_000
SEED = 20_011

_DESCRIBED = pa.schema([("vec_id", pa.int64()), ("cls", pa.binary()), ("vector", pa.binary())])
_SIGNED = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("vector", pa.binary()), ("keys", pa.binary())])
_FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def meets(cosine: float) -> float:
    """Chance that one quantised projection of two unit vectors agrees."""
    c = math.sqrt(max(2 - 2 * cosine, 1e-12))
    r = WIDTH / c
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections in a table and number of tables for ``n`` distinct vectors."""
    k = max(4, math.ceil(math.log(max(1.0, n / STRAY)) / -math.log(meets(0.0))))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meets(cosine) ** k)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest entry first (no overflow)."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def bucket_keys(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The bucket of every row in every table: ``(rows, tables)``, 32 bits."""
    width = units.shape[1]
    rng = np.random.default_rng([SEED, width])
    out = np.empty((len(units), tables), np.int32)
    for t in range(tables):
        place = np.floor((units @ rng.standard_normal((width, k)) + rng.uniform(0, WIDTH, k)) / WIDTH).astype(np.int64)
        mix = np.full(len(units), (t << 20) ^ width, np.uint64)
        for j in range(k):
            mix = splitmix(mix ^ place[:, j].astype(np.uint64))
        out[:, t] = (mix & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return out


def _vectors(payload: pa.Array, width: int) -> np.ndarray:
    """Rows of the binary payloads: a tag byte (4: single, 8: double precision) and the entries."""
    held = payload.to_pylist()
    kind = np.float32 if held[0][0] == 4 else np.float64
    return np.frombuffer(b"".join(h[1:] for h in held), kind).reshape(len(held), -1) if width else np.zeros((len(held), 0))


def describe(vectors: DataFrame) -> DataFrame:
    """``vec_id, cls, vector``: the vector's bytes and their 128-bit hash, null where it cannot link."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    single = kind == "float"
    plain = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>"))
    tag, numpy_kind = (b"\x04", np.float32) if single else (b"\x08", np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "embedding")
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            flat = lists.flatten()
            values = np.asarray(pc.fill_null(flat, float("nan"))).astype(numpy_kind) + numpy_kind(0)
            ends = np.cumsum(size)
            out = []
            for a, b in zip((ends - size).tolist(), ends.tolist()):
                v = values[a:b]
                out.append(tag + v.tobytes() if b > a and np.isfinite(v).all() and v.any() else None)
            yield rows(_DESCRIBED, column(batch, "vec_id"), [v and hashlib.md5(v).digest() for v in out], out)
    return plain.mapInArrow(run, "vec_id long, cls binary, vector binary")


def _links(units: np.ndarray, keys: np.ndarray, counts: np.ndarray, chunk: np.ndarray, apart: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row counted here, and the row's place in a forest of them.

    ``keys`` are the rows' buckets in the earlier tables; with ``apart`` only rows of different chunks are compared."""
    n = len(units)
    found, label = np.zeros(n, np.int64), np.arange(n)
    if apart:
        low = np.flatnonzero(chunk == chunk.min())
        sides = (low, np.flatnonzero(chunk != chunk.min()))
    else:
        sides = (np.arange(n), np.arange(n))
    # rows that met before come together, so that their blocks can be passed over
    sides = [s[np.lexsort(keys[s].T[::-1])] if keys.shape[1] else s for s in sides]
    for i in range(0, len(sides[0]), BLOCK):
        a = sides[0][i:i + BLOCK]
        for j in range(0 if apart else i, len(sides[1]), BLOCK):
            b = sides[1][j:j + BLOCK]
            ka, kb = keys[a], keys[b]
            if len(ka.T) and ((ka == ka[0]).all(0) & (kb == ka[0]).all(0)).any():
                continue
            near = units[a] @ units[b].T >= cosine
            if not apart and i == j:
                near &= np.arange(len(a))[:, None] < np.arange(len(b))
            x, y = np.nonzero(near)
            fresh = np.ones(len(x), bool)
            for t in range(keys.shape[1]):  # a pair is counted where it meets first
                fresh &= ka[x, t] != kb[y, t]
            x, y = a[x[fresh]], b[y[fresh]]
            if not len(x):
                continue
            found += np.bincount(x, counts[y], n).astype(np.int64) + np.bincount(y, counts[x], n).astype(np.int64)
            while True:
                p, q = label[x], label[y]
                differ = p != q
                if not differ.any():
                    break
                x, y = x[differ], y[differ]
                high, low = np.maximum(p, q)[differ], np.minimum(p, q)[differ]
                np.minimum.at(label, high, low)
                while (label[label] != label).any():
                    label = label[label]
    return found, label


def near_links(placed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(a, b, n)`` from the placed classes: class ``a`` has ``n`` links in this unit of work, and is joined to ``b``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def units_of_work(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gid = column(whole, "gid").to_numpy()
            end = len(gid) if last else int(np.searchsorted(gid, gid[-1]))
            out_a, out_b, out_n = [], [], []
            cuts = np.append(np.flatnonzero(np.diff(gid[:end], prepend=gid[0] - 1 if end else 0)), end)
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s < 2:
                    continue
                part = whole.slice(s, e - s)
                size = pc.binary_length(column(part, "vector")).to_numpy()
                for w in np.unique(size).tolist():  # a mix of 32 bits may bring lengths together
                    same = part.take(pa.array(np.flatnonzero(size == w))) if (size != w).any() else part
                    if same.num_rows < 2:
                        continue
                    earlier = np.frombuffer(b"".join(column(same, "earlier").to_pylist()), np.int32).reshape(same.num_rows, -1)
                    apart = column(same, "apart")[0].as_py()
                    chunk = column(same, "chunk").to_numpy()
                    if apart and (chunk == chunk[0]).all():
                        continue
                    found, label = _links(unit(_vectors(column(same, "vector"), w)), earlier, column(same, "n").to_numpy(), chunk, apart, cosine)
                    rows_in = np.flatnonzero(found)
                    cls = column(same, "cls")
                    out_a += cls.take(pa.array(rows_in)).to_pylist()
                    out_b += cls.take(pa.array(label[rows_in])).to_pylist()
                    out_n.append(found[rows_in])
            made = rows(_FOUND, out_a, out_b, np.concatenate(out_n)) if out_a else None
            return made, [whole.slice(end)] if end < len(gid) else []

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                made, held = units_of_work(held, False)
                if made:
                    yield made
        if held:
            made, _ = units_of_work(held, True)
            if made:
                yield made

    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "gid").sortWithinPartitions("gid").mapInArrow(run, "a binary, b binary, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``."""
    described = stored(describe(vectors), "vectors")
    classes = described.where(F.col("cls").isNotNull()).groupBy("cls") \
        .agg(F.count(F.lit(1)).alias("n"), F.min("vector").alias("vector"))
    classes = stored(classes, "classes")
    k, tables = plan(classes.count(), cosine, recall)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(column(batch, "vector")).to_numpy()
            for w in np.unique(size).tolist():
                part = batch.take(pa.array(np.flatnonzero(size == w)))
                keys = bucket_keys(unit(_vectors(column(part, "vector"), w)), k, tables)
                yield rows(_SIGNED, column(part, "cls"), column(part, "n"), column(part, "vector"), [row.tobytes() for row in keys])

    # the buckets are written once: a task that runs again cannot hash a vector otherwise
    signed = stored(classes.mapInArrow(sign, "cls binary, n long, vector binary, keys binary"), "signed")
    table, key = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"), F.substring("keys", 4 * F.col("t") + 1, F.lit(4)).alias("key")
    large = stored(signed.select("keys", table).select("t", key).groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"))
                   .where(F.col("size") > CELL).select("t", "key", F.ceil(F.col("size") / CELL).cast("int").alias("parts")), "large")
    chunk = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(chunk, o).alias("i"), F.greatest(chunk, o).alias("j")))
    spread = signed.select("cls", "n", "vector", "keys", table) \
        .select("cls", "n", "vector", "t", key, F.substring("keys", F.lit(1), 4 * F.col("t")).alias("earlier"))
    # `large` is read from files: Spark knows its size and sends it to all tasks only below its threshold
    placed = spread.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))) \
        .select("cls", "n", "vector", "t", "key", "earlier", chunk.alias("chunk"), F.explode(cells).alias("cell")) \
        .select(F.xxhash64("t", "key", "cell").alias("gid"), "cls", "n", "vector", "earlier", "chunk",
                (F.col("cell.i") != F.col("cell.j")).alias("apart"))
    found = stored(near_links(placed, cosine), "links")
    linked = components(found.select("a", "b"), "groups").select(F.col("id").alias("cls"), "root")
    counts = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cls")
    known = stored(classes.select("cls", "n").join(counts, "cls", "left").join(linked, "cls", "left")
                   .select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "known")
    rooted = described.where(F.col("cls").isNotNull()).select("vec_id", "cls").join(known, "cls").select("vec_id", "n_links", "root")
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    alone = described.where(F.col("cls").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rooted.join(least, "root").select("vec_id", "n_links", "component_id").unionByName(alone) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
