"""Shard placement by a hierarchical weighted hash tree (law ``key``).

A tree has regions, racks and shards with weights; an inner node weighs what its shards weigh together.  A key
descends level by level: each child draws ``-ln(u) / weight`` with ``u`` in (0, 1) hashed from the child's path
and the key, and the smallest draw wins.  A draw depends on nothing but the child's own path and weight, so a
changed weight moves keys only into or out of the nodes on its path.  ``grown`` adds a shard as a region of its
own: no older draw changes, and rows move only into the new shard.

Defined cases: a null key is hashed as the empty string; equal keys share a shard whatever their rows hold; null
text has size 1 and the checksum of the empty text; empty input gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import stored

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]
#: Shards of the first layout and its shape; later shards are regions of their own.
BASE_SHARDS, REGIONS, RACKS = 16, 2, 2


def layout(shards: int) -> list[Leaf]:
    """The tree of so many shards of weight 1: the first 16 as 2 regions x 2 racks x 4, each later one grown."""
    if shards < BASE_SHARDS:
        return [(s, 0, s, 1.0) for s in range(shards)]
    per_rack = BASE_SHARDS // (REGIONS * RACKS)
    tree = [(s // (per_rack * RACKS), s // per_rack % RACKS, s, 1.0) for s in range(BASE_SHARDS)]
    for _ in range(BASE_SHARDS, shards):
        tree = grown(tree)
    return tree


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard in a region of its own."""
    region, shard = max(x[0] for x in tree) + 1, max(x[2] for x in tree) + 1
    return [*tree, (region, 0, shard, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    """Exponential draw of rate ``weight``: 52 bits of the MD5 of path and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(path + ":"), key)), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(2.0 ** 52)) / F.lit(float(weight))


def _winner(key: Column, children: dict[int, tuple[str, float]]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*[F.struct(_draw(key, path, w).alias("draw"), F.lit(c).alias("child"))
                                 for c, (path, w) in children.items()]))["child"]


def place(docs: DataFrame, key: str, tree: Sequence[Leaf], prefix: str = "") -> DataFrame:
    """Add ``region``, ``rack`` and ``shard`` of each row's key (shards of weight 0 take nothing)."""
    tree = [x for x in tree if x[3] > 0]
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def nodes(depth: int, inside: tuple) -> dict[int, tuple[str, float]]:
        weights: dict[int, float] = {}
        for leaf in tree:
            if leaf[:depth] == inside:
                weights[leaf[depth]] = weights.get(leaf[depth], 0.0) + leaf[3]
        return {c: ("/".join(map(str, (*inside, c))), w) for c, w in weights.items()}

    region, rack, shard = (prefix + x for x in ("region", "rack", "shard"))
    out = docs.withColumn(region, _winner(text, nodes(0, ())))
    pick = F.lit(None).cast("int")
    for r in nodes(0, ()):
        pick = F.when(F.col(region) == r, _winner(text, nodes(1, (r,)))).otherwise(pick)
    out = out.withColumn(rack, pick)
    pick = F.lit(None).cast("int")
    for r in nodes(0, ()):
        for k in nodes(1, (r,)):
            pick = F.when((F.col(region) == r) & (F.col(rack) == k), _winner(text, nodes(2, (r, k)))).otherwise(pick)
    return out.withColumn(shard, pick)


def with_slots(rows: DataFrame, group: str, slot: str = "slot") -> DataFrame:
    """Number the rows of each group without gaps from 0.

    Rows are numbered within their input split and group, and the splits' counts give the offsets: no group
    meets in one task, however many rows share a key.  ``rows`` is written to the shared folder first.
    """
    cut = stored(rows.withColumn("_split", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "slots")
    here = Window.partitionBy("_split", group).orderBy("_at")
    before = Window.partitionBy(group).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_split", group).agg(F.count(F.lit(1)).alias("_n")) \
        .select("_split", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return cut.withColumn("_rank", F.row_number().over(here)).join(offsets, ["_split", group]) \
        .withColumn(slot, F.col("_before") + F.col("_rank") - 1).drop("_split", "_at", "_before", "_rank")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(place(rows, "doc_id", layout(shards)), "doc_id", layout(shards + 1), "grown_")
    return with_slots(rows.drop("grown_region", "grown_rack"), "shard") \
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
