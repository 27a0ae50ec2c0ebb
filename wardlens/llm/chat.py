"""Chat formatting after collapsing cumulative snapshots (DataFrame functions only).

Logs often hold a conversation again and again as it grows.  Each turn carries a rolling hash of all turns up
to it (two sums of 64-bit hashes of position, role and text), so a conversation that is a proper prefix of a
longer one is found by an anti-join of its last hash against all hashes before a last turn, and equal
conversations by their last hash.  Positions and sums run over range partitions with offsets between them, so
a conversation with very many turns is spread over tasks.  What is kept is rendered in blocks of at most
``BLOCK_TURNS`` turns.

Defined cases: null role or text is the empty string; a null turn number comes first; rows equal in conversation,
turn, role and text count once; turns with one number are ordered by role and text; rows without a conversation id
form one conversation; the smallest id (null first) stands for equal conversations; empty input gives no row;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import stored

BLOCK_TURNS = 256


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, key, role, text, position, last, p1, p2`` of every distinct turn."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = turns.select("conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"), "turn",
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    order = ["key", "turn", "role", "text"]
    cut = stored(flat.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turns")
    here = Window.partitionBy("key", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    # one row per conversation and range partition that it touches
    counts = cut.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")) \
        .select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("last"))
    placed = cut.withColumn("local", F.count(F.lit(1)).over(here)).join(counts, ["key", "part"]) \
        .withColumn("position", F.col("skip") + F.col("local"))
    hashed = placed.select("*", *[F.xxhash64(F.lit(s), "position", "role", "text").cast("decimal(20,0)").alias(f"h{s}") for s in (1, 2)])
    hashed = stored(hashed.select("conv_id", "key", "role", "text", "part", "at", "position", "last", "h1", "h2"), "turn-hashes")
    sums = hashed.groupBy("key", "part").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2")) \
        .select("key", "part", *[F.coalesce(F.sum(f"s{s}").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"b{s}") for s in (1, 2)])
    return hashed.select("*", *[F.sum(f"h{s}").over(here).cast("decimal(38,0)").alias(f"c{s}") for s in (1, 2)]) \
        .join(sums, ["key", "part"]) \
        .select("conv_id", "key", "role", "text", "position", "last",
                *[(F.col(f"b{s}") + F.col(f"c{s}")).cast("decimal(38,0)").alias(f"p{s}") for s in (1, 2)])


def maximal(hashes: DataFrame) -> DataFrame:
    """``(key, copies)`` of conversations that no longer one begins with, one for each set of equal ones."""
    at = ["position", "p1", "p2"]
    ends = hashes.where("position = last").groupBy(*at) \
        .agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id", "key"))["key"].alias("key"), F.count(F.lit(1)).alias("copies"))
    inner = hashes.where("position < last").select(*at).distinct()
    return ends.join(inner, at, "left_anti").select("key", "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, block, n_turns, copies, rendered``: maximal conversations as chat markup."""
    hashes = stored(prefix_hashes(turns), "prefixes")
    kept = hashes.join(maximal(hashes), "key") \
        .select("conv_id", "key", "copies", "last", "position", F.floor((F.col("position") - 1) / BLOCK_TURNS).cast("long").alias("block"),
                render(F.col("role"), F.col("text")).alias("markup"))
    return kept.groupBy("key", "conv_id", "block", "last", "copies") \
        .agg(F.array_sort(F.collect_list(F.struct("position", "markup"))).alias("turns")) \
        .select("conv_id", "block", F.col("last").alias("n_turns"), "copies",
                F.array_join(F.transform("turns", lambda t: t["markup"]), "").alias("rendered"))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
m AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE len(b.l) > len(m.l) AND b.l[1:len(m.l)] = m.l)),
p AS (SELECT conv_id, copies, len(l) AS n, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM k)
SELECT conv_id, ((i - 1) // {BLOCK_TURNS})::BIGINT AS block, n::BIGINT AS n_turns, copies::BIGINT AS copies,
  string_agg('<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM p GROUP BY conv_id, copies, n, block
"""
