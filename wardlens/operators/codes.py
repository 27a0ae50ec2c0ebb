"""Diagnosis-code operators: dictionary lookup, category sets, code hierarchy,
interval (range) assignment and the stay -> hierarchy-cluster profile.

Scale notes
* The dictionary and the hierarchy are reference data of fixed size (a code
  system), never grown by the stay tables.  They are broadcast only after a
  row-count check (``bounded_broadcast``); beyond the bound the join stays a
  shuffle join.
* The range join is resolved once per distinct 3-digit prefix (at most 1000
  values) and then applied to the big side as a broadcast *equi*-join, so the
  per-row cost is one hash probe instead of a nested-loop scan of intervals.
* "First row per stay" is an aggregate (``min``) with map-side partial
  aggregation, not a window: a stay holding a third of all rows is still
  combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.columns import code_prefix3, node_at_depth, split_interval

NODE = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("code", T.StringType()),
                     T.StructField("descr", T.StringType())])
PATHS = T.ArrayType(T.ArrayType(NODE))

# A reference table larger than this is joined by shuffle instead of broadcast.
MAX_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is within ``max_rows`` (counted each
    time, so a rewritten file is seen); otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


# ---------------------------------------------------------------- hierarchy
def hierarchy_paths(spark: SparkSession, json_text: str | None = None, text_df: DataFrame | None = None) -> DataFrame:
    """Root-to-leaf paths as rows ``(path_idx, path)`` from a JSON list of paths.

    Give either the JSON text or a one-column (``value``) DataFrame holding it,
    e.g. ``spark.read.text(p, wholetext=True)``.
    """
    if text_df is None:
        text_df = spark.createDataFrame([(json_text,)], "value string")
    parsed = text_df.select(F.from_json("value", PATHS).alias("paths"))
    return parsed.select(F.posexplode("paths").alias("path_idx", "path"))


def node_parents(paths: DataFrame, depth: int) -> DataFrame:
    """Each node code -> its ancestor at ``depth`` (null when the path has none).

    A code met on several paths keeps the parent of the last path.
    """
    nodes = paths.select("path_idx", node_at_depth("path", depth).alias("parent"),
                         F.posexplode("path").alias("pos", "node"))
    nodes = nodes.select("path_idx", "pos", F.col("node.code").alias("code"), "parent")
    return nodes.groupBy("code").agg(
        F.max_by("parent", F.struct("path_idx", "pos")).alias("parent"))


def parent_children(paths: DataFrame, depth: int) -> DataFrame:
    """Ancestor -> child rows (long form, repeats kept, in path order)."""
    nodes = paths.select("path_idx", node_at_depth("path", depth).alias("parent"),
                         F.posexplode("path").alias("pos", "node"))
    return nodes.select("parent", F.col("node.code").alias("code"), "path_idx", "pos")


def node_descriptions(paths: DataFrame, depth: int | None = None) -> DataFrame:
    """Code -> description, last seen wins."""
    nodes = paths.select("path_idx", F.posexplode("path").alias("pos", "node"))
    if depth is not None:
        nodes = nodes.where(F.col("node.depth") == depth)
    return nodes.where(F.col("node.code").isNotNull()).groupBy(F.col("node.code").alias("code")).agg(
        F.max_by(F.col("node.descr"), F.struct("path_idx", "pos")).alias("descr"))


def hierarchy_intervals(paths: DataFrame, depth: int, truncated_start: bool = False) -> DataFrame:
    """Intervals ``(ord, lo, hi, name)`` from the ancestors at ``depth``, in the order
    they first appear; names without a numeric ``lo-hi`` form give no interval."""
    anc = paths.select("path_idx", node_at_depth("path", depth).alias("name")).where(F.col("name").isNotNull())
    first = anc.groupBy("name").agg(F.min("path_idx").alias("ord"))
    iv = first.select("ord", "name", split_interval("name", truncated_start).alias("iv"))
    return iv.where(F.col("iv").isNotNull()).select(
        "ord", F.col("iv.lo").alias("lo"), F.col("iv.hi").alias("hi"), "name")


def intervals_from_names(spark: SparkSession, names: list[str], truncated_start: bool = False) -> DataFrame:
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")
    iv = df.select("ord", "name", split_interval("name", truncated_start).alias("iv")).where(F.col("iv").isNotNull())
    return iv.select("ord", F.col("iv.lo").alias("lo"), F.col("iv.hi").alias("hi"), "name")


def first_interval_lookup(keys: DataFrame, key_col: str, intervals: DataFrame,
                          bin_width: int = 100) -> DataFrame:
    """For each distinct integer key, the name of the first interval (by ``ord``)
    with ``lo <= key <= hi``; keys in no interval are absent.

    Range join as an equi-join on bins: each interval is exploded over the bins
    of width ``bin_width`` it touches, keys probe their own bin.
    """
    binned = intervals.where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi"))) \
        .select("ord", "lo", "hi", "name",
                F.explode(F.sequence(F.floor(F.col("lo") / bin_width), F.floor(F.col("hi") / bin_width))).alias("_bin"))
    k = keys.select(F.col(key_col).alias("_key")).where(F.col("_key").isNotNull()).distinct() \
        .withColumn("_bin", F.floor(F.col("_key") / bin_width))
    hit = k.join(bounded_broadcast(binned), "_bin", "inner").where(F.col("_key").between(F.col("lo"), F.col("hi")))
    return hit.groupBy("_key").agg(F.min_by("name", "ord").alias("name")).withColumnRenamed("_key", key_col)


def code3_lookup(spark: SparkSession, intervals: DataFrame, bin_width: int = 100) -> DataFrame:
    """``(code3, cluster)`` for every 3-digit prefix 0..999: at most 1000 rows."""
    domain = spark.range(1000).select(F.col("id").cast("int").alias("code3"))
    return first_interval_lookup(domain, "code3", intervals, bin_width).withColumnRenamed("name", "cluster")


def code3_lookup_local(spark: SparkSession, intervals: DataFrame) -> DataFrame:
    """The prefix lookup as a local relation: at most 1000 rows by construction, so
    it is collected and then broadcast without further jobs."""
    rows = [(int(r["code3"]), r["cluster"]) for r in code3_lookup(spark, intervals).collect()]
    return spark.createDataFrame(rows, "code3 int, cluster string")


def assign_code_cluster(spark: SparkSession, df: DataFrame, code_col: str, intervals: DataFrame,
                        out: str = "cluster") -> DataFrame:
    """Left-join each row's 3-digit prefix to its interval name (null: E/V, bad code, gap)."""
    lookup = code3_lookup_local(spark, intervals)   # bounded by the 3-digit domain
    return df.withColumn("code3", code_prefix3(code_col)) \
        .join(F.broadcast(lookup), "code3", "left").drop("code3").withColumnRenamed("cluster", out)


# ---------------------------------------------------------------- diagnoses
def primary_diagnosis(diag: DataFrame, key: str = "hadm_id", seq_col: str = "seq_num",
                      code_col: str = "icd9_code", seq_value: int = 1) -> DataFrame:
    """One primary code per stay: rows with ``seq == seq_value``; repeats resolved
    to the smallest code.  Filter pushes into the scan; ``min`` combines map-side."""
    return diag.where(F.col(seq_col) == seq_value).groupBy(key).agg(F.min(code_col).alias(code_col))


def dictionary_last_wins(dictionary: DataFrame, code_col: str = "icd9_code", value_col: str = "category",
                         order_col: str = "line_no") -> DataFrame:
    """Reduce a code dictionary to one value per code: the last line wins."""
    return dictionary.groupBy(code_col).agg(F.max_by(value_col, order_col).alias(value_col))


def category_sets(diag: DataFrame, dictionary: DataFrame, key: str = "hadm_id",
                  code_col: str = "icd9_code", value_col: str = "category") -> DataFrame:
    """Stay -> sorted distinct categories of its codes; codes missing from the
    dictionary are skipped (inner join).  The set size is bounded by the number
    of categories, and ``collect_set`` deduplicates map-side."""
    d = bounded_broadcast(dictionary_last_wins(dictionary, code_col, value_col))
    j = diag.select(key, code_col).join(d, code_col, "inner")
    return j.groupBy(key).agg(F.sort_array(F.collect_set(value_col)).alias("categories"))


def code_lists(diag: DataFrame, key: str = "hadm_id", code_col: str = "icd9_code",
               seq_col: str = "seq_num") -> DataFrame:
    """Stay -> its distinct codes, sorted (the per-stay code list, bounded by the code system)."""
    return diag.groupBy(key).agg(F.sort_array(F.collect_set(code_col)).alias("codes"))


def ordered_blocks(df: DataFrame, key: str, order_col: str, value_col: str, size: int = 1000) -> DataFrame:
    """The values of every key in the order of ``order_col`` (unique numbers), repeats kept, as arrays of at most
    ``size`` values: ``key, block, values``.  A key with a third of all rows is many blocks, never one array."""
    from wardlens.operators.ordered import row_numbers
    numbered = row_numbers(df.select(key, order_col, value_col), order_col, [key], name="_at")
    block = F.floor((F.col("_at") - 1) / size).cast("long")
    ordered = F.sort_array(F.collect_list(F.struct("_at", value_col)))
    return numbered.groupBy(key, block.alias("block")).agg(F.transform(ordered, lambda s: s[value_col]).alias("values"))


def prefix_flags(diag: DataFrame, prefixes: DataFrame, names: list[str], key: str = "hadm_id", code_col: str = "icd9_code") -> DataFrame:
    """One row per key and a 0 / 1 column for each category in ``names``: whether one of its codes has the category by
    its longest matching prefix.  Distinct codes are looked up, then joined back."""
    found = prefix_categories(diag.select(code_col).where(F.col(code_col).isNotNull()).distinct(), code_col, prefixes)
    j = diag.select(key, code_col).join(found, code_col, "left")
    return j.groupBy(key).agg(*[F.max(F.coalesce((F.col("category") == n).cast("int"), F.lit(0))).alias(n) for n in names])


def attach_codes(stays: DataFrame, lists: DataFrame, key: str = "hadm_id", col: str = "codes") -> DataFrame:
    """Left lookup: stays without codes get an empty list."""
    return stays.join(lists, key, "left").withColumn(
        col, F.coalesce(F.col(col), F.array().cast(T.ArrayType(T.StringType()))))


def prefix_categories(codes: DataFrame, code_col: str, prefixes: DataFrame, prefix_col: str = "prefix",
                      value_col: str = "category") -> DataFrame:
    """Code table joined by prefix: the longest matching prefix wins.

    Each code is expanded into its prefixes, so the theta
    join ``code LIKE prefix || '%'`` becomes an equi-join.
    """
    p = bounded_broadcast(prefixes.select(F.col(prefix_col).alias("_p"), F.col(value_col).alias("_v")))
    expanded = codes.select("*", F.explode(F.sequence(F.lit(1), F.length(code_col)))
                            .alias("_len")).withColumn("_p", F.expr(f"substr({code_col}, 1, _len)"))
    hit = expanded.join(p, "_p", "inner")
    return hit.groupBy(code_col).agg(F.max_by("_v", "_len").alias(value_col))


# ---------------------------------------------------------------- flagship
def stay_clusters(spark: SparkSession, stays: DataFrame, diag: DataFrame, intervals: DataFrame,
                  key: str = "hadm_id") -> DataFrame:
    """Stays that have a primary diagnosis, with the hierarchy cluster of that code."""
    prim = primary_diagnosis(diag, key)
    clustered = assign_code_cluster(spark, prim, "icd9_code", intervals)
    return stays.join(clustered, key, "inner")


def cluster_profile(df: DataFrame, cluster_col: str = "cluster", label_col: str = "label",
                    digits: int = 6) -> DataFrame:
    """Per cluster (null kept): stays, positives, positive rate, share of stays and
    of positives.  The share windows run over the aggregated rows (one per cluster)."""
    g = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n_stays"),
                                    F.sum(label_col).cast("long").alias("n_pos"))
    w = Window.partitionBy()
    return g.select(
        cluster_col, "n_stays", "n_pos",
        F.round(F.col("n_pos") / F.col("n_stays"), digits).alias("pos_rate"),
        F.round(F.col("n_stays") / F.sum("n_stays").over(w), digits).alias("share_stays"),
        F.round(F.try_divide(F.col("n_pos"), F.sum("n_pos").over(w)), digits).alias("share_pos"))


def cluster_cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b): e.g. k-modes cluster against hierarchy cluster."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def first_seen_ids(df: DataFrame, value_col: str, order_col: str, name: str = "id",
                   n_buckets: int | None = None) -> DataFrame:
    """Dense 0-based id per distinct value in order of first appearance
    (``n_buckets=1`` for a small fixed table such as a code hierarchy)."""
    from wardlens.operators.ordered import row_numbers
    first = df.groupBy(value_col).agg(F.min(order_col).alias("_first"))
    return row_numbers(first, "_first", name="_rn", n_buckets=n_buckets).select(value_col, (F.col("_rn") - 1).alias(name))


def ids_with_fallback(df: DataFrame, value_col: str, id_map: DataFrame, order_col: str,
                      name: str = "id", partition_cols=(), base: int | None = None) -> DataFrame:
    """Map values through ``id_map`` (value, id); an unmapped value gets the next
    free id, counting upward in row order within each partition (a fresh id per
    unmapped row, starting at ``base`` = number of mapped ids by default)."""
    from wardlens.operators.ordered import row_numbers
    if base is None:
        max_id = id_map.agg(F.max("id")).first()[0]
        base = 0 if max_id is None else int(max_id) + 1
    j = df.join(id_map.withColumnRenamed("id", "_id"), value_col, "left")
    missing = row_numbers(j.where(F.col("_id").isNull()), order_col, list(partition_cols), name="_rn") \
        .withColumn("_id", F.lit(base) + F.col("_rn") - 1).drop("_rn")
    return j.where(F.col("_id").isNotNull()).unionByName(missing).withColumnRenamed("_id", name)
