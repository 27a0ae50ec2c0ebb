"""Readers and writers.

Tables are read with an explicit schema where one is known (no inference pass),
written as Parquet (columnar, typed, arrays kept as arrays) and split by value
with ``partitionBy`` so later readers prune partitions instead of opening one
file per cluster.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.columns import QUOTE_BLANKS, file_key, squeeze_blanks, trim_chars


# ---------------------------------------------------------------- scans
def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "csv", header: bool = True) -> DataFrame:
    """A table with a header row.  Give ``schema`` to skip inference (the default
    for production); without it CSV types are inferred."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", header).option("mode", "PERMISSIVE")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    elif schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_headerless(spark: SparkSession, path: str, names: Sequence[str], types: Sequence[str] | None = None,
                    skip_header: bool = False) -> DataFrame:
    """CSV without a header (or with one to skip) and the column names given."""
    types = types or ["string"] * len(names)
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
    return spark.read.schema(schema).option("header", skip_header).csv(path)


def _file_name(path: str) -> Column:
    """A file's decoded path as ``file``; local ones with one slash, however Spark wrote them."""
    return F.regexp_replace(F.url_decode(F.col(path)), "^file:/+", "file:/").alias("file")


def numbered_lines(spark: SparkSession, path: str | Sequence[str], blanks: bool = True) -> DataFrame:
    """``file, line_no, value`` of every physical line of text files, numbered from 0 in each file (``blanks=False``:
    blank lines neither come nor count).

    A file is read in blocks: each counts its lines, and the counts of the blocks before it, a few numbers a file, are
    its offset.  Files that cannot be read are left out."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(path).select(
        _file_name("_metadata.file_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), "value")
    if not blanks:
        lines = lines.where(F.trim("value") != "")
    block = Window.partitionBy("file", "_block")
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n")) \
        .select("file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return lines.withColumn("_in", F.row_number().over(block.orderBy("_at"))).join(offsets, ["file", "_block"]) \
        .select("file", (F.col("_offset") + F.col("_in") - 1).alias("line_no"), "value")


def read_skipping_lines(spark: SparkSession, path: str, skip: Sequence[int] = (0, 2),
                        strip: str = QUOTE_BLANKS) -> DataFrame:
    """CSV whose listed physical lines are junk; the first kept line is the header.

    Header names and every value are stripped of quotes and blanks.  Of several files each has its own junk and header;
    names come from the first one.
    """
    lines = numbered_lines(spark, path).where(~F.col("line_no").isin(list(skip)))
    at = next(i for i in itertools.count() if i not in set(skip))
    first = lines.where(F.col("line_no") == at).orderBy("file").first()
    header = [h.strip(strip) for h in _split_csv_line(first["value"])]
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    parsed = lines.where(F.col("line_no") > at).select("line_no", F.from_csv("value", schema).alias("r"))
    return parsed.select("line_no", *[trim_chars(F.col(f"r.c{i}"), strip).alias(h) for i, h in enumerate(header)])


def _split_csv_line(line: str) -> list[str]:
    import csv
    return next(csv.reader([line]))


def drop_index_columns(df: DataFrame, names: Sequence[str] = ("", "_c0", "Unnamed: 0", "index")) -> DataFrame:
    """Drop saved row-index columns; we never write an index."""
    return df.drop(*[c for c in df.columns if c in names])


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """A whole JSON document per file as a ``value`` column (for a nested tree)."""
    return spark.read.text(path, wholetext=True)


def read_keyed_files(spark: SparkSession, glob: str, key_pattern: str = r"_([^_/]+)\.[A-Za-z]+$",
                     key_col: str = "cluster", fmt: str = "csv", exclude: Sequence[str] = ()) -> DataFrame:
    """One read of many files; the key embedded in each file name becomes a column.
    Files whose name is listed in ``exclude`` (e.g. summary files) are left out."""
    # file names arrive URL-encoded (a blank is %20): decode before matching
    df = spark.read.format(fmt).option("header", True).load(glob) \
        .withColumn("_file", F.url_decode(F.col("_metadata.file_name")))
    if exclude:
        df = df.where(~F.col("_file").isin(list(exclude)))
    return df.withColumn(key_col, file_key("_file", key_pattern)).drop("_file")


def read_whole_files(spark: SparkSession, glob: str, schema: str, key_pattern: str = r"_([^_/]+)\.[A-Za-z]+$", key_col: str = "cluster",
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rows, skipped)`` of many CSV files: a file comes whole or not at all.

    ``rows`` has the key parsed from the file's name, ``row_no`` (from 0, blank lines and the header not counted) and the
    columns of ``schema``.  ``skipped(file, key, reason)`` names every listed file that gives no rows: empty or not readable,
    no rows, or lines that do not fit the schema (wrong number of fields or a value of another type).  Line breaks inside
    quotes are not supported.
    """
    # the listing of a scan, empty files included, which the driver holds in any case
    listed = spark.createDataFrame([(f,) for f in spark.read.text(glob).inputFiles()], "file string").select(_file_name("file"))
    head = 1 if header else 0
    lines = numbered_lines(spark, glob, blanks=False).withColumn("r", F.from_csv(
        "value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    body = F.col("line_no") >= head
    counts = lines.groupBy("file").agg(F.count_if(body).alias("n"), F.count_if(body & F.col("r._corrupt").isNotNull()).alias("bad"))
    state = listed.join(counts, "file", "left").withColumn(key_col, file_key("file", key_pattern)).withColumn(
        "reason", F.when(F.col("n").isNull(), "empty or not readable").when(F.col("n") == 0, "no rows")
        .when(F.col("bad") > 0, F.format_string("%d lines do not fit the schema", "bad")))
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    rows = lines.where(body).join(state.where("reason IS NULL").select("file", key_col), "file") \
        .select(key_col, (F.col("line_no") - head).alias("row_no"), *[F.col(f"r.`{c}`").alias(c) for c in names])
    return rows, state.where("reason IS NOT NULL").select("file", key_col, "reason")


def read_paired_files(spark: SparkSession, x_glob: str, x_schema: str, y_glob: str, y_schema: str = "label int",
                      key_pattern: str = r"_([^_/]+)\.[A-Za-z]+$", key_col: str = "cluster", x_header: bool = True,
                      y_header: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, skipped)``: feature files paired with label files by the key in their names, row by row.

    ``skipped(key, reason)`` names every key that gives no rows: a file skipped by ``read_whole_files``, one without a
    partner, or two with different numbers of rows (several files of one key on a side count as that, too)."""
    x, x_skipped = read_whole_files(spark, x_glob, x_schema, key_pattern, key_col, x_header)
    y, y_skipped = read_whole_files(spark, y_glob, y_schema, key_pattern, key_col, y_header)
    size = x.groupBy(key_col).agg(F.count(F.lit(1)).alias("nx"), F.max("row_no").alias("mx")) \
        .join(y.groupBy(key_col).agg(F.count(F.lit(1)).alias("ny"), F.max("row_no").alias("my")), key_col, "full")
    state = size.withColumn("reason", F.when(F.col("ny").isNull(), "no labels").when(F.col("nx").isNull(), "no features")
                            .when((F.col("nx") != F.col("ny")) | (F.col("mx") != F.col("nx") - 1) | (F.col("my") != F.col("ny") - 1),
                                  F.format_string("%d rows of features, %d of labels", "nx", "ny")))
    bad = x_skipped.select(key_col, F.concat(F.lit("features: "), "reason").alias("reason")) \
        .unionByName(y_skipped.select(key_col, F.concat(F.lit("labels: "), "reason").alias("reason"))) \
        .unionByName(state.where("reason IS NOT NULL").select(key_col, "reason"))
    usable = state.where("reason IS NULL").select(key_col)
    rows = x.join(usable, key_col, "left_semi").join(y, [key_col, "row_no"])
    return rows, bad.groupBy(key_col).agg(F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reason"))


def usable_groups(df: DataFrame, group_col: str, label_col: str = "label", min_rows: int = 2) -> DataFrame:
    """Rows of the groups that can be fitted: at least ``min_rows`` rows and both
    classes (the explicit form of skipping unusable inputs)."""
    ok = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(label_col).alias("_k")) \
        .where((F.col("_n") >= min_rows) & (F.col("_k") == 2)).select(group_col)
    return df.join(ok, group_col, "left_semi")


def parse_report_text(spark: SparkSession, text_df: DataFrame, text_col: str = "value") -> DataFrame:
    """Printed per-class reports (``class precision recall f1 support`` lines) ->
    rows; header, blank and summary lines are dropped."""
    lines = text_df.select(F.explode(F.split(text_col, "\n")).alias("line"))
    lines = lines.select(squeeze_blanks("line").alias("line")).where(F.length("line") > 0)
    parts = lines.select(F.split("line", " ").alias("p"))
    n = F.size("p")
    row = parts.where(n >= 5).select(
        F.array_join(F.slice("p", 1, n - 4), " ").alias("class"),
        F.element_at("p", -4).try_cast("double").alias("precision"),
        F.element_at("p", -3).try_cast("double").alias("recall"),
        F.element_at("p", -2).try_cast("double").alias("f1"),
        F.element_at("p", -1).try_cast("double").alias("support"))
    return row.where(F.col("precision").isNotNull() & ~F.lower("class").contains("avg")
                     & ~F.lower("class").contains("accuracy"))


# ---------------------------------------------------------------- sinks
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write a table (header row for CSV); ``mode="append"`` adds rows."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_by_value(df: DataFrame, path: str, col: str, fmt: str = "parquet") -> None:
    """One directory per value of ``col`` (the per-cluster split) in one job."""
    write_table(df, path, fmt, "overwrite", [col])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
