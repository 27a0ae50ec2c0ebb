"""Scalar column functions (Column -> Column), all JVM-side built-ins.

These are the string, array and math helpers the cohort operators share: quote
trimming, parsing of printed lists, code prefixes, interval text, thresholds and
half-even rounding.  None of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters stripped from dictionary cells.
QUOTE_BLANKS = " \"'\t\r\n"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_chars(col, chars: str = QUOTE_BLANKS) -> Column:
    """Strip any of ``chars`` from both ends (Python's ``str.strip(chars)``)."""
    return F.btrim(_c(col), F.lit(chars))


def parse_printed_list(col, brackets: str = "[]") -> Column:
    """``"['4280', '5849']"`` -> ``['4280', '5849']``: strip brackets, split on ", ",
    drop the first and last character of each item (the quotes).  Empty items go."""
    inner = F.btrim(_c(col), F.lit(brackets))
    items = F.split(inner, ", ")
    stripped = F.transform(items, lambda x: F.when(F.length(x) >= 2, x.substr(F.lit(2), F.length(x) - 2))
                           .otherwise(F.lit("")))
    return F.filter(stripped, lambda x: x != "")


def parse_printed_tuple(col) -> Column:
    return parse_printed_list(col, brackets="()")


def code_prefix3(col) -> Column:
    """Integer value of the first three characters; null for E/V codes and non-numbers."""
    c = _c(col)
    return F.when(is_supplementary(c), F.lit(None).cast("int")).otherwise(F.substring(c, 1, 3).try_cast("int"))


def is_supplementary(col) -> Column:
    c = _c(col)
    return c.startswith("E") | c.startswith("V")


def split_interval(col, truncated_start: bool = False) -> Column:
    """``"390-459"`` -> struct(lo=390, hi=459); null without a dash or with an empty side.

    ``truncated_start`` drops the last character of the start ("39"), for parity
    with a splitter that cut one character too many.
    """
    c = _c(col)
    pos = F.instr(c, "-")
    start = c.substr(F.lit(1), pos - 1)
    end = c.substr(pos + 1, F.length(c))
    if truncated_start:
        start = start.substr(F.lit(1), F.length(start) - 1)
    ok = (pos > 0) & (F.length(start) > 0) & (F.length(end) > 0)
    return F.when(ok, F.struct(start.try_cast("int").alias("lo"), end.try_cast("int").alias("hi")))


def to_int(col) -> Column:
    return _c(col).try_cast("int")


def to_double(col) -> Column:
    return _c(col).try_cast("double")


def label_from_yes(col, yes: str = "Yes") -> Column:
    """1 for ``yes``, 0 for anything else including null."""
    return F.coalesce(_c(col) == yes, F.lit(False)).cast("int")


def threshold(col, cut: float = 0.5) -> Column:
    """0 below ``cut``, else 1 (a null score stays null)."""
    c = _c(col)
    return F.when(c < cut, F.lit(0)).when(c.isNotNull(), F.lit(1))


def round_half_even(col, scale: int = 0) -> Column:
    return F.bround(_c(col), scale)


def none_text(col) -> Column:
    return F.coalesce(_c(col), F.lit("None"))


def clip(col, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


def node_at_depth(path_col, depth: int) -> Column:
    """Code of the node at ``depth`` in a path; the last one if several, null if none."""
    nodes = F.filter(_c(path_col), lambda n: n["depth"] == depth)
    return F.when(F.size(nodes) > 0, F.element_at(nodes, -1)["code"])


def pad_to_width(arr_col, width: int, fill=0) -> Column:
    a = _c(arr_col)
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(width) - F.size(a), F.lit(0))))


def replace_text(col, old: str, new: str) -> Column:
    """Every occurrence of ``old`` replaced (plain text, no pattern)."""
    return F.replace(_c(col), F.lit(old), F.lit(new))


def squeeze_blanks(col) -> Column:
    return F.regexp_replace(F.trim(_c(col)), r"\s+", " ")


def report_lines(col) -> Column:
    """A printed classification report -> array of lines split on blanks (text ingest)."""
    lines = F.split(_c(col), "\n")
    return F.transform(F.filter(lines, lambda l: F.length(F.trim(l)) > 0),
                       lambda l: F.split(F.trim(l), r"\s{2,}"))


def file_key(path_col, pattern: str = r"_([^_/]+)\.[A-Za-z]+$") -> Column:
    """Key embedded in a file name, e.g. ``X_cluster_390-459.csv`` -> ``390-459``."""
    return F.regexp_extract(_c(path_col), pattern, 1)


def first_token(col, sep: str = "_") -> Column:
    return F.split_part(_c(col), F.lit(sep), F.lit(1))


def linspace(spark: SparkSession, n: int = 100, name: str = "x") -> DataFrame:
    """``n`` evenly spaced points on [0, 1]: a bounded grid of ``n`` rows."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"),
                                 (F.col("id") * F.lit(1.0 / (n - 1))).alias(name))
