"""Binding of the driver's test tables to the cohort roles.

| role        | table      | columns |
|-------------|------------|---------|
| stays       | orders (+ customer) | hadm_id = o_orderkey, subject_id = o_custkey, label = o_orderstatus = 'F' |
| diagnoses   | lineitem   | hadm_id = l_orderkey, seq_num = l_linenumber, icd9_code from l_partkey |
| dictionary  | part       | icd9_code from p_partkey, category = p_brand, descr = p_type, line_no = p_partkey |
| scores      | labels + documents | label = quality, score = n_chars |
| tied scores | lineitem   | label = l_returnflag = 'R', score = l_discount |

The code rule is kept as SQL text so that the Spark plan and the DuckDB oracle
evaluate the very same expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the binding: the code domain and the residues that become
# supplementary ('E', 'V') codes.
CODE_DOMAIN = 2000
DICT_DOMAIN = 1500


def code_sql(x: str) -> str:
    """Diagnosis-code text for an integer expression ``x`` in ``[0, CODE_DOMAIN)``.

    Three digits from ``x % 1000`` plus one digit from ``x / 1000``; residue 7 of
    50 gives an external-cause code ``E###``, residue 13 a supplementary ``V###``.
    """
    c3 = f"lpad(CAST({x} % 1000 AS STRING), 3, '0')"
    d = f"CAST(CAST(floor({x} / 1000) AS BIGINT) AS STRING)"
    return (f"CASE WHEN {x} % 50 = 7 THEN concat('E', {c3}) "
            f"WHEN {x} % 50 = 13 THEN concat('V', substr({c3}, 2, 2), {d}) "
            f"ELSE concat({c3}, {d}) END")


DIAG_CODE_SQL = code_sql(f"(l_partkey % {CODE_DOMAIN})")
DICT_CODE_SQL = code_sql(f"(p_partkey % {DICT_DOMAIN})")
LABEL_SQL = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stays(spark: SparkSession, sf_dir: str, with_customer: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"),
        F.expr(LABEL_SQL).cast("int").alias("label"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total_price"))
    if not with_customer:
        return o
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acct_balance"))
    return o.join(c, "subject_id", "left")


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("seq_num"),
        F.expr(DIAG_CODE_SQL).alias("icd9_code"))


def code_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("line_no"), F.expr(DICT_CODE_SQL).alias("icd9_code"),
        F.col("p_brand").alias("category"), F.col("p_type").alias("descr"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurements per stay: quantity, price and discount of each line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return lab.join(doc, "doc_id", "inner")


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("grp"), F.col("l_discount").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"))


# SQL text of the same roles, for the DuckDB oracle.
SQL_STAYS = f"SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, {LABEL_SQL} AS label, " \
            f"o_orderpriority AS priority, o_totalprice AS total_price FROM orders"
SQL_STAYS_C = ("SELECT s.*, c_mktsegment AS segment, c_acctbal AS acct_balance FROM "
               f"({SQL_STAYS}) s LEFT JOIN customer ON c_custkey = s.subject_id")
SQL_DIAG = f"SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num, {DIAG_CODE_SQL} AS icd9_code FROM lineitem"
SQL_DICT = (f"SELECT p_partkey AS line_no, {DICT_CODE_SQL} AS icd9_code, p_brand AS category, "
            f"p_type AS descr FROM part")
SQL_DOC_SCORES = ("SELECT l.doc_id, l.quality AS label, d.lang, CAST(d.n_chars AS DOUBLE) AS score "
                  "FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
SQL_LINE_SCORES = ("SELECT l_linestatus AS grp, l_discount AS score, "
                   "CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem")
