"""Session construction and the checkpoint folder.

On a cluster the checkpoint folder must be shared storage named by
``spark.checkpoint.dir``; we only invent a local one when the session is a
``local[...]`` session and the setting is absent (tests, the bench).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "wardlens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it on the context if needed.

    The folder comes from ``spark.checkpoint.dir``.  Only a local-mode session
    with no setting gets a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        conf_dir = tempfile.mkdtemp(prefix="wardlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tmp_output_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoint folder for intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder and read back, in at least one file for each core: a pass over it keeps all
    busy, also where ``df`` comes from a single file."""
    spark = df.sparkSession
    path, cores = tmp_output_dir(spark, name), spark.sparkContext.defaultParallelism
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    if len(back.inputFiles()) >= cores:
        return back
    path = tmp_output_dir(spark, name)
    back.repartition(cores).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
