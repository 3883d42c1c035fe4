"""The Spark session that tests, the bench and the command line use."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def hold(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, in spark.checkpoint.dir; where that is unset, a local master uses a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="orrery-"))
    return df.checkpoint()


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE on and UTC as time zone; on a cluster, pass the cluster's own settings in conf."""
    builder = (
        SparkSession.builder.master(master)
        .appName("orrery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
