"""Tables written between two passes, in the folder that all executors share.

The folder is spark.checkpoint.dir of the session. Where that is unset a local master uses a
temporary folder, and any other is an error. Files live as long as the session needs them; clear() removes them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = _own.setdefault(app, tempfile.mkdtemp(prefix="orrery-"))
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/orrery-{app}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back; later plans start from its files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clear(spark: SparkSession) -> None:
    """Removes every table of this application; call it when no result is still to be computed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
