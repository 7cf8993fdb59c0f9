"""Session set-up and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on; everything else is left to the cluster.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("normforge").config("spark.driver.memory", memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in (CONF | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configured(spark: SparkSession) -> SparkSession:
    """Sets the SQL settings on a session made elsewhere."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; only in local mode, as in tests, one of our own where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "normforge-checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: columns are pruned and packed, unlike in a checkpoint.

    The shuffle files of the write are removed when it ends, instead of when the driver happens to
    collect its garbage. The driver's exit removes what it wrote.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/normforge-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_removed, spark, path)
    return spark.read.parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass
