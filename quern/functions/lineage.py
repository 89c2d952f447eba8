"""Tables in the folder that all executors share, to cut lineage and to keep what several parts of a plan read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without that setting, a temporary folder is set for the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
        _made.append(root)
    root = root.rstrip("/")
    return root if "://" in root or root.startswith("file:") else "file://" + root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root; release() deletes it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df as a table in the shared folder: computed once, whoever reads it, and a lost executor costs nothing of it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """stored(), for loops, whose plans would grow from round to round."""
    return stored(df, "round")


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, over all cores where its files are too few to keep them busy; a table of as many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession | None = None) -> int:
    """Deletes the tables made so far (results that read them can't be computed any more); how many there were."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return 0
    gone = 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already
        pass


atexit.register(_at_exit)
