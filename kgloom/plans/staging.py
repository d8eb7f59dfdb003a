"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The configured folder; a folder of this machine only in local mode, where there are no others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kgloom-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def written(df: DataFrame, name: str) -> str:
    """Writes df to a new path in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/kgloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> str:
    """Writes df to a new table in the shared folder, in buckets of a key, so that joins and groups on it and more need no shuffle; its name."""
    spark = df.sparkSession
    table = f"kgloom_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return f"{spark.catalog.currentDatabase()}.{table}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back, so loops keep a short lineage that survives lost executors."""
    path = written(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kgloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    path = getattr(df, "_kgloom_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
