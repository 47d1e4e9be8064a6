"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from folioforge.sources.tables import spread


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; only where it is unset, a local folder is set, on one machine alone (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if not current:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
            current = sc.getCheckpointDir()
        root = current
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path as seen by open() and mmap on every worker; the shared folder must be a mounted one for that."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return unquote(url.path)
    raise ValueError(f"{path}: memory mapping needs spark.checkpoint.dir on a mounted shared file system")


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, with the path; cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Removes tables that no later result reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, over all cores where it comes in fewer parts than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
