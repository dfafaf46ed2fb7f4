"""Tables in the folder that the driver and all executors share (spark.checkpoint.dir): they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def remote(path: str) -> bool:
    """Whether a path has a scheme (hdfs://, file:/, ..), so that Spark opens it; others are the driver's own files."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def qualified(spark: SparkSession, path: str) -> str:
    """A path of Spark's with its scheme, which is that of the default file system if it names none."""
    if remote(path):
        return path
    bare = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bare.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(bare).toString()


def folder(spark: SparkSession) -> str:
    """A new folder there, with its scheme; in local mode, a temporary one where the setting is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{qualified(spark, base).rstrip('/')}/engine-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
