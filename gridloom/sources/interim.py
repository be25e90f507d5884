"""Tables that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/checkpoints/gridloom"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session may leave it unset, a cluster may not."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, computed once: it is read back from Parquet, so a lost executor costs a scan and no lineage."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/interim/{label}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """Arrow file system and path of what Hadoop names ``uri``; a bare path is local."""
    from pyarrow import fs

    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(old):
            uri = new + uri[len(old) :]
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
