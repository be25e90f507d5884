"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; a table of fewer splits than there are cores is dealt out to all of them.

    The rule looks at splits alone, whatever the size: row groups are not split, so a file written as one
    would keep a single core busy with all that follows.  Column pruning and filters pass through the
    dealing.  Tables of as many splits as cores, or more, are read as they are split.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
