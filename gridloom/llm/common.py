"""Shared ground for the llm operators: shared folder, intermediate tables, word rule."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.interim import shared_folder

#: A word is a run of characters that are neither a space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, shrink: int = 1) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    ``shrink`` is how many shuffle partitions share a file.  Tables that are small next to the one
    they come from are dealt out again before they are written, so that work stays spread and the
    shared file system is not filled with tiny files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if shrink > 1:
        df = df.repartition(max(3, shuffle_partitions(spark) // shrink))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of :func:`keep` that no later step reads."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def spare_memory() -> None:
    """In a worker: give back what earlier tasks of other stages left in it, before a stage that needs the room.

    Workers are used again by later stages, with their tokenizers and remembered pieces and with memory
    that Arrow holds for its next batches.
    """
    import pyarrow as pa

    if tokens := sys.modules.get("gridloom.llm.tokens"):
        tokens.give_back()
    pa.default_memory_pool().release_unused()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fenced(df: DataFrame) -> DataFrame:
    """``df`` behind a generator, through which the optimizer pushes no filter.

    Pushing a filter through a chain of projections writes their expressions into it, and where
    each level uses the one below several times the filter's size explodes.
    """
    one = df.select(F.explode(F.array(F.struct("*"))).alias("_one"))
    return one.select("_one.*")
