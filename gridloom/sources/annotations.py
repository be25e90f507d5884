"""Sources of annotations, pages and image listings, and the cached frame sink."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.order import ordinal_by
from gridloom.sources.interim import file_system
from gridloom.sources.json_array import read_json_array

IMAGE_SUFFIX = r"[^/]\.(png|jpe?g|webp|bmp)$"


def read_annotations(spark: SparkSession, paths: dict[str, str | Sequence[str]]) -> DataFrame:
    """source, entry (VARIANT) of JSON arrays: of a file, of every file of a folder, or of a list of ordered parts.

    A file of any size is read by many tasks.  Entries that the strict parser rejects (bare NaN) go
    through the lenient one, each for itself.
    """
    lenient = F.from_json("text", "img_filename string, instruction string, bbox array<double>, elements array<struct<instruction string, bbox array<double>>>")
    nested = F.to_variant_object(F.struct("e.img_filename", "e.elements"))
    flat = F.to_variant_object(F.struct("e.img_filename", "e.instruction", "e.bbox"))
    loose = F.when(F.col("e.elements").isNotNull(), nested).otherwise(flat)
    out = None
    for source, path in paths.items():
        for parts in [[p] for p in files_of(path)] if isinstance(path, str) else [list(path)]:
            text = read_json_array(spark, parts).withColumns({"strict": F.try_parse_json("text"), "e": lenient})
            part = text.select(F.lit(source).alias("source"), F.coalesce("strict", loose).alias("entry"))
            out = part if out is None else out.unionByName(part)
    return out


def files_of(path: str) -> list[str]:
    """The file that ``path`` names, or the visible files of a folder in the order of their names."""
    files, place = file_system(path)
    if files.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    found = (x for x in files.get_file_info(fs.FileSelector(place)) if x.is_file and x.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.base_name)]


def write_annotations(entries: DataFrame, path: str, text: str = "text") -> list[str]:
    """Write JSON entries as one array in ordered parts, which are returned; nothing is collected."""
    placed = ordinal_by(entries.select(text), text, "pos")
    lines = placed.select("pos", F.concat(F.when(F.col("pos") == 0, "").otherwise(","), F.col(text)).alias("value"))
    ends = entries.sparkSession.createDataFrame([(-1, "["), (1 << 62, "]")], "pos bigint, value string")
    lines.unionByName(ends).orderBy("pos").select("value").write.text(path)
    return files_of(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def keep_pages(pages: DataFrame, path: str) -> None:
    """Page subset on disk, a folder per category and split, so that later reads prune by both."""
    flat = pages.withColumn("doc_category", F.col("metadata.doc_category"))
    keys = [c for c in ("doc_category", "split") if c in flat.columns]
    flat.write.mode("overwrite").partitionBy(*keys).parquet(path)


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from the header of a PNG file."""
    return tuple(F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int") for at in (17, 21))


def cached(spark: SparkSession, root: str, config: dict, build) -> DataFrame:
    """The frame that ``build()`` gives, kept as Parquet under a name that holds its configuration.

    A changed configuration has another name, so a stale frame is never read; an unfinished write
    has no success marker and is done again.
    """
    name = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()
    path = f"{root.rstrip('/')}/{name}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
