"""Pages kept in buckets of their number, so that looking images up moves no image."""

from __future__ import annotations

import hashlib

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.interim import file_system, written

#: Bytes of images that one bucket should hold.
BUCKET_BYTES = 256 << 20
#: Rows for which one copy of a page is enough.
HOT_ROWS = 100_000


def keep_in_buckets(pages: DataFrame, path: str, number: str = "page_ordinal", buckets: int | None = None, image: str = "image") -> DataFrame:
    """Write pages to a new folder below ``path``, dealt into buckets by ``number`` and sorted there; see :func:`open_buckets`.

    Every bucket is one file.  Where their count is not given it follows from the bytes of ``image``, and
    is at least the session's shuffle partitions: with fewer, a join would deal both sides anew.
    """
    spark = pages.sparkSession
    if buckets is None:
        total = pages.agg(F.sum(F.octet_length(F.col(image).cast("binary")))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    dealt = pages.withColumn(number, F.col(number).cast("bigint")).repartition(buckets, number)
    # The table of the catalog names the folder and no more, so another session can open it too.
    folder = f"{path.rstrip('/')}/{number}-{buckets}"
    writer = dealt.write.format("parquet").mode("errorifexists").bucketBy(buckets, number).sortBy(number)
    writer.option("path", folder).saveAsTable(_named(folder))
    return spark.table(_named(folder))


def open_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The pages that :func:`keep_in_buckets` finished below ``path``, in this session or another.

    The folder's name holds the column and how many buckets there are; a folder without the mark of a
    finished write is an error.
    """
    files, place = file_system(path)
    found = [x.base_name for x in files.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.Directory]
    done = [x for x in found if files.get_file_info(f"{place.rstrip('/')}/{x}/_SUCCESS").is_file]
    if len(done) != 1:
        raise ValueError(f"{path} holds {len(done)} finished tables of pages, not one")
    folder, (number, _, buckets) = f"{path.rstrip('/')}/{done[0]}", done[0].rpartition("-")
    if not spark.catalog.tableExists(_named(folder)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(
            f"CREATE TABLE {_named(folder)} ({columns}) USING parquet CLUSTERED BY (`{number}`) SORTED BY (`{number}`) INTO {int(buckets)} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(_named(folder))


def _named(folder: str) -> str:
    return f"pages_{hashlib.md5(folder.encode()).hexdigest()}"


def look_up(rows: DataFrame, pages: DataFrame, number: str = "page_ordinal", path: str = "image_path", image: str = "image", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the image of the page that ``path``, a number as text, names; rows without such a page are left out.

    Rows travel to the buckets; pages are read where they lie, in files already sorted by number, and
    only the number and the image of them.  A page that more than ``hot_rows`` rows ask for is copied
    once for each so many of them, which deals its rows to several tasks: only such pages move, and the
    copies are fewer than two for every ``hot_rows`` rows.
    """
    rows = rows.withColumn("_at", F.try_to_number(F.col(path), F.lit("9" * 18)).cast("bigint")).where("_at IS NOT NULL")
    stored = pages.select(F.col(number).alias("_number"), image)
    hot = written(rows.groupBy("_at").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("_at", F.ceil(F.col("n") / hot_rows).alias("_parts")), "hot_pages")
    if hot.isEmpty():
        return rows.join(stored.hint("merge"), F.col("_at") == F.col("_number")).drop("_at", "_number")
    cold = rows.join(hot, "_at", "left_anti").join(stored.hint("merge"), F.col("_at") == F.col("_number")).drop("_at", "_number")
    # Written, since a row that is computed again must not get another part.
    dealt = written(rows.join(hot, "_at").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).drop("_parts"), "hot_rows")
    copies = stored.join(hot, F.col("_number") == F.col("_at")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).select("_at", "_part", image)
    return cold.unionByName(dealt.join(copies, ["_at", "_part"]).drop("_at", "_part"))
