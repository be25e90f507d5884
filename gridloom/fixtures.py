"""Inputs of the reference's operators, derived from the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import CORNERS
from gridloom.functions.plan import fenced
from gridloom.operators.elements import filter_frame, records_to_frame
from gridloom.operators.encode import with_frame_boxes
from gridloom.sources.tables import table

UI_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def ui_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A: records with the keys, a query, a normalised box and an image size."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x, y = F.col("l_discount") * F.lit(5.0), F.col("l_tax") * F.lit(5.0)
    box = F.array(x, y, x + F.col("l_quantity") / F.lit(100.0), y + F.col("l_linenumber").cast("double") / F.lit(500.0))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        *UI_KEYS,
        F.col("l_orderkey").cast("string").alias("img_filename"),
        F.col("p_name").alias("instruction"),
        box.alias("bbox"),
        (F.lit(640) + F.pmod("l_orderkey", F.lit(5)) * 320).cast("int").alias("img_w"),
        (F.lit(480) + F.pmod("l_orderkey", F.lit(4)) * 240).cast("int").alias("img_h"),
    )


def ui_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_to_frame(ui_records(spark, sf_dir), keep=UI_KEYS)


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_frame_boxes(filter_frame(ui_frame(spark, sf_dir)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture B: document pages with doubly nested cells."""
    docs = table(spark, sf_dir, "documents")
    k = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit(1.3)).otherwise(F.lit(1.0))
    original = F.when(F.pmod("doc_id", F.lit(14)) == 0, F.lit(None).cast("double")).when(F.pmod("doc_id", F.lit(7)) == 0, F.lit(1332.5)).otherwise(F.lit(1025.0))

    def cell(line: Column, i: Column) -> Column:
        box = F.array(
            (F.lit(40) + F.pmod(i, F.lit(3)) * 300).cast("double") * F.col("k"),
            (F.lit(20) + F.pmod(i, F.lit(40)) * 24).cast("double") * F.col("k"),
            F.least(F.char_length(line) * 6, F.lit(280)).cast("double") * F.col("k"),
            F.lit(18.0) * F.col("k"),
        )
        return F.struct(box.alias("bbox"), F.when(F.pmod(i, F.lit(11)) == 10, F.lit("  ")).otherwise(line).alias("text"))

    df = docs.select("doc_id", "lang", F.split("text", "\n").alias("lines"), k.alias("k"), original.alias("original"))
    df = df.withColumn("cells", F.transform("lines", cell))
    regions = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / 4)), lambda r: F.slice("cells", (r * 4 + 1).cast("int"), F.lit(4)))
    wide = F.lit(1025)
    meta = F.struct(
        F.col("lang").alias("doc_category"), wide.alias("coco_width"), wide.alias("coco_height"), F.col("original").alias("original_width"), F.col("original").alias("original_height")
    )
    return df.select("doc_id", meta.alias("metadata"), regions.alias("pdf_cells"))


def completion(shift: int = 0) -> Column:
    """Fixture C: eight kinds of completions around the frame box."""
    a, b, c, d = (F.bround(F.col(f"{n}_f").cast("double")).cast("bigint") for n in CORNERS)
    kind = F.pmod(F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey") + shift, F.lit(8))
    box = "<box> [%d, %d, %d, %d] </box>"
    narrow = c - F.floor((c - a) / 5)
    return (
        F.when(kind == 0, F.format_string(box, a, b, c, d))
        .when(kind == 1, F.format_string(box, a - 10, b - 10, c + 10, d + 10))
        .when(kind == 2, F.format_string(box, a, b, narrow, d))
        .when(kind == 3, F.format_string("The text is at <box>[%d,%d,%d,%d]</box> or <box>[1,2,3,4]</box>", a, b, c, d))
        .when(kind == 4, F.lit("no box here"))
        .when(kind == 5, F.format_string(box, c, d, a, b))
        .when(kind == 6, F.format_string("\n \t<box> [%d.25, %d.5, %d.75, %d] </box>\t \n", a, b, c, d))
        .otherwise(F.lit("<box> [0, 0, 1024, 768] </box>"))
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fenced(framed(spark, sf_dir).withColumn("completion", completion()), "completion")
    return df.withColumns({"micro": completion(3), "target_bbox": F.array(*[F.col(f"{c}_f") for c in CORNERS])})


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture P: page urls as image paths, with real duplicates of basenames."""
    clean = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    return table(spark, sf_dir, "pages").select(F.lit("web").alias("source"), "page_id", clean.alias("rel_path"), F.regexp_extract(clean, "([^/]*)/*$", 1).alias("basename"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture G: conversations with word lengths as token ids."""
    turns = table(spark, sf_dir, "conversations")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    df = turns.groupBy("conv_id").agg(listed.alias("messages"))
    ids = lambda text: F.transform(F.split(text, " "), lambda w: F.char_length(w).cast("bigint"))
    all_ids = F.flatten(F.transform("messages", lambda m: ids(m["content"])))
    return df.withColumns(
        {"input_ids": all_ids, "prompt_length": F.size(ids(F.get("messages", F.lit(0))["content"])), "batch_id": F.floor(F.col("conv_id") / 8).cast("bigint")}
    )
