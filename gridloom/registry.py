"""Queries over the reference's own operators and the SQL they are held against."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom.config import Config, override
from gridloom.functions import geometry as geo
from gridloom.functions import scoring
from gridloom.functions.geometry import CORNERS
from gridloom.functions.plan import fenced
from gridloom.functions.text import completion_text, parse_box, render_answer, render_prompt
from gridloom.operators import agent, cells, elements, encode, order
from gridloom.operators.pixels import framed_images
from gridloom.oracle import SQL
from gridloom.plans import datasets, metrics
from gridloom.sources import annotations, archives, image_files, image_folder, page_store
from gridloom.sources.interim import file_system, new_folder

#: A frame that is small enough to be compared by pixels.
SMALL = (64, 48)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _box(name: str) -> list[Column]:
    return [F.col(name)[c] for c in CORNERS]


def _named(values: list[Column], suffix: str = "") -> list[Column]:
    return [v.alias(c + suffix) for v, c in zip(values, CORNERS, strict=True)]


def _entries(spark: SparkSession, d: str, nested: bool) -> DataFrame:
    """Fixture A as annotation entries: nested by image, or flat; some malformed."""
    e = fx.ui_records(spark, d)
    bad = F.when(F.pmod("l_partkey", F.lit(97)) == 0, F.lit(None).cast("array<double>")).otherwise(F.col("bbox"))
    empty = F.when(F.pmod("l_partkey", F.lit(89)) == 0, F.lit("")).otherwise(F.col("instruction"))
    element = F.struct(empty.alias("instruction"), bad.alias("bbox"))
    if nested:
        grouped = e.groupBy("img_filename").agg(F.collect_list(element).alias("elements"))
        return grouped.select(F.lit("a").alias("source"), F.to_variant_object(F.struct("img_filename", "elements")).alias("entry"))
    flat = F.struct("img_filename", empty.alias("instruction"), bad.alias("bbox"))
    return e.select(F.lit("a").alias("source"), F.to_variant_object(flat).alias("entry"))


def _flattened(spark: SparkSession, d: str, nested: bool) -> DataFrame:
    flat = elements.flatten_elements(_entries(spark, d, nested)).where(elements.is_wellformed())
    return flat.select("img_filename", "instruction", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(CORNERS)])


@query
def ui_flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    return _flattened(spark, d, True)


@query
def ui_flatten_flat(spark: SparkSession, d: str) -> DataFrame:
    return _flattened(spark, d, False)


@query
def ui_frame_normalized(spark: SparkSession, d: str) -> DataFrame:
    return fx.ui_frame(spark, d)


@query
def ui_frame_absolute(spark: SparkSession, d: str) -> DataFrame:
    return elements.records_to_frame(fx.ui_records(spark, d), "absolute", keep=fx.UI_KEYS)


@query
def filter_ui(spark: SparkSession, d: str) -> DataFrame:
    return elements.filter_frame(fx.ui_frame(spark, d))


@query
def load_quality_counts(spark: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("s"), F.pmod(F.col("img_filename").cast("bigint"), F.lit(3)).cast("string"))
    entries = _entries(spark, d, True).select(F.monotonically_increasing_id().alias("entry_id"), "entry")
    flat = elements.flatten_elements(entries).withColumns(
        {"source": source, "found": F.pmod(F.col("img_filename").cast("bigint"), F.lit(10)) != 0, "ok": elements.is_wellformed(), "rel_path": F.col("img_filename")}
    )
    return elements.load_counts(flat.select("source", "img_filename", "found").distinct(), flat.where("found"))


@query
def image_index_dedup(spark: SparkSession, d: str) -> DataFrame:
    return elements.image_index(fx.image_files(spark, d), order=("page_id",)).select("source", "basename", "page_id", "rel_path", "copies")


def _image_entries(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select(
        "doc_id", F.lit("web").alias("source"), F.concat(F.lit("img/"), F.pmod("doc_id", F.lit(400)).cast("string"), F.when(F.pmod("doc_id", F.lit(2)) == 0, ".html").otherwise("")).alias("img_filename")
    )


@query
def image_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = elements.lookup_images(_image_entries(spark, d), image_index_dedup(spark, d))
    return found.select("doc_id", "img_filename", "page_id", "rel_path")


@query
def image_missing(spark: SparkSession, d: str) -> DataFrame:
    return elements.missing_images(_image_entries(spark, d), image_index_dedup(spark, d)).select("doc_id", "img_filename")


@query
def image_sizes_distinct(spark: SparkSession, d: str) -> DataFrame:
    return fx.ui_records(spark, d).select(F.col("img_filename").alias("rel_path"), "img_w", "img_h").distinct()


def _category(spark: SparkSession, d: str) -> DataFrame:
    return cells.pages_of_category(fx.pages(spark, d), "en")


@query
def page_category_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.col("metadata.doc_category") == "en"
    return fx.pages(spark, d).agg(F.count_if(kept).alias("kept"), F.count("*").alias("total"))


@query
def page_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return order.ordinal_by(_category(spark, d), "doc_id", "page_ordinal").select("doc_id", "page_ordinal")


@query
def cells_flatten(spark: SparkSession, d: str) -> DataFrame:
    cell = _category(spark, d).select("doc_id", F.posexplode(cells.flat_cells()).alias("i", "cell"))
    return cell.select("doc_id", "i", F.col("cell.text").alias("text"), *[F.get("cell.bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")])


@query
def cells_rescale(spark: SparkSession, d: str) -> DataFrame:
    return cells.page_scale(_category(spark, d)).select("doc_id", "max_x", "max_y", "rescaled", "scale_x", "scale_y")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return cells.cell_frame(order.ordinal_by(_category(spark, d), "doc_id", "page_ordinal"))


@query
def cell_frame(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query
def filter_cells(spark: SparkSession, d: str) -> DataFrame:
    return elements.filter_frame(_cells(spark, d), max_query_chars=50)


@query
def letterbox_params(spark: SparkSession, d: str) -> DataFrame:
    sizes = fx.ui_records(spark, d).select("img_w", "img_h").distinct()
    return sizes.select("img_w", "img_h", geo.letterbox(F.col("img_w"), F.col("img_h")).alias("p")).select("img_w", "img_h", "p.scale", "p.pad_x", "p.pad_y", "p.content_w", "p.content_h")


@query
def letterbox_boxes(spark: SparkSession, d: str) -> DataFrame:
    return fx.framed(spark, d).select(*fx.UI_KEYS, *[f"{c}_f" for c in CORNERS])


@query
def unletterbox_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    df = fx.framed(spark, d)
    back = geo.unletterbox_box([F.col(f"{c}_f") for c in CORNERS], F.col("params"))
    return df.select(*fx.UI_KEYS, *_named(back, "_o"))


@query
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return fx.framed(spark, d).select(*fx.UI_KEYS, render_prompt(F.col("query")).alias("prompt"))


@query
def answer_render(spark: SparkSession, d: str) -> DataFrame:
    return fx.framed(spark, d).select(*fx.UI_KEYS, render_answer(*[F.col(f"{c}_f") for c in CORNERS]).alias("answer"))


@query
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.sft_rows(fx.framed(spark, d))
    turn = rows.select(*fx.UI_KEYS, F.posexplode("messages").alias("turn", "m"))
    part = turn.select(*fx.UI_KEYS, "turn", F.col("m.role").alias("role"), F.posexplode("m.content").alias("part", "c"))
    return part.select(*fx.UI_KEYS, "turn", "role", "part", F.col("c.type").alias("type"), F.col("c.text").alias("text"))


@query
def sft_rows(spark: SparkSession, d: str) -> DataFrame:
    lengths = lambda text: F.transform(F.split(text, " "), lambda w: F.char_length(w).cast("bigint"))
    rows = encode.sft_rows(fx.framed(spark, d), tokenize=lengths)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select(*fx.UI_KEYS, "answer", joined("input_ids"), joined("labels"), F.size("attention_mask").alias("n_ids"))


@query
def grpo_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.grpo_rows(fx.framed(spark, d))
    first = F.get("prompt", F.lit(0))
    return rows.select(*fx.UI_KEYS, first["role"].alias("role"), first["content"].alias("content"), *[F.get("target_bbox", F.lit(i)).alias(c) for i, c in enumerate(CORNERS)])


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    df = fx.chats(spark, d).withColumn("labels", encode.mask_prompt(F.col("input_ids"), F.col("prompt_length")))
    return df.select("conv_id", "prompt_length", _joined("labels"))


@query
def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    df = fx.chats(spark, d).withColumns(
        {
            "labels": encode.mask_prompt(F.col("input_ids"), F.col("prompt_length")),
            "attention_mask": F.transform("input_ids", lambda x: F.lit(1).cast("bigint")),
        }
    )
    padded = encode.pad_batches(df)
    return padded.select("conv_id", "batch_id", "length", *[_joined(c) for c in ("input_ids", "attention_mask", "labels")])


@query
def completion_texts(spark: SparkSession, d: str) -> DataFrame:
    return fx.chats(spark, d).select("conv_id", completion_text(F.col("messages")).alias("text"))


@query
def parsed_boxes(spark: SparkSession, d: str) -> DataFrame:
    df = fx.completions(spark, d).withColumn("box", parse_box(F.col("completion")))
    return df.select(*fx.UI_KEYS, *_named(_box("box")))


@query
def format_reward(spark: SparkSession, d: str) -> DataFrame:
    return fx.completions(spark, d).select(*fx.UI_KEYS, scoring.format_reward(F.col("completion")).alias("reward"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    df = fenced(fx.completions(spark, d).withColumn("box", parse_box(F.col("completion"))), "box")
    coverage, precision = scoring.coverage_precision(_box("box"), [F.col(f"{c}_f") for c in CORNERS])
    return df.withColumns({"coverage": coverage, "precision": precision})


@query
def coverage_precision(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select(*fx.UI_KEYS, "coverage", "precision")


@query
def bbox_reward(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.score(fx.completions(spark, d), channels=["asymmetric_bbox_reward_func"])
    return scored.select(*fx.UI_KEYS, F.col("asymmetric_bbox_reward_func").alias("reward"))


@query
def reward_summary(spark: SparkSession, d: str) -> DataFrame:
    means = scoring.channel_means(scoring.score(fx.completions(spark, d)))
    return means.select(*[F.round(F.col(f"`rewards/{n}/mean`"), 6).alias(n) for n in scoring.CHANNELS])


@query
def reward_group_stats(spark: SparkSession, d: str) -> DataFrame:
    scored = scoring.score(fx.completions(spark, d)).withColumn("prompt_id", F.col("l_partkey"))
    r = F.col("asymmetric_bbox_reward_func")
    return scored.groupBy("prompt_id").agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_pop(r), 6).alias("deviation"))


@query
def benchmark_accuracy(spark: SparkSession, d: str) -> DataFrame:
    ok = scoring.passes(F.col("coverage"), F.col("precision"))
    return _scores(spark, d).agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"))


@query
def crop_box(spark: SparkSession, d: str) -> DataFrame:
    df = agent.zoom_context(agent.macro_pass(fx.completions(spark, d), "completion").where("zooms"))
    return df.select(*fx.UI_KEYS, *_named(_box("crop")), F.col("zoom.scale").alias("scale"), F.col("zoom.pad_x").alias("pad_x"), F.col("zoom.pad_y").alias("pad_y"))


@query
def project_box(spark: SparkSession, d: str) -> DataFrame:
    df = agent.zoom_context(agent.macro_pass(fx.completions(spark, d), "completion").where("zooms"))
    fixed = [F.lit(x).cast("float") for x in (200.0, 300.0, 800.0, 450.0)]
    return df.select(*fx.UI_KEYS, *_named(geo.project_box(fixed, F.col("crop"), F.col("zoom"))))


@query
def zoom_verify(spark: SparkSession, d: str) -> DataFrame:
    df = agent.zoom_verify(fx.completions(spark, d), agent.recorded("completion"), agent.recorded("micro"))
    return df.select(*fx.UI_KEYS, "path", *_named(_box("result")))


class ColourReader:
    """A stand-in for a model: its box follows from the colour in the image's middle and the length of the query."""

    def __call__(self, images, queries):
        middle = images[:, images.shape[1] // 2, images.shape[2] // 2].astype(int).tolist()
        return ["nothing" if b == 255 else f"<box> [{r}, {g}, {r + 10 + len(q) % 3}, {g + b % 8}] </box>" for (r, g, b), q in zip(middle, queries, strict=True)]


def _two_colours(k: Column) -> Column:
    """A frame of SMALL size whose left and right halves have colours that follow from a number."""
    of = lambda *values: F.format_string("%02X%02X%02X", *[v.cast("int") for v in values])
    blue = lambda n: F.when(F.pmod(k, F.lit(n)) == 0, 255).otherwise(F.pmod(k, F.lit(8)))
    left = of(F.pmod(k, F.lit(7)) * 7, F.pmod(k, F.lit(5)) * 8, blue(13))
    right = of(F.get(F.array(*[F.lit(x) for x in (3, 8, 12, 40, 45, 50)]), F.pmod(k, F.lit(6)).cast("int")), F.pmod(k, F.lit(9)) * 4, blue(11))
    line = F.unhex(F.concat(F.repeat(left, SMALL[0] // 2), F.repeat(right, SMALL[0] // 2)))
    return F.repeat(line.cast("string"), F.lit(SMALL[1])).cast("binary")


@query
def zoom_verify_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Two passes over pixels: the model sees each frame, then the crop around its own box; every order is an image."""
    rows = fx.ui_records(spark, d).select(*fx.UI_KEYS, F.col("img_filename").alias("image_path"), F.col("instruction").alias("query"))
    frames = fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("image_path"), F.col("o_orderkey").alias("pixels"))
    out = agent.zoom_verify_pixels(rows, frames, agent.PixelPredictor("colours", ColourReader), target=SMALL, decode=_two_colours)
    return out.select(*fx.UI_KEYS, "path", *_named(_box("result")))


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    return order.shuffled(elements.filter_frame(fx.ui_frame(spark, d)), fx.UI_KEYS, 17)


@query
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    train, held = order.split_holdout(_shuffled(spark, d))
    rows = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout")))
    return rows.select(*fx.UI_KEYS, "pos", "part")


@query
def holdout_groups(spark: SparkSession, d: str) -> DataFrame:
    """A split by whole screenshots."""
    kept = elements.filter_frame(fx.ui_frame(spark, d)).select(*fx.UI_KEYS, "image_path")
    train, held = order.split_groups(kept, "image_path", 0.05, 17)
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("holdout")))


def _children(spark: SparkSession, d: str) -> list[DataFrame]:
    key = lambda *cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    a = elements.filter_frame(fx.ui_frame(spark, d)).withColumn("row_key", key(*fx.UI_KEYS, "x0", "y0"))
    b = elements.filter_frame(_cells(spark, d), max_query_chars=50).withColumn("row_key", key("image_path", "query", "x0", "y0", "x1", "y1"))
    return [x.select("row_key", *elements.FRAME_COLUMNS).dropDuplicates(["row_key"]) for x in (a, b.withColumn("row_key", F.md5("row_key")))]


@query
def mix_counts(spark: SparkSession, d: str) -> DataFrame:
    index = order.mix_index(_children(spark, d), ["row_key"], [0.7, 0.3], 17)
    return index.groupBy("child").agg(F.count("*").alias("n"), F.countDistinct("row_key").alias("rows"), F.max("pick").alias("last_pick"))


@query
def mix_index(spark: SparkSession, d: str) -> DataFrame:
    a = elements.filter_frame(fx.ui_frame(spark, d)).select(F.concat_ws("|", *[F.col(k).cast("string") for k in fx.UI_KEYS]).alias("row_key"))
    b = fx.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("row_key"))
    return order.mix_index([a, b], ["row_key"], [0.7, 0.3], 17).select("pos", "child", "row_key", "pick")


@query
def mixed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = order.mixed_rows(_children(spark, d), ["row_key"], [0.7, 0.3], 17)
    return rows.select("child", "pick", "pos", *elements.FRAME_COLUMNS)


@query
def page_image_join(spark: SparkSession, d: str) -> DataFrame:
    pages = order.ordinal_by(_category(spark, d), "doc_id", "page_ordinal").withColumn("image", F.col("doc_id"))
    return cells.page_images(cells.cell_frame(pages), pages).select("image_path", "query", "x0", "y0", "image")


@query
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of corpus B with the text of their page as its image, from pages kept in buckets."""
    pages, path = order.ordinal_by(_category(spark, d), "doc_id", "page_ordinal"), new_folder(spark, "page_store")
    texts = fx.table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("image"))
    page_store.keep_in_buckets(pages.join(texts, "doc_id").select("page_ordinal", "doc_id", "image"), path)
    rows = elements.filter_frame(cells.cell_frame(pages), max_query_chars=50)
    found = page_store.look_up(rows, page_store.open_buckets(spark, path))
    return found.select("image_path", "query", "x0", "y0", F.md5("image").alias("image"))


@query
def zipped_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of a list of completions against a shorter list of targets."""
    line = fx.completions(spark, d).withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    lists = line.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("place", "completion"))).alias("done"), F.array_sort(F.collect_list(F.struct("place", "target_bbox"))).alias("aims")
    )
    aims = F.slice(F.transform("aims", lambda x: x["target_bbox"]), F.lit(1), F.greatest(F.size("aims") - 1, F.lit(1)))
    texts = F.transform("done", lambda x: x["completion"])
    rewards = scoring.zip_rewards(texts, aims, lambda text, aim: scoring.format_reward(text))
    return lists.select("l_orderkey", F.size(rewards).alias("n"), F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query
def collated_batches(spark: SparkSession, d: str) -> DataFrame:
    ones = F.transform("input_ids", lambda x: F.lit(1).cast("bigint"))
    df = fx.chats(spark, d).withColumns({"labels": encode.mask_prompt(F.col("input_ids"), F.col("prompt_length")), "attention_mask": ones})
    batches = encode.collate(encode.pad_batches(df), order="conv_id")
    return batches.select("batch_id", *[F.array_join(F.transform(c, lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")), ";").alias(c) for c in ("input_ids", "labels")])


def _built(spark: SparkSession, d: str, **more) -> tuple[DataFrame, DataFrame]:
    # A few lines of an order repeat part and supplier, so a row is told by its box too.
    return datasets.build(fx.ui_frame(spark, d), [*fx.UI_KEYS, "x0", "y0"], _cells(spark, d), list(elements.FRAME_COLUMNS[:6]), **more)


@query
def build_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Every encoded row of the training mixture at its place, and every held-out row."""
    train, held = _built(spark, d)
    rows = train.select(F.lit("train").alias("part"), "child", "pick", "pos", "prompt", "answer")
    return rows.unionByName(held.select(F.lit("holdout").alias("part"), F.lit(0).alias("child"), F.lit(None).cast("bigint").alias("pick"), "pos", "prompt", "answer"))


@query
def mixture_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of the training mixture for four ranks: which rows, how long, how much of it padding."""
    lengths = lambda text: F.transform(F.split(text, " "), lambda w: F.char_length(w).cast("bigint"))
    out = datasets.batches(_built(spark, d, tokenize=lengths)[0], 16, 32, 4, 17)
    last = F.element_at("labels", -1)
    return out.select(
        "batch_id", "rank", "step", "padding", F.size("input_ids").alias("n"), F.size(last).alias("length"),
        F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"), F.array_join(F.transform(last, lambda x: x.cast("string")), ",").alias("last_labels"),
    )


@query
def rescaled_pages(spark: SparkSession, d: str) -> DataFrame:
    return cells.rescaled_pages(_category(spark, d))


@query
def pages_by_predicate(spark: SparkSession, d: str) -> DataFrame:
    """A Python predicate over two declared columns."""
    found = cells.pages_where(fx.pages(spark, d), lambda lang, width: lang in ("de", "fr") and width != width, ["metadata.doc_category", "metadata.original_width"])
    return found.select("doc_id")


@query
def ui_corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """The element frame from annotation files of two sources, one nested and one flat, and an image index."""
    e = fx.ui_records(spark, d).withColumn("source", F.when(F.pmod(F.col("img_filename").cast("bigint"), F.lit(2)) == 0, "nested").otherwise("flat"))
    e = e.withColumn("img_filename", F.concat("img_filename", F.lit(".png")))
    element = F.struct("instruction", "bbox")
    nested = e.where("source = 'nested'").groupBy("img_filename").agg(F.collect_list(element).alias("elements"))
    root, paths = new_folder(spark, "annotations"), {}
    for source, entries in (("nested", nested), ("flat", e.where("source = 'flat'").select("img_filename", "instruction", "bbox"))):
        paths[source] = annotations.write_annotations(entries.select(F.to_json(F.struct("*")).alias("text")), f"{root}/{source}")
    files = e.select("source", F.concat(F.lit("d/"), "img_filename").alias("rel_path"), "img_w", "img_h").distinct()
    index = elements.image_index(elements.with_basename(files.select("source", "rel_path")))
    return datasets.ui_frame(annotations.read_annotations(spark, paths), index, files)


@query
def cell_corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """The element frame of a category from pages kept on disk by category."""
    path = new_folder(spark, "pages")
    annotations.keep_pages(fx.pages(spark, d), path)
    pages = annotations.read_pages(spark, path).where("doc_category = 'en'")
    return datasets.cell_frame(pages, "doc_id", override(Config(), {"cells": {"doc_category": "en"}}))


@query
def cached_frame(spark: SparkSession, d: str) -> DataFrame:
    """A frame kept under its configuration: the second request finds it and builds nothing."""

    def never() -> DataFrame:
        raise AssertionError("built twice")

    root = new_folder(spark, "frames")
    annotations.cached(spark, root, {"corpus": "ui"}, lambda: fx.ui_frame(spark, d))
    return annotations.cached(spark, root, {"corpus": "ui"}, never)


@query
def build_alone(spark: SparkSession, d: str) -> DataFrame:
    """GRPO rows of a mixture whose second corpus has no weight."""
    rows, _ = datasets.build(fx.ui_frame(spark, d), fx.UI_KEYS, None, [], override(Config(), {"mix_ratio": [1, 0]}), "grpo")
    return rows.select(*fx.UI_KEYS, F.get("prompt", F.lit(0))["content"].alias("content"), *[F.get("target_bbox", F.lit(i)).alias(c) for i, c in enumerate(CORNERS)])


@query
def cell_sft_rows(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the rows of corpus B."""
    rows = encode.sft_rows(encode.with_frame_boxes(elements.filter_frame(_cells(spark, d), max_query_chars=50)))
    return rows.select("image_path", "prompt", "answer")


@query
def collated_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Batches of streams that came as batches of one, with optional type ids and pixel rows of several lengths."""
    ones = F.transform("input_ids", lambda x: F.lit(1).cast("bigint"))
    df = fx.chats(spark, d).withColumns({"labels": encode.mask_prompt(F.col("input_ids"), F.col("prompt_length")), "attention_mask": ones})
    types = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.transform("input_ids", lambda x: F.pmod(x, F.lit(2))))
    pixels = F.transform(F.slice("input_ids", 1, 3), lambda x: F.array(x, x * 2))
    df = df.withColumns({"mm_token_type_ids": types, "pixel_values": pixels, "image_grid_thw": F.array(F.array(F.lit(1), F.size(pixels))), "bbox": F.lit(0)})
    streams = ("input_ids", "attention_mask", "labels")
    items = encode.squeezed(df.withColumns({c: F.array(c) for c in streams}), *streams)
    batches = encode.collate(encode.pad_batches(items), order="conv_id")
    lists = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")), ";").alias(c)
    return batches.select("batch_id", *[lists(c) for c in ("attention_mask", "mm_token_type_ids", "pixel_values", "image_grid_thw")])


def png(width: int, height: int, colour) -> bytes:
    """A tiny RGB PNG whose pixel (x, y) has ``colour(x, y)``."""
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in colour(x, y)) for y in range(height))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Sizes of the suppliers' images; the one of supplier i has size i % 3 and the colour (40 + 50 (i % 3), 90 + i % 100, 200 - 60 (i % 3)).
SIZES = ((16, 9), (9, 16), (40, 40))


def _images(spark: SparkSession, d: str) -> DataFrame:
    """An image of one colour for every supplier: id, content (PNG)."""

    def image(i: int) -> bytes:
        return png(*SIZES[i % 3], lambda x, y: (40 + 50 * (i % 3), 90 + i % 100, 200 - 60 * (i % 3)))

    drawn = F.pandas_udf(lambda ids: ids.map(image), "binary")

    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), drawn("s_suppkey").alias("content"))


def _pixels(df: DataFrame) -> DataFrame:
    """A row per pixel: id, x, y, r, g, b."""
    at = df.select("id", "pixels", "width", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    value = lambda k: F.conv(F.hex(F.substring("pixels", F.col("i") * 3 + 1 + k, F.lit(1))), 16, 10).cast("int")
    return at.select("id", F.pmod("i", "width").alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *[value(k).alias(c) for k, c in enumerate("rgb")])


@query
def image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that the headers of the parts' images tell, by expressions alone."""
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    wide, high = F.pmod("p_partkey", F.lit(5000)) + 1, F.col("p_size").cast("bigint")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(wide), number(high), F.lit("0802000000")))
    w, h = annotations.png_size(F.col("content"))
    return fx.table(spark, d, "part").select("p_partkey", head.alias("content")).select("p_partkey", w.alias("img_w"), h.alias("img_h"))


@query
def image_letterbox_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' images, scaled and padded, pixel by pixel."""
    return _pixels(framed_images(_images(spark, d), SMALL))


@query
def image_crop_pixels(spark: SparkSession, d: str) -> DataFrame:
    """What the crop around a coarse box shows of a frame of two colours, for every supplier."""

    def image(i: int) -> bytes:
        return png(*SMALL, lambda x, y: (200, i % 90, 30) if x < 40 else (5, 250, i % 70))

    drawn = F.pandas_udf(lambda ids: ids.map(image), "binary")

    boxes = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), drawn("s_suppkey").alias("content"), F.pmod("s_suppkey", F.lit(2)).alias("k"))
    corner = lambda left, right: F.when(F.col("k") == 0, left).otherwise(right).cast("float")
    crop = geo.crop_box([corner(10, 45), corner(8, 10), corner(30, 60), corner(20, 44)], 0.15, SMALL)
    return _pixels(framed_images(boxes.select("id", "content", crop.alias("crop")).select("id", "content", "crop.*"), SMALL, crop=True))


@query
def rows_with_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with their images: boxes in frame pixels and the colour in the frame's middle."""
    k = F.pmod("l_suppkey", F.lit(len(SIZES))).cast("int")
    sizes = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in SIZES])
    records = fx.ui_records(spark, d).withColumns({"img_filename": F.col("l_suppkey").cast("string"), "img_w": F.get(sizes, k)["w"], "img_h": F.get(sizes, k)["h"]})
    rows = encode.with_frame_boxes(elements.records_to_frame(records, keep=fx.UI_KEYS), SMALL)
    images = _images(spark, d).select(F.col("id").cast("string").alias("image_path"), "content")
    middle = (SMALL[1] // 2 * SMALL[0] + SMALL[0] // 2) * 3 + 1
    rows = encode.with_pixels(rows, images, SMALL)
    return rows.select(*fx.UI_KEYS, *[f"{c}_f" for c in CORNERS], F.octet_length("pixels").alias("n_bytes"), F.hex(F.substring("pixels", middle, 3)).alias("middle"))


def _write(spark: SparkSession, files: DataFrame, root: str) -> list[str]:
    """Write files (name, content) below ``root`` from the tasks that hold them; the folders they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, place = file_system(root)
        for batch in batches:
            folders = []
            for row in batch.to_pylist():
                folder, _, name = row["name"].rpartition("/")
                where.create_dir(f"{place}/{folder}", recursive=True)
                with where.open_output_stream(f"{place}/{folder}/{name}") as out:
                    out.write(row["content"])
                folders.append(folder)
            yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string())], names=["folder"])

    return sorted(r["folder"] for r in files.select("name", "content").mapInArrow(run, "folder string").distinct().collect())


@query
def image_folder_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers' images as files in a folder per nation, some with hidden names, listed by the sizes in their headers."""
    root, k = new_folder(spark, "images"), F.pmod("s_suppkey", F.lit(3)).cast("int")
    names = F.concat(F.col("s_nationkey").cast("string"), F.lit("/"), F.get(F.array(F.lit(""), F.lit("_"), F.lit(".h")), k), F.col("s_suppkey").cast("string"), F.lit(".png"))
    _write(spark, _images(spark, d).join(fx.table(spark, d, "supplier"), F.col("id") == F.col("s_suppkey")).select(names.alias("name"), "content"), root)
    return image_folder.list_images(spark, root, "s", folders=8).select("source", "rel_path", "basename", "img_w", "img_h")


def _archives(spark: SparkSession, d: str) -> dict[str, list[str]]:
    """An archive of the suppliers' images per nation, in two parts."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            for i, content in rows.sort_values("id")[["id", "content"]].itertuples(index=False):
                archive.writestr(f"d/{i}.png", content)
        whole, name = raw.getvalue(), str(rows["s_nationkey"].iloc[0])
        return pd.DataFrame({"name": [f"{name}/z.part1", f"{name}/a.part2"], "content": [whole[:50], whole[50:]]})

    root, suppliers = new_folder(spark, "archives"), fx.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    images = _images(spark, d).join(suppliers, F.col("id") == F.col("s_suppkey"))
    nations = _write(spark, images.groupBy("s_nationkey").applyInPandas(packed, "name string, content binary"), root)
    return {n: [f"{root}/{n}/z.part1", f"{root}/{n}/a.part2"] for n in nations}


@query
def zip_scan(spark: SparkSession, d: str) -> DataFrame:
    """Of the members of the nations' archives those that a line of an order refers to."""
    members = archives.list_members(spark, _archives(spark, d))
    wanted = fx.table(spark, d, "lineitem").where("l_quantity >= 45").select(F.concat(F.lit("d/"), F.col("l_suppkey").cast("string"), F.lit(".png")).alias("name")).distinct()
    read = archives.read_members(members.join(wanted, "name", "left_semi"), sizes=True)
    return read.select("archive", "name", "img_w", "img_h")


@query
def archive_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The nations' archives extracted to files, those of the manifests set against those that a listing finds."""
    root = new_folder(spark, "extracted")
    told = image_files.ingest(spark, root, _archives(spark, d))
    there = image_folder.list_images(spark, root, "s").select(F.col("rel_path").alias("stored"), F.col("bytes").alias("found"), F.col("img_w").alias("w"))
    both = told.join(there, "stored", "full")
    return both.select("source", "rel_path", "img_w", "img_h", (F.col("bytes") == F.col("found")).alias("whole"), (F.col("img_w") == F.col("w")).alias("listed"))


@query
def metrics_table(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the filter and channel means of every step, in one table."""
    table = metrics.MetricTable(spark, new_folder(spark, "metrics"), "sql")
    small = (F.col("x1") - F.col("x0") < 5) | (F.col("y1") - F.col("y0") < 5)
    counted = table.counted(fx.ui_frame(spark, d), elements=F.count("*"), small=F.count_if(small), widest=F.max("x1"))
    counted.write.format("noop").mode("overwrite").save()
    table.record()
    scored = scoring.score(fx.completions(spark, d)).withColumn("step", F.pmod("l_partkey", F.lit(16)))
    table.means(scoring.channel_means(scored, ["step"]), "step")
    return table.read().select("step", "name", F.round("value", 6).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reward_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _QUERIES}
