"""Composite plans: both corpora to training and evaluation rows, and the scoring summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridloom.config import Config
from gridloom.functions.scoring import channel_means, score
from gridloom.operators import cells, elements, order
from gridloom.operators.encode import collate, grpo_rows, pad_batches, sft_rows, with_frame_boxes
from gridloom.sources.interim import written

MODES = ("sft", "grpo")
HOLDOUTS = ("row", "image")


def ui_frame(entries: DataFrame, index: DataFrame, sizes: DataFrame, config: Config = Config()) -> DataFrame:
    """Element frame of annotation entries (source, entry) with their images and image sizes."""
    found = elements.lookup_images(elements.flatten_elements(entries), index)
    sized = found.where(elements.is_wellformed()).join(sizes, ["source", "rel_path"])
    return elements.records_to_frame(sized.withColumn("img_filename", F.col("rel_path")), config.ui.bbox_format)


def cell_frame(pages: DataFrame, key: str, config: Config = Config()) -> DataFrame:
    """Element frame of the pages of the configured category, images named by page ordinal."""
    kept = cells.pages_of_category(pages, config.cells.doc_category)
    return cells.cell_frame(order.ordinal_by(kept, key, "page_ordinal"))


def build(
    ui: DataFrame, ui_keys: Sequence[str], cell: DataFrame | None, cell_keys: Sequence[str], config: Config = Config(), mode: str = "sft", tokenize: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(training rows, evaluation rows or None): filter, shuffle, split, mix, encode.

    Evaluation rows are held out of the UI corpus alone, row by row or by whole screenshots, and only in
    mode sft, where a tokenizer adds ids, masks and labels.  Training rows of a mixture carry their position in it as ``pos``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if len(config.mix_ratio) != 2:
        raise ValueError("mix_ratio needs two weights")
    if config.holdout_by not in HOLDOUTS:
        raise ValueError(f"holdout_by must be one of {HOLDOUTS}, got {config.holdout_by!r}")
    a = elements.filter_frame(ui, config.ui.min_box_px, config.ui.min_query_chars)
    placed, n = order.counted_shuffle(a, ui_keys, config.seed)
    by_image = config.holdout_by == "image"
    if by_image:
        train, held = order.split_groups(placed, "image_path", config.holdout_fraction, config.seed)
    else:
        first = order.holdout_size(n, config.holdout_fraction)
        train, held = placed.where(F.col("pos") >= first), placed.where(F.col("pos") < first)
    encode = partial(sft_rows, tokenize=tokenize) if mode == "sft" else grpo_rows
    encoded = lambda rows: encode(with_frame_boxes(rows, config.target_size))
    held = encoded(held) if mode == "sft" else None
    if config.mix_ratio[1] <= 0 or cell is None:
        return encoded(train.drop("pos")), held
    # Cells of a page are taken apart once; the bounds of their order are sampled from what is kept.
    b = written(elements.filter_frame(cell, config.cells.min_box_px, config.cells.min_query_chars, config.cells.max_query_chars), "cells")
    # Positions name the rows of a child, so rows that repeat each other stay apart.
    keyed = train.select(F.col("pos").alias("row_key"), *elements.FRAME_COLUMNS)
    # Without its first positions a child is still numbered; without whole images it has gaps.
    ui_child, ui_count = order.numbered(keyed, ["row_key"], "_nth") if by_image else (keyed.withColumn("_nth", F.col("row_key") - first), n - first)
    placed_cells, cell_count = order.numbered(b, cell_keys, "row_key")
    cell_child = placed_cells.select("row_key", *elements.FRAME_COLUMNS).withColumn("_nth", F.col("row_key"))
    # Encoded before they are mixed, so a row that is repeated is encoded once.
    return order.mixed_numbered([(encoded(ui_child), ui_count), (encoded(cell_child), cell_count)], config.mix_ratio, config.seed), held


def batches(train: DataFrame, size: int, window: int = 256, ranks: int = 1, seed: int = 0, pad_id: int = 0) -> DataFrame:
    """Collated batches of tokenized training rows: batch_id, rank, step, positions, the padded streams and ``padding``, the ids added."""
    rows = order.batched(train, F.size("input_ids"), size, window, ranks, seed).withColumn("_ids", F.size("input_ids"))
    padded = pad_batches(rows, pad_id=pad_id)
    told = padded.groupBy("batch_id").agg(
        F.first("rank").alias("rank"), F.first("step").alias("step"), F.sum(F.col("length") - F.col("_ids")).alias("padding"), F.sort_array(F.collect_list("pos")).alias("positions")
    )
    return collate(padded, order="pos").join(told, "batch_id")


def reward_summary(rows: DataFrame, config: Config = Config(), keys: Sequence[str] = ()) -> DataFrame:
    """Channel means of completions against their targets."""
    return channel_means(score(rows, config.reward), keys)


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds its counters once an action has run over it."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def group_advantage(reward: Column, prompt: str) -> tuple[Column, Column]:
    """Mean and deviation of a reward over the completions of one prompt."""
    group = Window.partitionBy(prompt)
    return F.avg(reward).over(group), F.stddev_samp(reward).over(group)
