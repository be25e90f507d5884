"""Model-ready rows: letterboxed boxes, SFT and GRPO rows, label masks and padded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import CORNERS, FRAME, letterbox, letterbox_box
from gridloom.functions.plan import fenced
from gridloom.functions.text import BOX_FORMAT, PROMPT_TEMPLATE, chat_messages, render_answer, render_prompt
from gridloom.operators.pixels import framed_images

IGNORE = -100


def with_frame_boxes(frame: DataFrame, target: tuple[int, int] = FRAME) -> DataFrame:
    """The element frame with its letterbox parameters and boxes in frame pixels (x0_f ..)."""
    df = fenced(frame.withColumn("params", letterbox(F.col("img_w"), F.col("img_h"), target)), "params")
    boxes = dict(zip([f"{c}_f" for c in CORNERS], letterbox_box([F.col(c) for c in CORNERS], F.col("params")), strict=True))
    return fenced(df.withColumns(boxes), *boxes)


def sft_rows(
    framed: DataFrame,
    prompt_template: str = PROMPT_TEMPLATE,
    box_format: str = BOX_FORMAT,
    include_answer: bool = True,
    tokenize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Messages of each row; with a tokenizer also input_ids, attention_mask and masked labels."""
    prompt = render_prompt(F.col("query"), prompt_template)
    answer = render_answer(*[F.col(f"{c}_f") for c in CORNERS], box_format) if include_answer else None
    df = framed.withColumns({"prompt": prompt, "messages": chat_messages(prompt, answer)})
    df = df.withColumn("answer", answer if answer is not None else F.lit(None).cast("string"))
    if tokenize is None:
        return df
    text = F.concat_ws(" ", "prompt", "answer")
    df = df.withColumns({"input_ids": tokenize(text), "prompt_ids": tokenize(F.col("prompt"))})
    df = df.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1).cast("bigint")))
    if include_answer:
        df = df.withColumn("labels", mask_prompt(F.col("input_ids"), F.size("prompt_ids")))
    return df.drop("prompt_ids")


def grpo_rows(framed: DataFrame, prompt_template: str = PROMPT_TEMPLATE) -> DataFrame:
    """prompt (a user message) and target_bbox in frame pixels; other columns stay for the scorers."""
    message = F.struct(F.lit("user").alias("role"), render_prompt(F.col("query"), prompt_template).alias("content"))
    return framed.withColumns({"prompt": F.array(message), "target_bbox": F.array(*[F.col(f"{c}_f") for c in CORNERS])})


def squeezed(df: DataFrame, *streams: str) -> DataFrame:
    """``df`` with the only row of each stream that a processor returned as a batch of one."""
    return df.withColumns({c: F.get(c, F.lit(0)) for c in streams})


def mask_prompt(ids: Column, prompt_length: Column) -> Column:
    """Labels: the ids with the prompt's places ignored."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(IGNORE).cast("bigint")).otherwise(x))


def with_pixels(rows: DataFrame, images: DataFrame, target: tuple[int, int] = FRAME, fill: float = 0.0) -> DataFrame:
    """Rows (image_path, ...) with their image in frame pixels, RGB bytes by row, beside their boxes.

    ``images`` has image_path and content.  Every image is decoded and scaled once, not once a row.
    Pixels are merged and never broadcast: a planner's estimate follows from the images' files, or
    less, and all frames would be held by the driver and by every executor.
    """
    named = images.select(F.col("image_path").alias("id"), "content")
    framed = framed_images(named, target, fill).select(F.col("id").alias("image_path"), "pixels")
    return rows.join(framed.hint("merge"), "image_path")


def pad_right(values: Column, length: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill).cast("bigint"), (length - F.size(values)).cast("int")))


def pad_batches(items: DataFrame, batch: str = "batch_id", pad_id: int = 0) -> DataFrame:
    """Items (input_ids, attention_mask, labels, perhaps mm_token_type_ids) padded to their batch's length."""
    df = items.withColumn("length", F.max(F.size("input_ids")).over(Window.partitionBy(batch)))
    fills = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE}
    out = {c: pad_right(F.col(c), F.col("length"), fill) for c, fill in fills.items()}
    if "mm_token_type_ids" in items.columns:
        none = F.array().cast("array<bigint>")
        out["mm_token_type_ids"] = pad_right(F.coalesce("mm_token_type_ids", none), F.col("length"), 0)
    return df.withColumns(out).drop("bbox")


def collate(padded: DataFrame, batch: str = "batch_id", order: str = "item") -> DataFrame:
    """One row per batch: its items in order, their pixel rows one after the other."""
    columns = [c for c in ("input_ids", "attention_mask", "labels", "mm_token_type_ids", "pixel_values", "image_grid_thw") if c in padded.columns]
    listed = F.array_sort(F.collect_list(F.struct(order, *columns)))
    df = padded.groupBy(batch).agg(listed.alias("_items"))
    flat, pick = ("pixel_values", "image_grid_thw"), {}
    for c in columns:
        values = F.col(f"_items.{c}")
        pick[c] = F.flatten(values) if c in flat else values
    return df.withColumns(pick).drop("_items")
