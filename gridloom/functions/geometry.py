"""Box geometry: letterbox, its inverse, clamping and crops.

Box arithmetic is in 32-bit floats, scales are doubles that are narrowed where they meet a box,
and crops are computed in doubles.  Every step is cast, since the engine widens some of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME = (1024, 768)
CORNERS = ("x0", "y0", "x1", "y1")


def f32(x: Column) -> Column:
    return x.cast("float")


def clamp(x: Column, low: Column, high: Column) -> Column:
    """``x`` held to [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def letterbox(width: Column, height: Column, target: tuple[int, int] = FRAME) -> Column:
    """Scale, left and top padding and content size that fit an image into the target, centred."""
    w, h = width.cast("double"), height.cast("double")
    tw, th = F.lit(target[0]), F.lit(target[1])
    scale = F.least(F.lit(float(target[0])) / w, F.lit(float(target[1])) / h)
    content_w = F.least(tw, F.bround(w * scale).cast("int"))
    content_h = F.least(th, F.bround(h * scale).cast("int"))
    fields = F.struct(
        scale.alias("scale"),
        F.floor((tw - content_w) / 2).cast("int").alias("pad_x"),
        F.floor((th - content_h) / 2).cast("int").alias("pad_y"),
        content_w.alias("content_w"),
        content_h.alias("content_h"),
        width.cast("int").alias("orig_w"),
        height.cast("int").alias("orig_h"),
    )
    bad = F.least(width, height, tw, th) <= 0
    return F.when(bad, F.raise_error(F.concat(F.lit("size that is not positive: "), width.cast("string"), F.lit("x"), height.cast("string")))).otherwise(fields)


def letterbox_box(box: Sequence[Column], params: Column) -> list[Column]:
    """Original to frame pixels, held to the content region."""
    out = []
    for i, x in enumerate(box):
        pad = f32(params["pad_x"] if i % 2 == 0 else params["pad_y"])
        size = f32(params["content_w"] if i % 2 == 0 else params["content_h"])
        out.append(clamp(f32(f32(f32(x) * f32(params["scale"])) + pad), pad, f32(pad + size)))
    return out


def unletterbox_box(box: Sequence[Column], params: Column) -> list[Column]:
    """Frame to original pixels, held to the image."""
    out = []
    for i, x in enumerate(box):
        pad = f32(params["pad_x"] if i % 2 == 0 else params["pad_y"])
        size = f32(params["orig_w"] if i % 2 == 0 else params["orig_h"])
        out.append(clamp(f32(f32(f32(x) - pad) / f32(params["scale"])), f32(F.lit(0)), size))
    return out


def clamp_to_frame(box: Sequence[Column], target: tuple[int, int] = FRAME) -> list[Column]:
    return [clamp(f32(x), f32(F.lit(0)), f32(F.lit(target[i % 2]))) for i, x in enumerate(box)]


def crop_box(box: Sequence[Column], margin: float = 0.15, target: tuple[int, int] = FRAME) -> Column:
    """Integer crop around a box, widened by ``margin`` of its size on each side, held to the frame."""
    x0, y0, x1, y1 = (x.cast("double") for x in box)
    wide, high = (x1 - x0) * F.lit(margin), (y1 - y0) * F.lit(margin)
    cx0 = F.greatest(F.lit(0).cast("bigint"), F.floor(x0 - wide))
    cy0 = F.greatest(F.lit(0).cast("bigint"), F.floor(y0 - high))
    cx1 = F.least(F.lit(target[0]).cast("bigint"), F.ceil(x1 + wide))
    cy1 = F.least(F.lit(target[1]).cast("bigint"), F.ceil(y1 + high))
    crop = F.struct(*[c.cast("int").alias(n) for c, n in zip((cx0, cy0, cx1, cy1), CORNERS, strict=True)])
    return F.when((cx1 - cx0 < 1) | (cy1 - cy0 < 1), F.raise_error(F.lit("crop without area"))).otherwise(crop)


def project_box(box: Sequence[Column], crop: Column, params: Column) -> list[Column]:
    """A box in zoom coordinates back in frame coordinates."""
    local = unletterbox_box(box, params)
    return [f32(x + f32(crop["x0"] if i % 2 == 0 else crop["y0"])) for i, x in enumerate(local)]
