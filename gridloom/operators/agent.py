"""Two-pass grounding: a coarse box, a zoomed crop, a refined box projected back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import CORNERS, FRAME, clamp_to_frame, crop_box, letterbox, project_box
from gridloom.functions.plan import fenced
from gridloom.functions.text import BOX, SPACE, parse_box
from gridloom.operators.pixels import zoomed_bytes
from gridloom.sources.interim import written

MIN_EXTENT = 4.0
#: Adds a column of completions: (rows, name of the query column, name of the new column) -> rows.
#: Rows whose query is null are not asked for and get null.
Predictor = Callable[[DataFrame, str, str], DataFrame]


def recorded(column: str) -> Predictor:
    """A predictor that replays completions already in the table."""
    return lambda df, query, name: df.withColumn(name, F.when(F.col(query).isNotNull(), F.col(column)))


def batched(predict: Callable[[pd.DataFrame], Sequence[str]], columns: Sequence[str] = ()) -> Predictor:
    """A predictor that gives Arrow batches to ``predict``: rows with ``query`` and ``columns``, asked ones alone."""

    def add(df: DataFrame, query: str, name: str) -> DataFrame:
        @F.pandas_udf("string")
        def answer(rows: pd.DataFrame) -> pd.Series:
            asked = rows["query"].notna()
            out = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            if asked.any():
                out[asked] = list(predict(rows[asked]))
            return out

        return df.withColumn(name, answer(F.struct(F.col(query).alias("query"), *columns)))

    return add


def _corners(box: str) -> list[Column]:
    return [F.col(box)[c] for c in CORNERS]


def _box(corners: list[Column]) -> Column:
    return F.struct(*[x.alias(c) for x, c in zip(corners, CORNERS, strict=True)])


def macro_pass(df: DataFrame, completion: str, target: tuple[int, int] = FRAME) -> DataFrame:
    """Adds ``macro`` (held to the frame, null if nothing parsed) and ``zooms`` (large enough to zoom)."""
    df = fenced(df.withColumn("_parsed", parse_box(F.col(completion))), "_parsed")
    held = F.when(F.col("_parsed").isNotNull(), _box(clamp_to_frame(_corners("_parsed"), target)))
    df = fenced(df.withColumn("macro", held).drop("_parsed"), "macro")
    wide = F.col("macro.x1") - F.col("macro.x0") >= F.lit(MIN_EXTENT).cast("float")
    high = F.col("macro.y1") - F.col("macro.y0") >= F.lit(MIN_EXTENT).cast("float")
    return fenced(df.withColumn("zooms", F.coalesce(wide & high, F.lit(False))), "zooms")


def zoom_context(df: DataFrame, margin: float = 0.15, target: tuple[int, int] = FRAME) -> DataFrame:
    """Adds the crop around ``macro`` and its letterbox; null for rows that do not zoom."""
    df = fenced(df.withColumn("crop", F.when(F.col("zooms"), crop_box(_corners("macro"), margin, target))), "crop")
    size = F.col("crop.x1") - F.col("crop.x0"), F.col("crop.y1") - F.col("crop.y0")
    return fenced(df.withColumn("zoom", F.when(F.col("crop").isNotNull(), letterbox(*size, target))), "zoom")


def zoom_verify(df: DataFrame, macro: Predictor, micro: Predictor, margin: float = 0.15, target: tuple[int, int] = FRAME, query: str = "query") -> DataFrame:
    """Adds ``result`` and ``path``: miss, too_small, macro_fallback or refined.

    One pass over the rows; the second prediction is asked only for those that zoom.
    """
    rows = macro_pass(macro(df, query, "_macro_text"), "_macro_text", target).drop("_macro_text")
    rows = zoom_context(rows, margin, target).withColumn("_asked", F.when(F.col("zooms"), F.coalesce(F.col(query), F.lit(""))))
    return _refined(micro(rows, "_asked", "_micro_text")).drop("_asked")


def _refined(rows: DataFrame) -> DataFrame:
    """``result`` and ``path`` from the answers to the zoom, whose helper columns are dropped."""
    rows = fenced(rows.withColumn("_micro", F.when(F.col("zooms"), parse_box(F.col("_micro_text")))), "_micro")
    refined = F.col("_micro").isNotNull()
    projected = F.when(refined, _box(project_box(_corners("_micro"), F.col("crop"), F.col("zoom"))))
    path = F.when(refined, "refined").when(F.col("zooms"), "macro_fallback").when(F.col("macro").isNull(), "miss").otherwise("too_small")
    rows = rows.withColumns({"result": F.coalesce(projected, F.col("macro")), "path": path})
    return rows.drop("_micro_text", "_micro", "crop", "zoom", "zooms")


#: A model: images (n, height, width, 3) of bytes and n queries to n completions.
Model = Callable[[np.ndarray, Sequence[str]], Sequence[str | None]]


@dataclass(frozen=True)
class PixelPredictor:
    """A model that sees pixels.  ``load`` is called once by each Python worker, which keeps what it gives by ``name``."""

    name: str
    load: Callable[[], Model]
    #: Images handed to the model at once.
    batch: int = 16
    #: Questions about an image that are asked together; more go to other tasks with a copy of the image.
    together: int = 64


_MODELS: dict[str, Model] = {}


def _model(predictor: PixelPredictor) -> Model:
    if predictor.name not in _MODELS:
        _MODELS[predictor.name] = predictor.load()
    return _MODELS[predictor.name]


def _hot(asks: DataFrame, together: int) -> DataFrame | None:
    """image_path, _groups of the images that more than ``together`` questions are about; None without any."""
    counts = asks.groupBy("image_path").agg(F.ceil(F.count("*") / together).alias("_groups"))
    hot = written(counts.where("_groups > 1"), "agent_hot")
    return None if hot.isEmpty() else hot


def _met(asks: DataFrame, frames: DataFrame, together: int, decode: Callable[[Column], Column]) -> DataFrame:
    """image_path, _group, _row, query, pixels: every frame as a row without _row and query, followed by the questions about it.

    A frame travels to the questions about it, not a copy to each, and once, in the form in which it is
    stored: it is decoded where it has arrived, so neither a shuffle nor a sort holds pixels.  Questions
    about a hot image, more than ``together``, are in groups that are dealt to several tasks, and hot
    frames alone are copied.  Nothing is joined: frames and questions are one table, sorted inside its ranges.
    """
    asks, frames = asks.where("image_path IS NOT NULL"), frames.select("image_path", "pixels").where("image_path IS NOT NULL")
    hot = _hot(asks, together)
    if hot is None:
        asks, frames = (x.withColumn("_group", F.lit(0).cast("bigint")) for x in (asks, frames))
    else:
        groups = F.coalesce("_groups", F.lit(1).cast("bigint"))
        asks, frames = (x.join(hot, "image_path", "left") for x in (asks, frames))
        asks = asks.withColumn("_group", F.pmod(F.xxhash64("_row"), groups)).drop("_groups")
        frames = frames.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1))).drop("_groups")
    met = asks.unionByName(frames, allowMissingColumns=True).repartition("image_path", "_group").sortWithinPartitions("image_path", "_group", F.asc_nulls_first("_row"))
    return met.withColumn("pixels", F.when(F.col("_row").isNull(), decode(F.col("pixels"))))


def _answers(predictor: PixelPredictor, images: np.ndarray, which: np.ndarray, queries: list[str]) -> list[str | None]:
    """What the model says to every query about ``images[which]``, handed to it in batches."""
    model, out = _model(predictor), []
    for at in range(0, len(queries), predictor.batch):
        part = queries[at : at + predictor.batch]
        said = list(model(images[which[at : at + predictor.batch]], part))
        if len(said) != len(part):
            raise ValueError(f"the model answered {len(said)} of {len(part)} questions")
        out += said
    return out


# Between the two passes over a frame no row leaves its task, so boxes are read and placed in arrays here.
# The arithmetic is that of the expressions in macro_pass, zoom_context and _refined, step by step.

#: The first box of a text, its numbers named; spaces are spelled out for Arrow, whose \s lacks one of them.
_FOUND = BOX.replace(SPACE, r"[\s\x0b\x1c-\x1f\x85\p{Z}]")
for _name in CORNERS:
    _FOUND = _FOUND.replace("(-?", f"(?P<{_name}>-?", 1)


def _parsed(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """First boxes of texts (n, 4) and whether there is one; :func:`parse_box` of a list."""
    found = pc.extract_regex(pa.array(texts, pa.string()), _FOUND)
    parts = [found.field(i) for i in range(4)]
    there = found.is_valid().to_numpy(zero_copy_only=False)
    try:
        numbers = [pc.if_else(found.is_valid(), p, "0").cast(pa.float64()).to_numpy() for p in parts]
    except pa.ArrowInvalid:  # a number beyond doubles
        numbers = [[float(x) if ok else 0.0 for x, ok in zip(p.to_pylist(), there, strict=True)] for p in parts]
    with np.errstate(over="ignore"):
        return np.stack(numbers, axis=1).astype(np.float32), there


def _held(x: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``x`` held to [0, high]; a negative zero stays one, as in Spark."""
    x = np.where(x < 0, np.float32(0), x)
    return np.where(x > high, high, x)


def _crops(box: np.ndarray, margin: float, target: tuple[int, int]) -> np.ndarray:
    """Integer crops (n, 4) around boxes; :func:`crop_box` of an array."""
    box = box.astype(np.float64)
    around = (box[:, 2:] - box[:, :2]) * margin
    low, high = np.floor(box[:, :2] - around), np.ceil(box[:, 2:] + around)
    crop = np.concatenate([np.maximum(low, 0), np.minimum(high, target)], axis=1).astype(np.int64)
    if (crop[:, 2:] - crop[:, :2] < 1).any():
        raise ValueError("crop without area")
    return crop


def _projected(box: np.ndarray, crop: np.ndarray, target: tuple[int, int]) -> np.ndarray:
    """Boxes in the zooms of ``crop`` back in their frames; :func:`project_box` of arrays."""
    size = crop[:, 2:] - crop[:, :2]
    scale = (np.array(target, np.float64) / size).min(axis=1, keepdims=True)
    content = np.minimum(np.array(target), np.rint(size * scale).astype(np.int64))
    pad = np.tile((np.array(target) - content) // 2, 2).astype(np.float32)
    local = ((box - pad).astype(np.float64) / scale.astype(np.float32)).astype(np.float32)
    return _held(local, np.tile(size, 2).astype(np.float32)) + np.tile(crop[:, :2], 2).astype(np.float32)


#: Bytes of the images of questions that are answered before others are zoomed.
HELD = 1 << 24
PATHS = pa.array(["miss", "too_small", "macro_fallback", "refined"])
ANSWERED = "_row bigint, macro struct<x0: float, y0: float, x1: float, y1: float>, result struct<x0: float, y0: float, x1: float, y1: float>, path string"


def _boxes(corners: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(corners[:, i])) for i in range(4)], list(CORNERS), mask=pa.array(~there))


def _two_passes(predictor: PixelPredictor, frames: np.ndarray, which: np.ndarray, rows: np.ndarray, queries: list[str], margin: float, fill: float) -> pa.RecordBatch:
    """Answers to queries about ``frames[which]``, first about the frames and then about the zooms into them."""
    target = frames.shape[2], frames.shape[1]
    macro, there = _parsed(_answers(predictor, frames, which, queries))
    macro = _held(macro, np.array(target * 2, np.float32))
    zooms = np.flatnonzero(there & (macro[:, 2:] - macro[:, :2] >= np.float32(MIN_EXTENT)).all(axis=1))
    crop = _crops(macro[zooms], margin, target)
    # Questions that zoom into the same place of a frame see the same image.
    place = which[zooms]
    for i, size in enumerate((*target, *target)):
        place = place * (size + 1) + crop[:, i]
    _, one, same = np.unique(place, return_index=True, return_inverse=True)
    images = zoomed_bytes(frames, which[zooms[one]], crop[one], fill)
    micro, refined = _parsed(_answers(predictor, images, same, [queries[i] for i in zooms]))
    result, path = macro.copy(), there.astype(np.int64)
    path[zooms] = np.where(refined, 3, 2)
    result[zooms[refined]] = _projected(micro[refined], crop[refined], target)
    return pa.RecordBatch.from_arrays([pa.array(rows), _boxes(macro, there), _boxes(result, there), PATHS.take(pa.array(path))], names=["_row", "macro", "result", "path"])


def _framed(pixels: pa.Array, at: np.ndarray, target: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Frames (n, height, width, 3) at ``at``, and their sizes in bytes; one of another size than a frame's is left black."""
    offsets = np.frombuffer(pixels.buffers()[1], np.int64 if pa.types.is_large_binary(pixels.type) else np.int32)[pixels.offset : pixels.offset + len(pixels) + 1]
    sizes, wanted = np.diff(offsets)[at], target[0] * target[1] * 3
    shape = len(at), target[1], target[0], 3
    if not len(at):
        return np.zeros(shape, np.uint8), sizes
    data = np.frombuffer(pixels.buffers()[2] or b"", np.uint8)
    if (sizes == wanted).all() and offsets[-1] - offsets[0] == wanted * len(at):
        return data[offsets[0] : offsets[-1]].reshape(shape), sizes
    out = np.zeros(shape, np.uint8)
    for i in np.flatnonzero(sizes == wanted):
        out[i] = data[offsets[at[i]] : offsets[at[i]] + wanted].reshape(shape[1:])
    return out, sizes


def _answered(met: DataFrame, predictor: PixelPredictor, margin: float, target: tuple[int, int], fill: float) -> DataFrame:
    """_row, macro, result, path of the questions in :func:`_met` that have a frame, one for each frame of their image."""
    wanted = target[0] * target[1] * 3
    together = max(predictor.batch, HELD // wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, frames, sizes = None, np.zeros((0, target[1], target[0], 3), np.uint8), np.zeros(0, np.int64)  # of the last image, whose questions may go on in the next batch
        for batch in batches:
            key, row, pixels = batch.select(["image_path", "_group"]), batch.column("_row"), batch.column("pixels")
            is_frame, is_ask = (x.is_valid().to_numpy(zero_copy_only=False) for x in (pixels, row))
            at, asks = np.flatnonzero(is_frame), np.flatnonzero(is_ask)
            before = len(frames)
            new, new_sizes = _framed(pixels, at, target)
            frames, sizes = (np.concatenate([frames, new]), np.concatenate([sizes, new_sizes])) if before else (new, new_sizes)
            mine = key.take(pa.array(at))
            keys = pa.concat_batches([keys, mine]) if keys is not None else mine
            if not len(frames):
                continue
            n = np.arange(len(frames))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~_alike(keys.slice(1), keys.slice(0, len(n) - 1))]), n, 0))
            last = (np.cumsum(is_frame) - 1)[asks] + before
            met = (last >= 0) & _alike(key.take(pa.array(asks)), keys.take(pa.array(np.maximum(last, 0))))
            asks, last = asks[met], last[met]
            many = last - start[last] + 1  # frames of one image are seen one by one
            which = np.repeat(last, many) - (np.cumsum(many).repeat(many) - 1 - np.arange(many.sum()))
            asks = np.repeat(asks, many)
            wrong = sizes[which] != wanted
            if wrong.any():
                raise ValueError(f"expected a frame of {target}, got {sizes[which[wrong][0]]} bytes")
            rows, queries = row.fill_null(0).to_numpy()[asks], batch.column("query").take(pa.array(asks)).to_pylist()
            for i in range(0, len(asks), together):
                part = slice(i, i + together)
                yield _two_passes(predictor, frames, which[part], rows[part], queries[part], margin, fill)
            frames, sizes, keys = frames[start[-1] :].copy(), sizes[start[-1] :], keys.slice(start[-1])

    return met.select("image_path", "_group", "_row", "query", "pixels").mapInArrow(run, ANSWERED)


def _alike(a: pa.RecordBatch, b: pa.RecordBatch) -> np.ndarray:
    """Whether rows of the same place are equal; none is null."""
    return np.logical_and.reduce([pc.equal(x, y).to_numpy(zero_copy_only=False) for x, y in zip(a.columns, b.columns, strict=True)])


def zoom_verify_pixels(
    rows: DataFrame,
    frames: DataFrame,
    predictor: PixelPredictor,
    margin: float = 0.15,
    target: tuple[int, int] = FRAME,
    fill: float = 0.0,
    query: str = "query",
    image: str = "image_path",
    decode: Callable[[Column], Column] = lambda stored: stored,
) -> DataFrame:
    """Adds ``macro``, ``result`` and ``path`` to rows (image, query, ...) by a model that sees their frames.

    The model is asked about the whole frame first, then, for boxes large enough, about the crop around
    its answer, zoomed to the frame's size; what it says there is projected back.  A frame is moved once
    for both, as ``pixels`` of ``frames`` has it, and ``decode`` makes its bytes of that where it is seen; it comes by
    in front of its questions, and both passes are made there.  Rows are written when they are numbered and
    answers when they are in, so no question is put twice.  A null query is not asked, and a row without a frame
    gets no answer: both are misses.
    """
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "agent_rows")
    asks = numbered.where(F.col(query).isNotNull()).select("_row", F.col(image).alias("image_path"), F.col(query).alias("query"))
    answers = _answered(_met(asks, frames, predictor.together, decode), predictor, margin, target, fill)
    told = numbered.join(written(answers, "agent_answers"), "_row", "left")
    return told.withColumn("path", F.coalesce("path", F.lit("miss"))).drop("_row")
