"""Pixel operators: decode, letterbox and crop.  The only numpy code on images."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.functions.geometry import FRAME


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Bytes (H, W, C) of filtered lines; ``kinds`` has the filter of each line.

    A pixel depends on those to its left and above, so pixels are done by diagonals, a diagonal at once.
    """
    height, width, channels = lines.shape
    if not kinds.any():
        return lines
    out = np.zeros((height + 1, width + 1, channels), np.int32)  # with an empty line above and an empty column before
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + above - corner
        near = [np.abs(guess - v) for v in (left, above, corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], above, corner))
        kind = kinds[y][:, None]
        predicted = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, paeth], 0)
        out[y + 1, x + 1] = (lines[y, x] + predicted) & 255
    return out[1:, 1:]


def decode_png(content: bytes) -> np.ndarray:
    """RGB bytes (H, W, 3) of an 8-bit PNG without interlacing: grey, RGB, palette, with or without alpha."""
    at, data, palette = 8, b"", None
    width = height = kind = 0
    while at < len(content):
        size, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            depth, kind, interlace = body[8], body[9], body[12]
            if depth != 8 or interlace:
                raise ValueError("only 8-bit PNGs without interlacing")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, stride + 1)
    out = _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, channels))
    pixels = out.reshape(height, width, channels).astype(np.uint8)
    if kind == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else pixels[..., :3]


def rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """RGB bytes (H, W, 3) of a row of Spark's image source: grey, BGR or BGRA."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., 2::-1]


def read_framed(spark, path: str, target: tuple[int, int] = FRAME, fill: float = 0.0) -> DataFrame:
    """origin, width, height, pixels of the images below ``path`` that the JVM can decode, letterboxed."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = rgb(row["data"], row["width"], row["height"], row["nChannels"]).astype(np.float64) / 255.0
                raw = to_bytes(letterbox_pixels(image, target, fill)).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["origin"]]), pa.array([target[0]], pa.int32()), pa.array([target[1]], pa.int32()), pa.array([raw], pa.binary())],
                    names=["origin", "width", "height", "pixels"],
                )

    return images.mapInArrow(run, "origin string, width int, height int, pixels binary")


#: Numbers in a filter that is kept for the next image of its size: 512 filters of 64 kB at most.
KEPT = 1 << 13


def _filter(size: int, wanted: int) -> np.ndarray:
    scale = size / wanted
    reach = max(1.0, scale)
    centres = (np.arange(wanted) + 0.5) * scale
    weights = np.maximum(0.0, 1.0 - np.abs((np.arange(size)[None, :] + 0.5 - centres[:, None]) / reach))
    return weights / weights.sum(axis=1, keepdims=True)


_kept_filter = lru_cache(maxsize=512)(_filter)


def _weights(size: int, wanted: int) -> np.ndarray:
    """Rows of an antialiased linear filter that maps ``size`` samples to ``wanted``."""
    return _kept_filter(size, wanted) if size * wanted <= KEPT else _filter(size, wanted)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear with antialiasing, pixel centres at halves; (H, W, C) of floats."""
    high, wide, channels = image.shape
    rows = (_weights(high, height) @ image.reshape(high, -1)).reshape(height, wide, channels)
    return (_weights(wide, width) @ rows.transpose(1, 0, 2).reshape(wide, -1)).reshape(width, height, channels).transpose(1, 0, 2)


def to_bytes(image: np.ndarray) -> np.ndarray:
    """0..1 floats as bytes, rounded half to even."""
    scaled = np.minimum(np.maximum(image, 0.0), 1.0) * 255.0
    return np.rint(scaled).astype(np.uint8)


def _content(w: int, h: int, target: tuple[int, int]) -> tuple[int, int, int, int]:
    """Left, top, width and height of an image scaled into the middle of the target."""
    scale = min(target[0] / w, target[1] / h)
    cw, ch = min(target[0], round(w * scale)), min(target[1], round(h * scale))
    return (target[0] - cw) // 2, (target[1] - ch) // 2, cw, ch


def letterbox_pixels(image: np.ndarray, target: tuple[int, int] = FRAME, fill: float = 0.0) -> np.ndarray:
    """An image (H, W, 3) of 0..1 floats, scaled to fit and padded to the target."""
    x, y, cw, ch = _content(*image.shape[1::-1], target)
    out = np.full((target[1], target[0], image.shape[2]), fill, dtype=np.float64)
    out[y : y + ch, x : x + cw] = resize(image, cw, ch)
    return out


def letterbox_bytes(image: np.ndarray, target: tuple[int, int] = FRAME, fill: float = 0.0) -> np.ndarray:
    """:func:`to_bytes` of :func:`letterbox_pixels`, of an image of 0..255 bytes; the padding is not computed with."""
    return zoomed_bytes(image[None], np.zeros(1, np.int64), np.array([[0, 0, *image.shape[1::-1]]]), fill, target)[0]


def _turned(images: np.ndarray) -> np.ndarray:
    """Images (n, a, b, channels) as (n, b, a, channels); whole pixels are moved, not their channels."""
    n, a, b, channels = images.shape
    pixels = images.view(np.dtype((np.void, images.itemsize * channels))).reshape(n, a, b)
    return np.ascontiguousarray(pixels.transpose(0, 2, 1)).view(images.dtype).reshape(n, b, a, channels)


#: Numbers of enlarged images that are computed with at a time.
ENLARGED = 1 << 17


def zoomed_bytes(frames: np.ndarray, which: np.ndarray, crops: np.ndarray, fill: float = 0.0, target: tuple[int, int] | None = None) -> np.ndarray:
    """Parts x0, y0, x1, y1 of ``frames[which]``, each letterboxed, to the frames' size if no other is given.

    Parts of one size are computed together; every image is what it would be alone.
    """
    width, high = target or frames.shape[2:0:-1]
    channels = frames.shape[3]
    out = np.full((len(which), high, width, channels), to_bytes(np.float64(fill)), np.uint8)
    sizes, kind = np.unique(crops[:, 2:] - crops[:, :2], axis=0, return_inverse=True)
    for k, (w, h) in enumerate(sizes.tolist()):
        x, y, cw, ch = _content(w, h, (width, high))
        down, across = _weights(h, ch), _weights(w, cw)
        places = np.flatnonzero(kind.reshape(-1) == k)
        step = max(1, ENLARGED // (cw * ch * channels))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            images = np.empty((len(some), h, w, channels), np.uint8)
            for image, f, (x0, y0, x1, y1) in zip(images, which[some].tolist(), crops[some].tolist(), strict=True):
                image[...] = frames[f, y0:y1, x0:x1]
            rows = down @ (images / 255.0).reshape(len(some), h, -1)
            # Averages of 0..1 with weights of sum 1: at most an ulp outside, which rounds to the same bytes.
            full = across @ _turned(rows.reshape(len(some), ch, w, channels)).reshape(len(some), w, -1)
            full *= 255.0
            np.rint(full, out=full)
            out[some, y : y + ch, x : x + cw] = _turned(full.astype(np.uint8).reshape(len(some), cw, ch, channels))
    return out


def framed_images(images: DataFrame, target: tuple[int, int] = FRAME, fill: float = 0.0, crop: bool = False) -> DataFrame:
    """id, width, height, pixels (RGB bytes by row) of PNGs (id, content), letterboxed.

    With ``crop`` the rows also have x0, y0, x1, y1, the part of the frame-sized image to zoom into.
    A file that is no PNG of a kind that can be decoded has null pixels.
    """
    kind = images.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])
    columns = ["id", "content", *(["x0", "y0", "x1", "y1"] if crop else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    image = decode_png(row["content"]).astype(np.float64) / 255.0
                except (ValueError, KeyError, IndexError, TypeError, zlib.error):
                    yield pa.RecordBatch.from_pylist([{"id": row["id"]}], schema=schema)
                    continue
                if crop:
                    if image.shape[1::-1] != tuple(target):
                        raise ValueError(f"expected a frame of {target}, got {image.shape[1::-1]}")
                    image = image[row["y0"] : row["y1"], row["x0"] : row["x1"]]
                raw = to_bytes(letterbox_pixels(image, target, fill)).tobytes()
                yield pa.RecordBatch.from_pylist([{"id": row["id"], "width": target[0], "height": target[1], "pixels": raw}], schema=schema)

    return images.select(*columns).mapInArrow(run, f"id {kind.simpleString()}, width int, height int, pixels binary")
