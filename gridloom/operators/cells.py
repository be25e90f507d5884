"""Corpus B: document pages to the element frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import clamp
from gridloom.functions.plan import fenced
from gridloom.functions.text import strip

SLACK = 1.05


def pages_of_category(pages: DataFrame, category: str) -> DataFrame:
    """Pages of one category; the predicate reaches the scan through the struct."""
    return pages.where(F.col("metadata.doc_category") == category)


def pages_where(pages: DataFrame, predicate: Callable[..., bool], columns: Sequence[str]) -> DataFrame:
    """Pages for which a Python predicate of the named columns (struct fields too) is true.

    Only those columns reach Python, in Arrow batches; where a Column expression can say the same,
    :meth:`DataFrame.where` prunes the scan as well.
    """

    @F.pandas_udf("boolean")
    def holds(*values: pd.Series) -> pd.Series:
        return pd.Series([bool(predicate(*row)) for row in zip(*values, strict=True)], index=values[0].index)

    return pages.where(holds(*columns))


def flat_cells(cells: str = "pdf_cells") -> Column:
    """All cells of a page's regions; null regions have none."""
    return F.flatten(F.transform(F.coalesce(F.col(cells), F.array()), lambda r: F.coalesce(r, F.array())))


def page_scale(pages: DataFrame) -> DataFrame:
    """Pages with their flat cells, extents, and the scale onto the page where cells overflow it.

    The extents are those of all cells, blank ones included.  Both axes are scaled when either
    overflows by more than the slack and the page's original width is known.
    """
    df = pages.withColumn("cells", flat_cells())
    width, height = (F.col(f"metadata.coco_{s}").cast("int") for s in ("width", "height"))
    df = df.withColumns(
        {
            "page_w": width,
            "page_h": height,
            "max_x": F.array_max(F.transform("cells", lambda c: F.get(c["bbox"], F.lit(0)) + F.get(c["bbox"], F.lit(2)))),
            "max_y": F.array_max(F.transform("cells", lambda c: F.get(c["bbox"], F.lit(1)) + F.get(c["bbox"], F.lit(3)))),
        }
    )
    over = (F.col("max_x") > F.col("page_w") * F.lit(SLACK)) | (F.col("max_y") > F.col("page_h") * F.lit(SLACK))
    known = F.col("metadata.original_width").isNotNull() & (F.col("metadata.original_width") != 0)
    df = df.withColumn("rescaled", F.coalesce(over & known, F.lit(False)))

    def scale(size: str, original: str) -> Column:
        value = F.col(f"metadata.{original}").cast("double")
        checked = F.when(value.isNull() | (value == 0), F.raise_error(F.lit(f"{original} is missing on a page to rescale"))).otherwise(value)
        return F.when(F.col("rescaled"), F.col(size).cast("double") / checked).otherwise(F.lit(1.0))

    return df.withColumns({"scale_x": scale("page_w", "original_width"), "scale_y": scale("page_h", "original_height")})


def rescaled_pages(pages: DataFrame) -> DataFrame:
    """How many pages are rescaled, of how many."""
    return page_scale(pages).agg(F.count_if("rescaled").alias("rescaled"), F.count("*").alias("pages"))


def cell_frame(pages: DataFrame, ordinal: str = "page_ordinal") -> DataFrame:
    """Element frame of the cells with text, stripped; ``ordinal`` names the page's image."""
    cell = page_scale(pages).select(ordinal, "page_w", "page_h", "scale_x", "scale_y", F.explode("cells").alias("cell"))
    # Filters of the text read it several times; it is stripped once, not in each of them.
    cell = fenced(cell.withColumn("query", strip(F.coalesce("cell.text", F.lit("")))), "query").where(F.col("query") != "")
    x, y, w, h = (F.get("cell.bbox", F.lit(i)).cast("double") for i in range(4))
    wide, high = F.col("page_w").cast("double"), F.col("page_h").cast("double")
    zero = F.lit(0.0)
    return cell.select(
        F.col(ordinal).cast("string").alias("image_path"),
        "query",
        clamp(x * F.col("scale_x"), zero, wide).alias("x0"),
        clamp(y * F.col("scale_y"), zero, high).alias("y0"),
        clamp((x + w) * F.col("scale_x"), zero, wide).alias("x1"),
        clamp((y + h) * F.col("scale_y"), zero, high).alias("y1"),
        F.col("page_w").alias("img_w"),
        F.col("page_h").alias("img_h"),
    )


def page_images(frame: DataFrame, pages: DataFrame, ordinal: str = "page_ordinal") -> DataFrame:
    """Cells with their page's image, by ordinal."""
    return frame.join(pages.select(F.col(ordinal).cast("string").alias("image_path"), "image"), "image_path")
