"""The two-pass agent over pixels: frames travel as they are stored, and both passes are made where they arrive (F1)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import agent, pixels

TARGET = (32, 24)
SIZE = 32 * 24 * 3


class Replays:
    """Says what a query holds for the first pass, and when it is asked again what it holds for the second."""

    def __init__(self):
        self.asked = set()

    def __call__(self, images, queries):
        out = []
        for q in queries:
            _, *texts = q.split(";")
            out.append(texts[q in self.asked] or None)
            self.asked.add(q)
        return out


class Reads:
    """The box that follows from the colour in the middle."""

    def __call__(self, images, queries):
        return [f"<box>[{r}, {g}, {r + 9}, {g + 7}]</box>" for r, g, _ in images[:, 12, 16].tolist()]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("together", [64, 4])
def test_frames_travel_as_stored(spark, small_batches, together):
    """A frame is decoded after its last move, once unless its image is hot, and meets questions of later batches too."""
    decoded = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def decode(n):
        if n is not None:
            decoded.add(1)
            return bytes([n % 16, n % 12, 7]) * (SIZE // 3)

    frames = spark.range(30).select(F.concat(F.lit("i"), "id").alias("image_path"), F.col("id").alias("pixels"))
    rows = spark.range(420).select("id", F.concat(F.lit("i"), F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 40)).alias("image_path"), F.lit("q").alias("query"))
    plan = agent._met(rows.select(F.col("id").alias("_row"), "image_path", "query"), frames, 1000, decode)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("decode(") < plan.index("Sort [") < plan.index("RepartitionByExpression")
    got = agent.zoom_verify_pixels(rows, frames, agent.PixelPredictor("reads", Reads, together=together), target=TARGET, decode=decode).collect()
    assert sorted(r["id"] for r in got) == list(range(420))
    assert decoded.value == {64: 2 + 29, 4: 25 + 19 * 2 + 10 * 3}[together]
    for r in got:
        n = int(r["image_path"][1:])
        if n >= 30:
            assert r["path"] == "miss" and r["macro"] is None and r["result"] is None
        else:
            assert r["path"] == "refined" and tuple(r["macro"]) == (n % 16, n % 12, n % 16 + 9, n % 12 + 7)


def test_frames_are_decoded_once(spark, small_batches):
    decoded = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def decode(n):
        if n is not None:
            decoded.add(1)
            return bytes([n, n, n]) * (SIZE // 3)

    frames = spark.range(20).select(F.col("id").cast("string").alias("image_path"), F.col("id").alias("pixels"))
    rows = spark.range(600).select("id", (F.col("id") % 20).cast("string").alias("image_path"), F.lit("q").alias("query"))
    assert agent.zoom_verify_pixels(rows, frames, agent.PixelPredictor("reads", Reads), target=TARGET, decode=decode).count() == 600
    assert decoded.value == 20


def test_boxes_in_arrays_are_those_of_expressions(spark):
    """Both passes against the expressions over recorded answers, for odd texts too."""
    rng = np.random.default_rng(5)
    number = lambda low, high: f"{rng.uniform(low, high):.{rng.integers(0, 6)}f}"
    some = lambda: f"<box>[{number(-3, 20)}, {number(-3, 15)}, {number(8, 40)}, {number(8, 30)}]</box>"
    odd = ["", "<box>[1,2,3]</box>", "<box>[0,0,1e3,9]</box>", f"<box>[-0,-0.0,{'9' * 400},20]</box>", f"<box>[-{'9' * 50},0,30,{'9' * 40}]</box>", "x<box> [\x0b0\x85,\x1c0 ,〨16.5,12.25 ]</box><box>[1,1,9,9]</box>".replace("〨", "　"),
           "<box>[4,4,8,8]</box>", "<box>[4,4,7.9999,8]</box>", "<box>[１,2,30,20]</box>", "<box>[9,9,2,2]</box>", "<box>[0,0,32,24]</box>", "<box>[0.1,0.2,16.3,12.7]</box>"]
    pairs = [(a, b) for a in odd for b in odd] + [(some(), some()) for _ in range(300)]
    rows = [(i, "a", f"{i};{a};{b}", a or None, b or None) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, image_path string, query string, first string, second string")
    frames = spark.createDataFrame([("a", bytes(SIZE))], "image_path string, pixels binary")
    got = agent.zoom_verify_pixels(df, frames, agent.PixelPredictor("replays", Replays), target=TARGET)
    want = agent.zoom_verify(df, agent.recorded("first"), agent.recorded("second"), target=TARGET)
    shown = lambda x: sorted((r["id"], r["path"], str(r["macro"]), str(r["result"])) for r in x.collect())
    assert {r[1] for r in shown(want)} == {"miss", "too_small", "macro_fallback", "refined"}
    assert shown(got) == shown(want)


def test_frames_that_repeat_or_cannot_be_read(spark, small_batches):
    """A frame given twice is seen twice, as a join has it; one that is null is none; a bad one that nobody asks about is no error."""
    plain = lambda n: bytes([n, n, 0]) * (SIZE // 3)
    frames = spark.createDataFrame([("a", plain(1)), ("a", plain(5)), ("b", None), ("c", plain(2)), ("unasked", b"12"), (None, plain(3))], "image_path string, pixels binary")
    rows = [(i, image, "q") for i, image in enumerate(["a"] * 9 + ["b", "c", None, "d"])]
    df = spark.createDataFrame(rows, "id int, image_path string, query string")
    got = agent.zoom_verify_pixels(df, frames, agent.PixelPredictor("reads", Reads), target=TARGET).collect()
    seen = sorted((r["id"], r["path"], r["macro"] and r["macro"]["x0"]) for r in got)
    assert seen == [(i, "refined", x) for i in range(9) for x in (1.0, 5.0)] + [(9, "miss", None), (10, "refined", 2.0), (11, "miss", None), (12, "miss", None)]


def test_zooms_made_together_are_those_made_alone():
    rng = np.random.default_rng(6)
    frames = rng.integers(0, 256, (9, 24, 32, 3), dtype=np.uint8)
    which, low = rng.integers(0, 9, 200), rng.integers(0, 20, (200, 2))
    crops = np.concatenate([low, low + rng.integers(1, 5, (200, 2))], axis=1)
    got = pixels.zoomed_bytes(frames, which, crops, 0.3)
    for image, f, (x0, y0, x1, y1) in zip(got, which, crops, strict=True):
        assert np.array_equal(image, pixels.to_bytes(pixels.letterbox_pixels(frames[f, y0:y1, x0:x1] / 255.0, TARGET, 0.3)))
    assert pixels.zoomed_bytes(frames, which[:0], crops[:0]).shape == (0, 24, 32, 3)
