"""Golden vectors and properties of the expression layer."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import Config, load, override
from gridloom.functions import geometry as geo
from gridloom.functions import scoring
from gridloom.functions.text import basename, completion_text, is_one_box, parse_box, render_prompt, strip
from gridloom.operators import order
from gridloom.operators.elements import FRAME_COLUMNS, filter_frame, flatten_elements, is_wellformed, records_to_frame


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(values):
    return [F.lit(float(v)).cast("float") for v in values]


@pytest.mark.parametrize(
    "size, scale, pad, content",
    [
        ((1920, 1080), 0.5333333333333333, (0, 96), (1024, 576)),
        ((1025, 1025), 0.7492682926829268, (128, 0), (768, 768)),
        ((2048, 1001), 0.5, (0, 134), (1024, 500)),
        ((100, 1000), 0.768, (473, 0), (77, 768)),
    ],
)
def test_letterbox(spark, size, scale, pad, content):
    p = one(spark, geo.letterbox(F.lit(size[0]), F.lit(size[1])).alias("p"))["p"]
    assert (p["scale"], p["pad_x"], p["pad_y"], p["content_w"], p["content_h"]) == (scale, *pad, *content)


def test_letterbox_needs_a_size(spark):
    with pytest.raises(Exception, match="not positive"):
        one(spark, geo.letterbox(F.lit(0), F.lit(5)))


@pytest.mark.parametrize(
    "box, size, expected",
    [
        ((480, 0, 921.6, 14.4), (1920, 1200), (256, 64, 491.52001953125, 71.68000030517578)),
        ((100.5, 200.25, 300.75, 400.5), (1025, 1025), (203.30145263671875, 150.0409698486328, 353.3424377441406, 300.0819396972656)),
    ],
)
def test_letterbox_box(spark, box, size, expected):
    p = geo.letterbox(F.lit(size[0]), F.lit(size[1]))
    assert tuple(one(spark, *geo.letterbox_box([F.lit(float(x)) for x in box], p))) == expected


def test_unletterbox_of_padding(spark):
    p = geo.letterbox(F.lit(1920), F.lit(1080))
    assert tuple(one(spark, *geo.unletterbox_box(lits((0, 0, 1024, 50)), p))) == (0, 0, 1919.9998779296875, 0)


@pytest.mark.parametrize(
    "pred, coverage, precision, reward",
    [
        ((100, 100, 200, 120), 1, 1, 1.0),
        ((90, 95, 210, 125), 1, 0.5555555820465088, 0.8222222328186035),
        ((100, 100, 190, 120), 0.8999999761581421, 1, -1.0),
        ((105, 100, 200, 120), 0.949999988079071, 1, 0.9699999928474426),
        ((0, 0, 1024, 768), 1, 0.0025431315880268812, 0.6010172526352108),
        ((200, 120, 100, 100), 0, 0, -1.0),
        ((300, 300, 400, 400), 0, 0, -1.0),
    ],
)
def test_scores(spark, pred, coverage, precision, reward):
    target = lits((100, 100, 200, 120))
    c, p = scoring.coverage_precision(lits(pred), target)
    row = one(spark, c.alias("c"), p.alias("p"), scoring.box_reward(lits(pred), target).alias("r"))
    assert (row["c"], row["p"], row["r"]) == (coverage, precision, reward)


def test_no_box_scores_nothing(spark):
    missing = [F.lit(None).cast("float")] * 4
    c, p = scoring.coverage_precision(missing, lits((1, 2, 3, 4)))
    row = one(spark, c, p, scoring.box_reward(missing, lits((1, 2, 3, 4))), scoring.passes(c, p))
    assert tuple(row) == (None, None, 0.0, False)


def test_parse_box(spark):
    text = F.lit("junk <box> [1, -2.5,3 , 4.] </box> <box>[5,6,7,8]</box>")
    assert tuple(one(spark, parse_box(text).alias("b"))["b"]) == (5, 6, 7, 8)
    row = one(spark, parse_box(F.lit("no")), is_one_box(F.lit("\n <box>[1,2,3,4]</box> ")), is_one_box(F.lit("<box>[1,2,3,4]</box>.")))
    assert tuple(row) == (None, True, False)


def test_text(spark):
    row = one(
        spark,
        strip(F.lit("　\x1c a b \x85\t")),
        basename(F.lit("a/b/c.png/")),
        render_prompt(F.lit("a $1 {x}"), "<{query}>"),
        completion_text(F.array(F.struct(F.lit("a").alias("content")), F.struct(F.lit(None).cast("string").alias("content")))),
    )
    assert tuple(row) == ("a b", "c.png", "<a $1 {x}>", "aNone")


@pytest.mark.parametrize(
    "macro, micro, crop, result",
    [
        ((100, 100, 200, 120), (200, 300, 800, 450), (85, 97, 215, 123), (110.390625, 99.412109375, 186.5625, 118.455078125)),
        ((1000, 750, 1024, 768), (512, 384, 1024, 768), (996, 747, 1024, 768), (1010, 757.5, 1024, 768)),
    ],
)
def test_crop_and_project(spark, macro, micro, crop, result):
    c = geo.crop_box(lits(macro))
    p = geo.letterbox(c["x1"] - c["x0"], c["y1"] - c["y0"])
    row = one(spark, c.alias("c"), F.struct(*geo.project_box(lits(micro), c, p)).alias("r"))
    assert (tuple(row["c"]), tuple(row["r"])) == (crop, result)


def test_box_properties(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        w, h = rng.randrange(8, 4000), rng.randrange(8, 4000)
        x = sorted(rng.uniform(0, w) for _ in range(2))
        y = sorted(rng.uniform(0, h) for _ in range(2))
        rows.append((w, h, x[0], y[0], x[1], y[1]))
    df = spark.createDataFrame(rows, "w int, h int, x0 double, y0 double, x1 double, y1 double").withColumn("p", geo.letterbox(F.col("w"), F.col("h")))
    df = df.withColumns({f"f{i}": c for i, c in enumerate(geo.letterbox_box([F.col(c) for c in geo.CORNERS], F.col("p")))})
    df = df.withColumns({f"b{i}": c for i, c in enumerate(geo.unletterbox_box([F.col(f"f{i}") for i in range(4)], F.col("p")))})
    for r in df.collect():
        p = r["p"]
        assert 0 <= p["pad_x"] and p["pad_x"] + p["content_w"] <= 1024 and 0 <= p["pad_y"] and p["pad_y"] + p["content_h"] <= 768
        assert p["pad_x"] <= r["f0"] <= r["f2"] <= p["pad_x"] + p["content_w"] and p["pad_y"] <= r["f1"] <= r["f3"] <= p["pad_y"] + p["content_h"]
        step = 1e-3 + 1e-6 * max(r["w"], r["h"]) + max(r["w"] - p["content_w"] / p["scale"], r["h"] - p["content_h"] / p["scale"], 0)
        assert all(abs(r[f"b{i}"] - r[c]) <= step for i, c in enumerate(geo.CORNERS))


def test_flatten(spark):
    entries = [
        '{"img_filename": "d/a.png", "elements": [{"instruction": "one", "bbox": [0, 0.5, "0.4", 2]}, {"instruction": "", "bbox": [0,0,1,1]}, {"instruction": "x", "bbox": 7}]}',
        '{"img_filename": "b.png", "instruction": "flat", "bbox": [0.1, 0.2, 0.3, 0.4]}',
        '{"img_filename": "c.png", "elements": null}',
        '{"img_filename": "d.png", "elements": []}',
    ]
    df = spark.createDataFrame([(e,) for e in entries], "j string").select(F.parse_json("j").alias("entry"), F.lit("s").alias("source"))
    flat = flatten_elements(df).withColumn("ok", is_wellformed()).collect()
    assert sorted((r["img_filename"], r["instruction"] or "", r["ok"]) for r in flat) == [("b.png", "flat", True), ("c.png", "", False), ("d/a.png", "", False), ("d/a.png", "one", True), ("d/a.png", "x", False)]
    assert next(r["bbox"] for r in flat if r["instruction"] == "one") == [0.0, 0.5, 0.4, 2.0]


def test_frame_and_filter(spark):
    records = spark.createDataFrame(
        [("a", "  ok ", [-1.0, 0.0, 0.5, 2.0], 100, 50), ("b", " ab ", [0.0, 0.0, 1.0, 1.0], 100, 50), ("c", "nan", [0.0, 0.0, math.nan, 1.0], 100, 50), ("d", "thin", [0.0, 0.0, 0.04, 1.0], 100, 50), ("e", "edge", [0.0, 0.0, 0.05, 0.1], 100, 50)],
        "img_filename string, instruction string, bbox array<double>, img_w int, img_h int",
    )
    frame = records_to_frame(records)
    assert tuple(frame.columns) == FRAME_COLUMNS
    assert tuple(frame.first())[2:6] == (0.0, 0.0, 50.0, 50.0)
    assert [r["image_path"] for r in filter_frame(frame, min_query_chars=2).collect()] == ["a", "b", "e"]
    assert [r["image_path"] for r in filter_frame(frame, min_query_chars=2, max_query_chars=2).collect()] == ["a", "b"]
    assert tuple(records_to_frame(records, "absolute").first())[2:6] == (-1.0, 0.0, 0.5, 2.0)
    with pytest.raises(ValueError):
        records_to_frame(records, "polar")


@pytest.mark.parametrize("n, held", [(0, 1), (1, 1), (99, 1), (199, 1), (200, 2), (34177, 341)])
def test_holdout_size(n, held):
    assert order.holdout_size(n, 0.01) == held


@pytest.mark.parametrize(
    "sizes, weights, counts", [((7, 3), (0.7, 0.3), [7, 3]), ((700, 50), (0.7, 0.3), [700, 300]), ((100, 1000), (0.8, 0.2), [100, 25]), ((1, 9), (0.99, 0.01), [1, 1])]
)
def test_epoch_sizes(sizes, weights, counts):
    assert order.epoch_sizes(sizes, weights) == counts


@pytest.mark.parametrize("sizes, weights", [((1,), (1, 2)), ((), ()), ((1, 1), (0, 1)), ((0, 1), (1, 1))])
def test_epoch_sizes_refuses(sizes, weights):
    with pytest.raises(ValueError):
        order.epoch_sizes(sizes, weights)


def test_orders(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7 - 300)
    assert [r["pos"] for r in order.ordinal_by(df, "k").orderBy("k").collect()] == list(range(1000))
    odd = spark.createDataFrame([(5,), (None,), (1,), (7,), (10**15,), (5,), (None,)], "k bigint")
    assert [(r["k"], r["pos"]) for r in order.ordinal_by(odd, "k").orderBy("pos").collect()] == [(k, i) for i, k in enumerate([1, 5, 5, 7, 10**15, None, None])]
    a = {r["id"]: r["pos"] for r in order.shuffled(df, ["id"], 17).collect()}
    b = {r["id"]: r["pos"] for r in order.shuffled(df.repartition(9), ["id"], 17).collect()}
    assert a == b and sorted(a.values()) == list(range(1000)) and a != {i: i for i in range(1000)}
    train, held = order.split_holdout(order.shuffled(df, ["id"], 17))
    assert held.count() == 10 and train.join(held, "id").count() == 0 and train.count() == 990
    legacy = {r["id"]: r["pos"] for r in order.shuffled_like_pandas(spark.range(10), "id", 17).collect()}
    assert [legacy[i] for i in (7, 2, 5, 3, 4, 0, 9, 8, 6, 1)] == list(range(10))


def brute_groups(sizes, fraction, seed):
    """The groups that are held: in the order of their digests until the number is reached."""
    wanted, held, before = max(1, int(sum(sizes.values()) * fraction)), set(), 0
    name = lambda g: "[null]" if g is None else json.dumps([g])
    for g in sorted(sizes, key=lambda g: hashlib.md5(f"{name(g)}|{seed}".encode()).hexdigest()):
        over = before + sizes[g] - wanted
        if over < 0 or not before or (before < wanted and over < wanted - before):
            held.add(g)
        before += sizes[g]
        if over >= 0:
            break
    return held


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("fraction", [0.001, 0.05, 0.5, 1.0])
def test_split_groups(spark, monkeypatch, fraction, digits):
    """Whole groups, near the number; one group holds a third of all rows, one has no name, one an empty one."""
    monkeypatch.setattr(order, "DIGITS", digits)
    sizes = {f"g{i}": 1 + i % 7 for i in range(300)} | {None: 5, "": 4, "hot": 600}
    rows = spark.createDataFrame([(g, n) for g, n in sizes.items()], "g string, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    for seed in range(3):
        train, held = order.split_groups(rows, "g", fraction, seed)
        got = {r["g"]: r["n"] for r in held.groupBy("g").agg(F.count("*").alias("n")).collect()}
        rest = {r["g"]: r["n"] for r in train.groupBy("g").agg(F.count("*").alias("n")).collect()}
        assert got | rest == sizes and not set(got) & set(rest)
        assert set(got) == brute_groups(sizes, fraction, seed)
        assert abs(sum(got.values()) - max(1, int(sum(sizes.values()) * fraction))) < max(sizes.values())


def test_split_groups_of_few_rows(spark):
    none = spark.createDataFrame([], "g string, h int")
    assert [x.count() for x in order.split_groups(none, "g")] == [0, 0]
    one = spark.createDataFrame([("a", 1), ("a", 1)], "g string, h int")
    assert [x.count() for x in order.split_groups(one, "g")] == [0, 2]
    # Two columns name a group; texts that only look alike when joined do not meet.
    pairs = spark.createDataFrame([("a,b", "c"), ("a", "b,c")] * 2, "g string, h string")
    assert [x.count() for x in order.split_groups(pairs, ["g", "h"], 0.5)] == [2, 2]


def test_mix(spark):
    a, b = (spark.range(n).select(F.col("id").cast("string").alias("row_key"), F.lit(x).alias("v")) for n, x in ((70, "a"), (7, "b")))
    rows = order.mixed_rows([a, b], ["row_key"], [0.7, 0.3], 3).collect()
    assert sorted(r["pos"] for r in rows) == list(range(100))
    assert sorted(r["row_key"] for r in rows if r["v"] == "a") == sorted(str(i) for i in range(70))
    per = [sum(r["v"] == "b" and r["row_key"] == str(i) for r in rows) for i in range(7)]
    assert sum(per) == 30 and set(per) == {4, 5}
    assert order.mixed_rows([a, b], ["row_key"], [1.0, 0.0], 3).count() == 70


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("seed: 5\nui: {min_box_px: 7}\nmix_ratio: [1, 0]\n")
    config = load(str(path), ("reward.format_reward=0.25",))
    assert (config.seed, config.ui.min_box_px, config.mix_ratio, config.reward.format_reward) == (5, 7, (1, 0), 0.25)
    assert Config().seed == 17
    with pytest.raises(ValueError):
        override(Config(), {"nothing": 1})


def test_zip_rewards_cuts(spark):
    row = one(spark, scoring.zip_rewards(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(10), F.lit(20)), lambda a, b: a + b))
    assert row[0] == [11, 22]


def test_pixels_keep_a_constant():
    from gridloom.operators.pixels import letterbox_pixels, resize, to_bytes

    flat = np.full((30, 50, 3), 0.4)
    assert np.allclose(resize(flat, 17, 90), 0.4)
    out = letterbox_pixels(flat, (64, 48), fill=1.0)
    assert out.shape == (48, 64, 3) and np.allclose(out[5:43], 0.4) and np.allclose(out[:5], 1.0)
    assert to_bytes(np.array([-1.0, 0.5, 2.0, 2.5 / 255])).tolist() == [0, 128, 255, 2]
