"""Queries against their SQL, sources, sinks, agent, plans and streams."""

import io
import json
import math
import os
import struct
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom import fixtures as fx
from gridloom import registry
from gridloom.config import Config, override
from gridloom.functions import scoring
from gridloom.operators import agent, encode
from gridloom.plans import datasets
from gridloom.sources import annotations, archives, image_folder
from gridloom.streaming import scoring as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    def value(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = norm([r[i] for i in order] for r in result.fetchall())
    assert norm(tuple(r[c] for c in columns) for r in df.collect()) == expected and expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_library_stands_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['gridloom.llm'] = None\nimport gridloom.registry, gridloom.plans.datasets, gridloom.streaming.scoring, gridloom.sources.archives"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_annotations(spark, tmp_path):
    strict = [{"img_filename": "x/a.png", "elements": [{"instruction": "one", "bbox": [0, 0, 1, 1]}]}, {"img_filename": "b.png", "instruction": "two", "bbox": [0, 0, 0.5, 1]}]
    (tmp_path / "a.json").write_text(json.dumps(strict))
    (tmp_path / "b.json").write_text('[{"img_filename": "c.png", "instruction": "three", "bbox": [0, NaN, 1, 1]}]')
    entries = annotations.read_annotations(spark, {"s": str(tmp_path / "a.json"), "t": str(tmp_path / "b.json")})
    index = spark.createDataFrame([("s", "a.png", "img/a.png"), ("s", "b.png", "img/b.png"), ("t", "c.png", "i/c.png")], "source string, basename string, rel_path string")
    sizes = index.select("source", "rel_path", F.lit(100).alias("img_w"), F.lit(200).alias("img_h"))
    got = {r["image_path"]: r for r in datasets.ui_frame(entries, index, sizes).collect()}
    assert tuple(got["img/a.png"])[2:] == (0, 0, 100, 200, 100, 200) and got["img/b.png"]["x1"] == 50 and math.isnan(got["i/c.png"]["y0"])


def test_images_and_archives(spark, tmp_path):
    png = registry.png(7, 5, lambda x, y: (x, y, 0))
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 9, 13) + b"\0" * 8
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 3, -4)
    webp = b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (30).to_bytes(3, "little") + (40).to_bytes(3, "little")
    path = tmp_path / "all.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, body in (("d/a.png", png), ("d/b.JPG", jpeg), ("c.bmp", bmp), ("e.webp", webp), ("f.txt", b"no")):
            z.writestr(name, body)
    raw = path.read_bytes()
    (tmp_path / "z.part2").write_bytes(raw[40:])
    (tmp_path / "a.part1").write_bytes(raw[:40])
    for parts in ([str(path)], [str(tmp_path / "a.part1"), str(tmp_path / "z.part2")]):
        files = archives.read_zip(spark, {"s": parts})
        sizes = {r["name"]: (r["img_w"], r["img_h"]) for r in archives.with_image_size(files).collect()}
        assert sizes == {"d/a.png": (7, 5), "d/b.JPG": (13, 9), "c.bmp": (3, 4), "e.webp": (31, 41), "f.txt": (None, None)}
        kept = archives.archive_images(spark, str(tmp_path / "cache"), "s", parts).collect()
        assert sorted((r["basename"], r["img_w"]) for r in kept) == [("a.png", 7), ("b.JPG", 13), ("c.bmp", 3), ("e.webp", 31)]
    odd = tmp_path / "i+m (a) 100% é"
    (odd / "d").mkdir(parents=True)
    (odd / "d/a.png").write_bytes(png)
    assert [r["rel_path"] for r in image_folder.list_images(spark, str(odd), "s").collect()] == ["d/a.png"]
    (tmp_path / "images/d").mkdir(parents=True)
    for name in ("d/a.PNG", "d/b.jpeg", "x.gif", ".png"):
        (tmp_path / "images" / name).write_bytes(png)
    listed = image_folder.list_images(spark, str(tmp_path / "images"), "s").collect()
    assert sorted((r["rel_path"], r["basename"]) for r in listed) == [("d/a.PNG", "a.PNG"), ("d/b.jpeg", "b.jpeg")]


def test_pixels_of_both_decoders_agree(spark, tmp_path):
    from gridloom.operators.pixels import framed_images, read_framed

    png = registry.png(20, 10, lambda x, y: (x * 12, y * 25, 77))
    (tmp_path / "a.png").write_bytes(png)
    jvm = read_framed(spark, str(tmp_path), (40, 30)).first()
    own = framed_images(spark.createDataFrame([(1, png)], "id bigint, content binary"), (40, 30)).first()
    assert jvm["pixels"] == own["pixels"] and len(own["pixels"]) == 3600


def test_pages_on_disk(spark, tmp_path):
    annotations.keep_pages(fx.pages(spark, SF), str(tmp_path / "p"))
    en = annotations.read_pages(spark, str(tmp_path / "p")).where("doc_category = 'en'")
    assert en.count() == registry.page_ordinals(spark, SF).count()
    rows, seen = datasets.observed(en, "pages", kept=F.count("*"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"kept": en.count()}


def test_decode_png_filters():
    from gridloom.operators.pixels import decode_png

    width, rows = 3, []
    image = [[(x * 50 + y * 20) % 256 for x in range(width * 3)] for y in range(5)]
    for y, line in enumerate(image):
        above = image[y - 1] if y else [0] * len(line)
        coded = []
        for x, v in enumerate(line):
            a, b, c = (line[x - 3] if x >= 3 else 0), above[x], (above[x - 3] if x >= 3 else 0)
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            coded.append((v - (0, a, b, (a + b) // 2, paeth)[y]) % 256)
        rows.append(bytes([y, *coded]))
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + b"\0\0\0\0"
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows)))
    assert decode_png(content).reshape(5, -1).tolist() == image


def test_cache_follows_configuration(spark, tmp_path):
    built = []

    def build(n):
        return lambda: (built.append(n), spark.range(n))[1]

    assert annotations.cached(spark, str(tmp_path), {"n": 1}, build(1)).count() == 1
    assert annotations.cached(spark, str(tmp_path), {"n": 2}, build(2)).count() == 2
    assert annotations.cached(spark, str(tmp_path), {"n": 1}, build(9)).count() == 1
    assert built == [1, 2]


def test_agent_asks_twice_only_where_it_zooms(spark):
    rows = [(1, "<box>[100,100,200,120]</box>", "<box>[200,300,800,450]</box>"), (2, "none", "x"), (3, "<box>[5,5,6,6]</box>", "x"), (4, "<box>[-5,0,2000,90]</box>", "x")]
    df = spark.createDataFrame(rows, "id int, first string, second string").withColumn("query", F.lit("q"))
    asked = []

    def micro(frame, query, name):
        asked.extend(r["id"] for r in frame.where(F.col(query).isNotNull()).select("id").collect())
        return agent.recorded("second")(frame, query, name)

    got = {r["id"]: r for r in agent.zoom_verify(df, agent.recorded("first"), micro).collect()}
    assert sorted(asked) == [1, 4]
    seen = lambda rows: [f"<box>[{n},0,{n + 9},9]</box>" for n in rows["id"]]
    again = agent.zoom_verify(df, agent.recorded("first"), agent.batched(seen, ["id"])).collect()
    assert {r["id"]: r["path"] for r in again} == {1: "refined", 2: "miss", 3: "too_small", 4: "refined"}
    assert {i: r["path"] for i, r in got.items()} == {1: "refined", 2: "miss", 3: "too_small", 4: "macro_fallback"}
    assert got[2]["result"] is None and tuple(got[4]["result"]) == (0, 0, 1024, 90) and tuple(got[3]["result"]) == (5, 5, 6, 6)


def test_build(spark):
    cell = registry.cell_frame(spark, SF)
    ui = fx.ui_frame(spark, SF)
    keys = ["image_path", "query", "x0", "y0", "x1", "y1"]
    train, held = datasets.build(ui, fx.UI_KEYS, cell, keys)
    n = registry.filter_ui(spark, SF).count()
    assert held.count() == n // 100 and "messages" in train.columns
    assert train.where("child = 0").count() == n - n // 100
    alone, nothing = datasets.build(ui, fx.UI_KEYS, cell, keys, override(Config(), {"mix_ratio": [1, 0]}), "grpo")
    assert nothing is None and alone.count() == n - n // 100 and "target_bbox" in alone.columns
    with pytest.raises(ValueError):
        datasets.build(ui, fx.UI_KEYS, None, keys, mode="other")
    with pytest.raises(ValueError):
        datasets.build(ui, fx.UI_KEYS, None, keys, override(Config(), {"holdout_by": "other"}))
    # By whole screenshots no image is on both sides, and no row is lost.
    train, held = datasets.build(ui, fx.UI_KEYS, None, [], override(Config(), {"holdout_by": "image", "mix_ratio": [1, 0]}))
    assert not train.select("image_path").intersect(held.select("image_path")).count() and train.count() + held.count() == n


def test_collate(spark):
    items = [(0, 0, [1, 2], [9, 9], [0.5]), (0, 1, [3], [9], [0.25]), (1, 2, [4], [9], [0.75])]
    df = spark.createDataFrame(items, "batch_id int, item int, input_ids array<bigint>, labels array<bigint>, pixel_values array<double>")
    df = df.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1).cast("bigint")))
    got = {r["batch_id"]: r for r in encode.collate(encode.pad_batches(df, pad_id=7)).collect()}
    assert got[0]["input_ids"] == [[1, 2], [3, 7]] and got[0]["labels"] == [[9, 9], [9, -100]] and got[0]["attention_mask"] == [[1, 1], [1, 0]]
    assert got[0]["pixel_values"] == [0.5, 0.25] and got[1]["input_ids"] == [[4]]


def test_own_channel(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CHANNELS", dict(scoring.CHANNELS))
    scoring.channel("length")(lambda columns, rules: F.char_length(columns["completion"]).cast("double"))
    df = spark.createDataFrame([("<box>[1,1,2,2]</box>", [1.0, 1.0, 2.0, 2.0], "extra")], "completion string, target_bbox array<float>, more string")
    row = scoring.score(df).first()
    assert (row["length"], row["format_reward_func"], row["asymmetric_bbox_reward_func"]) == (20.0, 0.5, 1.0)


def test_streams(spark, tmp_path):
    rows = registry.fx.completions(spark, SF).select("completion", "target_bbox")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.write_parquet(streams.score_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = scoring.score(rows)
    means = lambda df: [round(x, 9) for x in scoring.channel_means(df).first()]
    assert got.count() == rows.count() and means(got) == means(batch)


def test_archive_in_groups_and_bad_images(spark, tmp_path):
    """Members are read by range in several tasks; a file that cannot be decoded has no pixels."""
    from gridloom.operators.pixels import framed_images

    png, packed = registry.png(6, 4, lambda x, y: (x, y, 1)), io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for i in range(50):
            archive.writestr(f"d{i % 3}/{i}.png", png if i else b"no image")
        archive.writestr("d0/empty/", b"")
    raw, cuts = packed.getvalue(), [0, 11, 400, 401, len(packed.getvalue())]
    paths = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        paths.append(str(tmp_path / f"{9 - i}.part"))
        (tmp_path / f"{9 - i}.part").write_bytes(raw[a:b])
    files = archives.read_zip(spark, {"s": paths}, member_bytes=200)
    assert sorted(r["name"] for r in files.collect()) == sorted(f"d{i % 3}/{i}.png" for i in range(50))
    assert archives.read_zip(spark, {"s": paths}, pattern="^d1/").count() == 17
    pixels = {r["id"]: r["pixels"] for r in framed_images(files.select(F.col("name").alias("id"), "content"), (6, 4)).collect()}
    assert pixels["d0/0.png"] is None and sum(v is not None for v in pixels.values()) == 49
