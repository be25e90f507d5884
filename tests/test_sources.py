"""Sources and the agent on data of hostile shapes: JSON arrays in ranges, image folders, pixels."""

import hashlib
import json
import os
import random
import struct
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import registry
from gridloom.operators import agent, encode, order, pixels
from gridloom.plans import datasets, metrics
from gridloom.sources import annotations, archives, image_files, image_folder, json_array, page_store


def nasty(n, seed):
    """Entries whose strings hold brackets, commas, quotes, runs of backslashes and characters of many bytes."""
    rng = random.Random(seed)
    bits = ["\\", "\\\\", '"', '\\"', ",", "[", "]", "{", "}", "é", "中", "\U0001f600", "x", "\n", "\t", " "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    value = lambda d: rng.choice([text(), None, rng.random(), [value(d + 1) for _ in range(rng.randrange(3))], {text(): value(d + 1)}] if d < 3 else [text(), 1])
    return [{"img_filename": f"{i}{text()}", "instruction": text(), "extra": value(0)} for i in range(n)]


@pytest.mark.parametrize("range_bytes, block", [(1, 7), (13, 4 << 20), (200, 5), (1 << 20, 64)])
def test_json_array_in_ranges(spark, tmp_path, monkeypatch, range_bytes, block):
    monkeypatch.setattr(json_array, "BLOCK", block)
    monkeypatch.setattr(json_array, "RANGES", 300)
    entries = nasty(40, range_bytes)
    for name, raw in (("compact", json.dumps(entries, separators=(",", ":"))), ("wide", " \n" + json.dumps(entries, indent=1, ensure_ascii=False) + "\n ")):
        data = raw.encode()
        cuts = [0, 1, 57, 58, len(data)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            (tmp_path / f"{name}{range_bytes}.{i}").write_bytes(data[a:b])
        found = json_array.read_json_array(spark, [str(tmp_path / f"{name}{range_bytes}.{i}") for i in range(4)], range_bytes)
        assert found.rdd.getNumPartitions() == (min(300, -(-len(data) // max(range_bytes, -(-len(data) // 300)))))
        key = lambda e: json.dumps(e, sort_keys=True)
        assert sorted(key(json.loads(r["text"])) for r in found.collect()) == sorted(map(key, entries))


def test_json_elements_are_no_small_table(spark, tmp_path):
    """A join does not broadcast an array's elements because the ranges that they are read from are few."""
    (tmp_path / "a.json").write_text(json.dumps([f"k{i}" for i in range(4000)]))
    large = spark.range(40_000).select(F.concat(F.lit('"k'), F.col("id").cast("string"), F.lit('"')).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # less than the elements, more than the ranges
    try:
        joined = json_array.read_json_array(spark, [str(tmp_path / "a.json")], 16 << 10).join(large, "text")
        plan = joined._jdf.queryExecution().executedPlan()
        assert len(plan.executeCollect()) == 4000
        assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_json_array_summaries_compose():
    """Cut anywhere, the parts tell of the state that a file begins in what the whole tells; the others cannot occur there."""
    rng = random.Random(3)
    data = np.frombuffer(json.dumps(nasty(30, 9), ensure_ascii=False).encode(), np.uint8)
    whole = json_array.summary(iter([data]))
    for _ in range(300):
        cuts = sorted(rng.sample(range(len(data)), rng.randrange(1, 6)))
        assert json_array.summary(np.split(data, cuts))[json_array.OUTSIDE] == whole[json_array.OUTSIDE]
    assert whole[json_array.OUTSIDE] == (json_array.OUTSIDE, 0)


def test_json_array_refuses(spark, tmp_path):
    for i, raw in enumerate(["", "  ", "{}", "[1, 2", '["]', '[[1]', "[1]]"]):
        path = tmp_path / f"{i}.json"
        path.write_text(raw)
        with pytest.raises(json_array.NoJsonArray):
            json_array.read_json_array(spark, [str(path)]).collect()
    (tmp_path / "none.json").write_text(" [ \n ] ")
    assert json_array.read_json_array(spark, [str(tmp_path / "none.json")]).count() == 0


def test_annotations_written_and_read(spark, tmp_path):
    """One bad entry costs no other; many parts are one array."""
    (tmp_path / "a.json").write_text('[{"img_filename": "a.png", "instruction": "x", "bbox": [0, NaN, 1, 1]}, {"img_filename": }, {"img_filename": "b.png", "elements": []}]')
    entries = annotations.read_annotations(spark, {"s": str(tmp_path / "a.json")})
    names = [r[0] for r in entries.select(F.try_variant_get("entry", "$.img_filename", "string")).collect()]
    assert sorted(names, key=str) == [None, "a.png", "b.png"] or sorted(names, key=str) == ["a.png", "b.png", None]
    rows = spark.range(500).select(F.to_json(F.struct(F.concat(F.lit("f"), "id").alias("img_filename"), F.lit("[,]\\").alias("instruction"))).alias("text"))
    parts = annotations.write_annotations(rows, str(tmp_path / "out"))
    whole = json.loads("".join(open(p).read() for p in parts))
    assert sorted(e["img_filename"] for e in whole) == sorted(f"f{i}" for i in range(500))
    assert annotations.read_annotations(spark, {"s": parts}).count() == 500
    assert json.loads("".join(open(p).read() for p in annotations.write_annotations(rows.limit(0), str(tmp_path / "none")))) == []


TARGET = (32, 24)


class Middle:
    """Answers by the middle colour, and remembers in the answer which image it saw."""

    def __call__(self, images, queries):
        assert images.shape[1:] == (24, 32, 3) and images.dtype == np.uint8
        out = []
        for image, q in zip(images, queries, strict=True):
            r, g, b = image[12, 16].tolist()
            out.append(None if b % 10 == 9 else f"<box>[{r // 8}, {g // 12}, {r // 8 + 4 + b % 9 + len(q)}, {g // 12 + 1 + b % 13}]</box>")
        return out


def test_agent_over_pixels(spark):
    """Both passes against the loop over rows, for images asked once, never, and a third of the time."""
    rng = np.random.default_rng(2)
    images = {f"i{k}": rng.integers(0, 256, (24, 32, 3), dtype=np.uint8) for k in range(30)}
    rows = [(k, f"i{rng.integers(1, 30) if k % 3 else 0}", "q" * int(rng.integers(0, 4)), None) for k in range(240)] + [(900, "i1", None, "x"), (901, "missing", "q", "x"), (902, None, "q", "x"), (1, "i1", "", "y"), (1, "i1", "", "y")]
    df = spark.createDataFrame(rows, "id int, image_path string, query string, crop string").withColumnRenamed("crop", "note")
    frames = spark.createDataFrame([(k, v.tobytes()) for k, v in images.items()], "image_path string, pixels binary")
    got = agent.zoom_verify_pixels(df, frames, agent.PixelPredictor("middle", Middle, batch=3, together=8), target=TARGET)
    assert got.columns == ["id", "image_path", "query", "note", "macro", "result", "path"]
    found = sorted((r["id"], r["path"], tuple(r["result"] or ())) for r in got.collect())
    box = lambda text: tuple(float(x) for x in text[text.index("[") + 1 : text.index("]")].split(",")) if text else None
    expected, model = [], Middle()
    for i, name, q, _ in rows:
        first = box(model(images[name][None], [q])[0]) if name in images and q is not None else None
        if first is None:
            expected.append((i, "miss", ()))
            continue
        x0, y0, x1, y1 = (min(max(v, 0), m) for v, m in zip(first, TARGET * 2))
        if x1 - x0 < 4 or y1 - y0 < 4:
            expected.append((i, "too_small", (x0, y0, x1, y1)))
            continue
        mx, my = (x1 - x0) * 0.15, (y1 - y0) * 0.15
        a, b, c, d = max(0, int(np.floor(x0 - mx))), max(0, int(np.floor(y0 - my))), min(32, int(np.ceil(x1 + mx))), min(24, int(np.ceil(y1 + my)))
        zoom = pixels.to_bytes(pixels.letterbox_pixels(images[name][b:d, a:c] / 255.0, TARGET))
        second = box(model(zoom[None], [q])[0])
        if second is None:
            expected.append((i, "macro_fallback", (x0, y0, x1, y1)))
            continue
        scale = min(32 / (c - a), 24 / (d - b))
        pad = (32 - min(32, round((c - a) * scale))) // 2, (24 - min(24, round((d - b) * scale))) // 2
        f = np.float32
        back = [min(max(f((f(v) - f(pad[k % 2])) / f(scale)), f(0)), f((c - a, d - b)[k % 2])) + f((a, b)[k % 2]) for k, v in enumerate(second)]
        expected.append((i, "refined", tuple(float(v) for v in back)))
    assert [e[:2] for e in sorted(expected)] == [g[:2] for g in found] and {e[1] for e in expected} == {"miss", "too_small", "macro_fallback", "refined"}
    np.testing.assert_allclose([v for e in sorted(expected) for v in e[2]], [v for g in found for v in g[2]], rtol=1e-5)


def test_agent_reads_frames_once(spark):
    """A frame comes by once for both passes, and no plan broadcasts it."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    image = np.random.default_rng(3).integers(0, 200, (24, 32, 3), dtype=np.uint8).tobytes()
    frames = spark.createDataFrame([(f"i{k}", image) for k in range(20)], "image_path string, pixels binary").mapInArrow(counted, "image_path string, pixels binary")
    rows = spark.range(60).select("id", F.concat(F.lit("i"), (F.col("id") % 20).cast("string")).alias("image_path"), F.lit("q").alias("query"))
    assert agent.zoom_verify_pixels(rows, frames, agent.PixelPredictor("middle", Middle), target=TARGET).count() == 60
    assert read.value == 20


def test_pixels_are_not_broadcast(spark):
    """Frames that follow from few bytes are as large as others."""
    images = spark.createDataFrame([(str(i), registry.png(4, 3, lambda x, y: (x, y, 0))) for i in range(20)], "image_path string, content binary")
    joined = encode.with_pixels(spark.range(200).select((F.col("id") % 25).cast("string").alias("image_path")), images, TARGET)
    plan = joined._jdf.queryExecution().executedPlan()
    assert len(plan.executeCollect()) == 160
    assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()


@pytest.mark.parametrize("size", [(1, 1), (5, 9), (64, 48), (200, 31)])
def test_zoomed_bytes_are_the_letterbox(size):
    image = np.random.default_rng(4).integers(0, 256, (*size, 3), dtype=np.uint8)
    for fill in (0.0, 0.3, 1.0):
        assert np.array_equal(pixels.letterbox_bytes(image, TARGET, fill), pixels.to_bytes(pixels.letterbox_pixels(image / 255.0, TARGET, fill)))


def test_agent_refuses_other_frames(spark):
    df = spark.createDataFrame([(1, "a", "q")], "id int, image_path string, query string")
    frames = spark.createDataFrame([("a", b"123")], "image_path string, pixels binary")
    with pytest.raises(Exception, match="expected a frame"):
        agent.zoom_verify_pixels(df, frames, agent.PixelPredictor("middle", Middle), target=TARGET).collect()


def test_image_folder(spark, tmp_path):
    """Hidden names, names of suffixes alone, deep folders, sizes that come late, and files that are no images."""
    png = registry.png(7, 5, lambda x, y: (x, y, 0))
    late = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 65_535) + b"\0" * 65_533) * 2 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 9, 13) + b"\0" * 8
    cut = b"\xff\xd8\xff\xe0" + struct.pack(">H", 60_000) + b"x"
    expected = {}
    for i in range(40):
        folder = ["", "d/", ".h/_u/", f"e/{i % 7}/f/g/", "a b%20é/"][i % 5]
        name, body, size = [(f"_{i}.png", png, (7, 5)), (f".h{i}.PNG", png, (7, 5)), (f"{i}.jpeg", late, (13, 9)), (f"{i}.bmp", b"no", None), (f"{i}.webp", b"", None), (f"{i}.gif", png, 0), (".png", png, 0), (f"{i}.Jpg", cut, None)][i % 8]
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(body)
        if size != 0:
            expected[folder + name] = (name, len(body), *(size or (None, None)))
    for folders in (1, 5, 500):
        rows = image_folder.list_images(spark, str(tmp_path), "s", folders=folders).collect()
        assert {r["rel_path"]: tuple(r)[2:] for r in rows} == expected and len(rows) == len(expected)
    bare = image_folder.list_images(spark, f"file://{tmp_path}", "s", sizes=False)
    assert bare.columns == ["source", "rel_path", "basename", "bytes"] and {r["rel_path"] for r in bare.collect()} == set(expected)


def test_image_folder_reads_headers_alone(tmp_path, monkeypatch):
    """Of a large image a few thousand bytes are asked for."""
    from pyarrow import fs

    asked = []
    path = tmp_path / "large.png"
    path.write_bytes(registry.png(3, 2, lambda x, y: (1, 2, 3)) + b"\0" * 10_000_000)

    class Seen:
        def open_input_file(self, place):
            f = fs.LocalFileSystem().open_input_file(place)

            class File:
                __enter__ = lambda self: self
                __exit__ = lambda self, *a: None
                read_at = lambda self, n, at: (asked.append(n), f.read_at(n, at))[1]

            return File()

    assert image_folder.header_size(Seen(), str(path), path.stat().st_size) == (3, 2) and sum(asked) <= 4096


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 100, 101, 1021, 4096, 4097])
def test_permutation_is_a_bijection(spark, n):
    orders = []
    for seed in ("17", "18"):
        rows = order.permuted(spark.range(n), F.col("id"), n, seed, "to").collect()
        to = [r["to"] for r in sorted(rows)]
        assert sorted(to) == list(range(n))
        orders.append(to)
    if n > 100:
        assert orders[0] != orders[1] and abs(np.corrcoef(range(n), orders[0])[0, 1]) < 0.25
        # Neighbours do not stay neighbours.
        assert np.mean(np.abs(np.diff(orders[0])) <= 1) < 0.05


def test_permutation_takes_no_digest_of_a_row(spark):
    """Every number goes where the digests of its row and column say, which are not taken row by row."""
    n, seed = 997, "0|17"
    df = order.permuted(spark.range(n), F.col("id"), n, seed, "to").where("to < 900")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and plan.count("ArrowEvalPython") == 1
    wide = 32
    high, shift = -(-n // wide), lambda other, k: int(hashlib.md5(f"{other}|{k}|{seed}".encode()).hexdigest()[:15], 16)

    def to(i):
        while True:
            x, y = i % wide, i // wide
            for k in range(0, order.STEPS, 2):
                x = (x + shift(y, k)) % wide
                y = (y + shift(x, k + 1)) % high
            i = x + y * wide
            if i < n:
                return i

    assert sorted(map(tuple, df.collect())) == [(i, to(i)) for i in range(n) if to(i) < 900]


def test_mixture_plan_ranks_nothing(spark):
    """Two children: their numbers come from written ranges, all else is arithmetic."""
    children = [spark.range(k).select(F.col("id").alias("row_key"), F.lit("x").alias("v")) for k in (700, 90)]
    mixed = order.mixed_rows(children, ["row_key"], [0.7, 0.3], 5)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Window")[0] if "Window" in plan else plan
    assert "row_number" not in plan and "Sort" not in above
    rows = mixed.collect()
    assert sorted(r["pos"] for r in rows) == list(range(1000)) and sorted(r["row_key"] for r in rows if r["child"] == 0) == list(range(700))
    assert sorted(r["pick"] for r in rows if r["child"] == 1) == list(range(300))
    assert rows == order.mixed_rows([c.repartition(7) for c in children], ["row_key"], [0.7, 0.3], 5).collect() or sorted(rows) == sorted(
        order.mixed_rows([c.repartition(7) for c in children], ["row_key"], [0.7, 0.3], 5).collect()
    )


def test_batches_of_a_mixture(spark):
    """Every row once, whole batches before the last, like lengths together, ranks dealt in turn."""
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 60)) for i in range(1003)]
    df = spark.createDataFrame(rows, "pos bigint, n int").withColumns({"input_ids": F.expr("transform(sequence(1, n), x -> cast(x as bigint))")})
    df = df.withColumns({"attention_mask": F.col("input_ids"), "labels": F.col("input_ids")})
    got = datasets.batches(df, 8, 16, 4, 3).collect()
    assert sorted(p for r in got for p in r["positions"]) == list(range(1003))
    assert sorted(r["batch_id"] for r in got) == list(range(126)) and all((r["rank"], r["step"]) == (r["batch_id"] % 4, r["batch_id"] // 4) for r in got)
    assert {r["batch_id"]: len(r["positions"]) for r in got if len(r["positions"]) != 8} == {125: 3}
    assert all(max(r["positions"]) // 128 == min(r["positions"]) // 128 for r in got)
    naive = sum(8 * max(n for _, n in rows[i : i + 8]) - sum(n for _, n in rows[i : i + 8]) for i in range(0, 1000, 8))
    assert sum(r["padding"] for r in got) < naive / 5


def packed(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as archive:
        for name, body in members.items():
            archive.writestr(name, body)


def test_members_are_read_by_place(spark, tmp_path):
    """Members are a table; of those asked for, and of no others, the bytes are fetched, inflated and checked."""
    bodies = {f"d{i % 3}/{i}.png": registry.png(i + 1, 2, lambda x, y: (x, y, 3)) for i in range(60)} | {"d0/": b"", "é/x.bin": b"\0" * 200_000, "none.txt": b""}
    packed(tmp_path / "a.zip", bodies)
    packed(tmp_path / "b.zip", {"d0/0.png": b"another"}, zipfile.ZIP_STORED)
    members = archives.list_members(spark, {"a": [str(tmp_path / "a.zip")], "b": [str(tmp_path / "b.zip")]})
    assert {(r["archive"], r["name"]): r["size"] for r in members.collect()} == {("a", n): len(b) for n, b in bodies.items() if n != "d0/"} | {("b", "d0/0.png"): 7}
    for size in (1, 500, 64 << 20):
        found = {(r["archive"], r["name"]): bytes(r["content"]) for r in archives.read_members(members, size).collect()}
        assert found == {("a", n): b for n, b in bodies.items() if n != "d0/"} | {("b", "d0/0.png"): b"another"}
    sized = archives.read_members(members.where("archive = 'a' AND name LIKE '%.png'"), sizes=True)
    assert {r["img_w"] for r in sized.collect()} == set(range(1, 61))
    # Damage to one member is noticed by who asks for it, and by no one else.
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    bad = next(r for r in members.collect() if r["name"] == "d1/1.png")
    raw[bad["offset"] + 30 + len("d1/1.png") + 20] ^= 255
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    assert archives.read_members(members.where("name <> 'd1/1.png'")).count() == len(bodies) - 1
    with pytest.raises(Exception, match="damaged|incorrect|invalid|Error -3"):
        archives.read_members(members.where("name = 'd1/1.png'")).collect()


def test_archive_is_unpacked_once_or_not_at_all(spark, tmp_path, monkeypatch):
    """A run that fails half way leaves nothing that is read; the next does all, the one after nothing."""
    bodies = {f"{i}.png": registry.png(i + 1, 2, lambda x, y: (x, y, 3)) for i in range(20)}
    packed(tmp_path / "a.zip", bodies)
    whole = (tmp_path / "a.zip").read_bytes()
    broken = bytearray(whole)
    broken[45:60] = b"\xff" * 15
    (tmp_path / "a.zip").write_bytes(bytes(broken))
    root = str(tmp_path / "cache")
    with pytest.raises(Exception):
        archives.archive_images(spark, root, "s", [str(tmp_path / "a.zip")])
    (tmp_path / "a.zip").write_bytes(whole)
    rows = archives.archive_images(spark, root, "s", [str(tmp_path / "a.zip")]).collect()
    assert {r["rel_path"]: (r["img_w"], bytes(r["content"])) for r in rows} == {n: (int(n[:-4]) + 1, b) for n, b in bodies.items()}
    monkeypatch.setattr(archives, "list_members", None)
    assert archives.archive_images(spark, root, "s", [str(tmp_path / "a.zip")]).count() == 20


def test_images_are_extracted_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A source appears with its manifest; a failed run leaves nothing, a second one unpacks nothing."""
    png = lambda w: registry.png(w, 2, lambda x, y: (x, y, 3))
    packed(tmp_path / "a.zip", {f"d{i % 3}/{i}.png": png(i + 1) for i in range(30)} | {"../up.png": png(40), "/abs/x.PNG": png(41), "c/../e.png": png(42), "none.txt": b"n"})
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as archive:
        for name, width in (("x.png", 1), ("./x.png", 2), ("y.png", 3)):  # the last of one path stays
            archive.writestr(name, png(width))
    packed(tmp_path / "c.zip", {"read.me": b"no image"})
    (tmp_path / "b.0").write_bytes((tmp_path / "b.zip").read_bytes()[:40])
    (tmp_path / "b.1").write_bytes((tmp_path / "b.zip").read_bytes()[40:])
    root = str(tmp_path / "files")
    zips = {"a": [str(tmp_path / "a.zip")], "b": [str(tmp_path / "b.0"), str(tmp_path / "b.1")], "c": [str(tmp_path / "c.zip")]}
    whole = (tmp_path / "a.zip").read_bytes()
    broken = bytearray(whole)
    broken[45:60] = b"\xff" * 15
    (tmp_path / "a.zip").write_bytes(bytes(broken))
    with pytest.raises(Exception):
        image_files.ingest(spark, root, zips, member_bytes=200)
    assert image_files.committed(spark, root, list(zips)).count() == 0 and [image_files.manifest(root, s) for s in zips] == [None] * 3
    left = [p for p in (tmp_path / "files").glob("*/run-*")]  # tasks that still ran may write after the run was given up
    assert sum(image_files.sweep(root, s) for s in zips) == len(left)
    (tmp_path / "a.zip").write_bytes(whole)
    told = image_files.ingest(spark, root, zips, member_bytes=200).collect()
    expected = {("a", f"d{i % 3}/{i}.png"): i + 1 for i in range(30)} | {("a", "up.png"): 40, ("a", "abs/x.PNG"): 41, ("a", "c/e.png"): 42, ("b", "x.png"): 2, ("b", "y.png"): 3}
    assert {(r["source"], r["rel_path"]): r["img_w"] for r in told} == expected and len(told) == len(expected)
    for r in told:
        raw = (tmp_path / "files" / r["stored"]).read_bytes()
        assert raw == png(r["img_w"]) and (len(raw), zlib.crc32(raw)) == (r["bytes"], r["crc"])
    assert sorted(r["rel_path"] for r in image_folder.list_images(spark, root, "s").collect()) == sorted(r["stored"] for r in told)
    assert image_files.manifest(root, "c")["files"] == 0 and image_files.manifest(root, "a")["files"] == 33
    monkeypatch.setattr(image_files, "list_members", None)
    assert image_files.ingest(spark, root, zips).count() == len(expected)
    monkeypatch.undo()
    # Another configuration of one source unpacks that one alone; what it replaces is swept when asked.
    before = {s: image_files.manifest(root, s)["run"] for s in zips}
    assert image_files.ingest(spark, root, zips | {"b": [str(tmp_path / "b.zip")]}).count() == len(expected)
    after = {s: image_files.manifest(root, s)["run"] for s in zips}
    assert {s for s in zips if before[s] != after[s]} == {"b"}
    assert image_files.sweep(root, "b") == 2 and image_files.sweep(root, "b") == 0
    assert image_files.committed(spark, root, ["b"]).count() == 2


def test_metrics_of_batches_and_streams(spark, tmp_path):
    """Counters, means and what a stream observes are rows of one table."""
    table = metrics.MetricTable(spark, str(tmp_path / "metrics"), "r1")
    rows = spark.range(100).withColumn("x", F.col("id") * 0.5)
    table.counted(rows, 3, n=F.count("*"), top=F.max("x"), none=F.max(F.lit(None).cast("double"))).write.format("noop").mode("overwrite").save()
    table.record()
    table.record()
    table.means(rows.groupBy((F.col("id") % 2).alias("step")).agg(F.avg("x").alias("x/mean")), "step")
    rows.where("id < 60").write.parquet(str(tmp_path / "in/a"))
    rows.where("id >= 60").coalesce(1).write.mode("append").parquet(str(tmp_path / "in/a"))
    listener = table.listener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/a")).observe("seen", F.count("*").alias("seen"), F.sum("x").alias("total"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        for _ in range(100):
            if table.read().where("name = 'seen'").count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = {(r["step"], r["name"]): r["value"] for r in table.read().where("name NOT IN ('seen', 'total', 'rows')").collect()}
    assert got == {(3, "n"): 100, (3, "top"): 49.5, (3, "none"): None, (0, "x/mean"): 24.5, (1, "x/mean"): 25.0}
    streamed = {r["name"]: r["v"] for r in table.read().where("name IN ('seen', 'total')").groupBy("name").agg(F.sum("value").alias("v")).collect()}
    assert streamed == {"seen": 100, "total": 2475.0} and {r["run"] for r in table.read().collect()} == {"r1"}


def test_page_lookup_moves_no_image(spark, tmp_path):
    """Pages lie in buckets: rows travel to them, and a table opened by its folder is the same."""
    pages = spark.range(500).select(F.col("id").alias("page_ordinal"), F.concat(F.lit("image "), "id").cast("binary").alias("image"), F.lit(1).alias("other"))
    path = str(tmp_path / "pages")
    kept = page_store.keep_in_buckets(pages, path, buckets=6)
    assert sorted(kept.collect()) == sorted(pages.collect())
    assert len([f for f in os.listdir(f"{path}/page_ordinal-6") if f.endswith(".parquet")]) == 6
    spark.sql(f"DROP TABLE {page_store._named(path + '/page_ordinal-6')}")
    kept = page_store.open_buckets(spark, path)
    names = [str(i * 7 % 600) for i in range(900)] + ["12x", "", None, "-3", "99999999999999999999", "7"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, image_path string")
    wanted = {(i, n, f"image {n}".encode()) for i, n in enumerate(names) if n and n.isdigit() and int(n) < 500}
    found = page_store.look_up(rows, kept)
    assert {(r["i"], r["image_path"], bytes(r["image"])) for r in found.collect()} == wanted and found.columns == ["i", "image_path", "image"]
    plan = found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan and "other" not in plan
    with pytest.raises(ValueError, match="0 finished"):
        os.remove(f"{path}/page_ordinal-6/_SUCCESS")
        page_store.open_buckets(spark, path)


def test_page_that_many_rows_ask_for(spark, tmp_path):
    """A third of all rows, alike but for repeats, asks for one page: none is lost or doubled, copies follow the rows."""
    pages = spark.range(60).select(F.col("id").alias("page_ordinal"), F.col("id").cast("string").cast("binary").alias("image"))
    kept = page_store.keep_in_buckets(pages, str(tmp_path / "p"), buckets=5)
    names = [str(i % 90) for i in range(400)] + ["7"] * 200 + ["8"] * 30
    rows = spark.createDataFrame([(n, 1) for n in names], "image_path string, x int")
    for hot in (1, 10, 29, 1000):
        got = Counter((r["image_path"], bytes(r["image"])) for r in page_store.look_up(rows, kept, hot_rows=hot).collect())
        assert got == Counter((n, n.encode()) for n in names if int(n) < 60)
    none = page_store.keep_in_buckets(pages.where("page_ordinal < 0"), str(tmp_path / "none"))
    assert page_store.look_up(rows, none).count() == 0 and page_store.look_up(rows.where("x > 1"), kept).count() == 0
