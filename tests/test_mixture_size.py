"""Mixtures and shuffles whose work follows their rows: each computed, moved and ranked once (F2)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom import fixtures as fx
from gridloom import registry
from gridloom.config import Config, override
from gridloom.functions.text import render_answer, strip
from gridloom.operators import elements, order
from gridloom.plans import datasets

SF = "/root/testdata/sf0.001"


def test_shuffle_ranks_rows_once(spark):
    """Positions follow the digests, and a reader of them neither moves nor ranks a row again."""
    df, n = order.counted_shuffle(spark.range(3000).withColumn("v", F.lit("x")), ["id"], 17)
    digests = sorted((hashlib.md5(f"{i}|17".encode()).hexdigest(), i) for i in range(3000))
    assert n == 3000 and df.columns == ["id", "v", "pos"]
    assert [r["id"] for r in df.orderBy("pos").collect()] == [i for _, i in digests]
    plan = order.shuffled(spark.range(50), ["id"], 17)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "_digest" not in plan
    assert order.counted_shuffle(spark.range(0), ["id"], 17)[1] == 0
    # Rows without a key keep their places too, rows that repeat each other are all there.
    odd = spark.createDataFrame([(None,), (None,), (5,), (5,)], "id bigint")
    assert sorted(r["pos"] for r in order.shuffled(odd, ["id"], 17).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("few", [1, 3])
def test_repeats_of_few_rows_are_many_tasks(spark, few):
    """A child of few rows gives most of the mixture; its picks are made by all cores."""
    children = [spark.range(n, numPartitions=1).select(F.col("id").alias("row_key")) for n in (2000, few)]
    mixed = order.mixed_rows(children, ["row_key"], [0.1, 0.9], 5)
    assert sorted(r["pos"] for r in mixed.select("pos").collect()) == list(range(20000))
    repeated = mixed.where("child = 1").select("row_key", "pick", F.spark_partition_id().alias("task"))
    tasks = repeated.groupBy("task").count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 12000
    assert sorted(r["pick"] for r in repeated.collect()) == list(range(18000))
    per = [r["count"] for r in repeated.groupBy("row_key").count().collect()]
    assert len(per) == few and max(per) - min(per) <= 1


def test_rows_of_a_child_that_is_cut(spark):
    """Fewer picks than rows: each row at most once."""
    children = [spark.range(n).select(F.col("id").alias("row_key")) for n in (700, 900)]
    rows = order.mixed_rows(children, ["row_key"], [0.7, 0.3], 5).collect()
    cut = [r for r in rows if r["child"] == 1]
    assert sorted(r["pos"] for r in rows) == list(range(1000)) and sorted(r["pick"] for r in cut) == list(range(300))
    assert len({r["row_key"] for r in cut}) == 300


@pytest.mark.parametrize(("by", "times"), [("row", 1), ("image", 2)])
def test_build_orders_each_corpus_once(spark, monkeypatch, by, times):
    """Numbers of the shuffle are the mixture's: nothing is ranked and written again, but where whole images leave gaps."""
    labels, kept = [], order.written
    monkeypatch.setattr(order, "written", lambda df, label: labels.append(label) or kept(df, label))
    cell, ui = registry.cell_frame(spark, SF), fx.ui_frame(spark, SF)
    labels.clear()
    keys = [*fx.UI_KEYS, "x0", "y0"]
    train, held = datasets.build(ui, keys, cell, list(elements.FRAME_COLUMNS[:6]), override(Config(), {"holdout_by": by}))
    assert labels.count("shuffled") == 1 and labels.count("ordinal") == times
    n = elements.filter_frame(ui).count()
    first = train.where("child = 0")
    size = n - held.count()
    assert sorted(r["pick"] for r in first.select("pick").collect()) == list(range(size)) and first.select("row_key").distinct().count() == size
    # The permutation's argument is the rank of a row among those that are not held out.
    nth = {r["row_key"]: i for i, r in enumerate(first.select("row_key").orderBy("row_key").collect())}
    seed = Config().seed
    to = {r["id"]: r["to"] for r in order.permuted(spark.range(size), F.col("id"), size, f"0|{seed}", "to").collect()}
    assert all(r["pick"] == to[nth[r["row_key"]]] for r in first.select("row_key", "pick").collect())


def test_cell_text_is_stripped_once(spark):
    """Filters read the stripped text; none strips the cell's own again."""
    plan = registry.filter_cells(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip("+-: ").startswith("Filter") and ".text" in line]


def test_strip_at_every_space(spark):
    """As Python strips, for every character of the first plane at either end, inside and alone."""
    rows = [(chr(i), f"{chr(i)}a {chr(i)}b{chr(i)}{chr(i)}") for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([*rows, ("", ""), ("\U0001f600", " \U0001f600 "), (None, None)], "one string, more string")
    found = df.select("one", "more", strip(F.col("one")).alias("s"), strip(F.col("more")).alias("t")).collect()
    assert not [r for r in found if r["one"] is not None and (r["s"] != r["one"].strip() or r["t"] != r["more"].strip())]
    assert [(r["s"], r["t"]) for r in found if r["one"] is None] == [(None, None)]


def test_answers_round_half_to_even(spark):
    df = spark.createDataFrame([(0.5, 1.5, 2.5, 1023.4999), (-0.5, -1.5, 0.49999999999999994, 3.5)], "a double, b double, c double, d double")
    answers = [r[0] for r in df.select(render_answer(*[F.col(c) for c in "abcd"])).collect()]
    assert answers == ["<box> [0, 2, 2, 1023] </box>", "<box> [0, -2, 0, 4] </box>"]
    # Names may come in any order and twice, and other signs of a template mean nothing; a missing number is told.
    odd = render_answer(*[F.col(c) for c in "abc"], F.lit(None).cast("double"), "100% {y0} {x0} {y0} %d {x1}{y1}")
    assert [r[0] for r in df.select(odd).collect()] == ["100% 2 0 2 %d 2null", "100% -2 0 -2 %d 0null"]
