"""Fill-in-middle, decontamination and vector codes against plain restatements."""

import random

import numpy as np
import pytest

from gridloom.llm import decontaminate, vector_codes
from gridloom.llm.decontaminate import Containment, contaminated, drop_contaminated
from gridloom.llm.fill_middle import FillMiddle, Units, fill_middle, fill_middle_digests
from gridloom.llm.vector_codes import Approximation, ProductCodes, compress

from . import brute

DOCS = "doc_id bigint, text string, n bigint, form string, _key string, row bigint, window int, items string, words int"
ODD = [
    (900, None), (901, ""), (902, " \n\t "), (903, "é ü 中文 \U0001f600\U0001f601 é"), (904, "one"), (905, "has <P> in it"), (906, "x<M>"), (907, "a<S><S"),
    (908, "<" * 50 + "S" + ">"), (None, "no id at all"), (None, "no id at all"), (909, "\U0001f600" * 3000), (910, "long words " * 4_000), (911, "\0nul\0"), (1, "of an id that repeats"),
]
COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, "z", 4) for i, t in rows], DOCS)


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 4, 9, 10, 11, 60, 400])))) for i in range(n)]


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def same(found, expected):
    assert sorted(found, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("run", [1, 7, 1024])
def test_fill_middle(spark, run):
    rows = texts(150, 1) + ODD
    same(tuples(fill_middle_digests(frame(spark, rows), FillMiddle(units=Units(run=run))), *COLUMNS), brute.fill_middle(rows))


@pytest.mark.parametrize("pattern, run", [(r"[^ \n]+[ \n]*", 3), (r"[^\n]*\n", 1024), (r"w[0-4]", 5), (r"(?:ab|a)", 2)])
def test_fill_middle_of_other_units(spark, pattern, run):
    """Words with the space behind them, lines, and units that do not cover the text."""
    rows = texts(60, 2) + ODD + [(920, "aabab" * 40), (921, "line\nline\n\nlast")]
    expected = brute.fill_middle(rows, rf"(?s:{pattern}|.)")
    same(tuples(fill_middle_digests(frame(spark, rows), FillMiddle(units=Units(pattern, run))), *COLUMNS), expected)


def test_fill_middle_keeps_columns(spark):
    rows = texts(20, 3) + ODD
    out = fill_middle(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "_key", "row", "window", "items", "words", "n", "form", "prefix_chars", "middle_chars"]
    digests = {(str(i), f, o) for i, _, f, _, _, o, _ in brute.fill_middle(rows)}
    found = out.collect()
    assert len(found) == len(rows) and {(str(r["doc_id"]), r["form"], brute.hashlib.sha256(r["text"].encode()).hexdigest()) for r in found} == digests
    assert all(tuple(r)[2:7] == ("y", 2, 3, "z", 4) for r in found)


def test_fill_middle_refuses_marks():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<P", "P<<", "<M>"), ("<P>", "<P>>", "<M>")):
        with pytest.raises(ValueError):
            FillMiddle(prefix_mark=marks[0], suffix_mark=marks[1], middle_mark=marks[2])


def planted(seed):
    """Items, and documents that hold windows of them whole, broken by a word, cut short, at both ends and overlapping."""
    rng = random.Random(seed)
    items = [(k, " ".join(f"b{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 5, 9, 10, 12, 30])))) for k in range(25)]
    items += [(7, "repeats the id seven with other words than before it had"), (None, "an item without an id has a name that is empty"), (None, "another such item of nobody"), (90, None), (91, ""), (92, "...!"), (93, items[3][1]), (94, "the the the the the the the the the the the the"), (95, "É 中文 Ünï")]
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 20, 90]))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            kind, at = rng.randrange(4), rng.randrange(len(words) + 1)
            if kind == 1 and w:
                w[rng.randrange(len(w))] = "broken"
            elif kind == 2:
                w = w[rng.randrange(3) : len(w) - rng.randrange(3)]
            words[at:at] = [x.upper() if kind == 3 else x for x in w]
        rows.append((i, rng.choice([" ", "-", "\n", "; "]).join(words)))
    rows += ODD + [(930, "the " * 40), (931, "x É中文ünï É, 中文; ünï"), (932, " ".join(t or "" for _, t in items) * 30)]
    return rows, items


@pytest.mark.parametrize("most, window, shingle, bits", [(200_000, 10, 5, 1 << 22), (0, 10, 5, 1 << 22), (0, 10, 5, 64), (200_000, 4, 2, 1 << 22)])
def test_contaminated(spark, monkeypatch, most, window, shingle, bits):
    """Broadcast and shuffled windows; a filter so full that it leaves nothing out."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    rows, items = planted(4)
    out = contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), Containment(window, shingle))
    expected = brute.contaminated(rows, items, window)
    assert 20 < sum(r[-1] for r in expected) < len(rows) - 20
    same(tuples(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), expected)


def test_contaminated_empty_sides(spark):
    docs, none = frame(spark, ODD), spark.createDataFrame([], "item_id bigint, text string")
    assert not contaminated(docs, none).where("contaminated OR n_hit > 0 OR n_items > 0").count() and contaminated(docs, none).count() == len(ODD)
    assert contaminated(frame(spark, []), spark.createDataFrame([(1, "one two")], "item_id bigint, text string")).count() == 0


def test_drop_contaminated(spark):
    rows, items = planted(5)
    clean = sorted((r[0] for r in brute.contaminated(rows, items) if not r[-1]), key=str)
    out = drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert out.columns == frame(spark, []).columns and sorted((r["doc_id"] for r in out.collect()), key=str) == clean


VECTORS = "vec_id bigint, label int, embedding array<float>, id int, code string, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, x, 1, "c", 2) for i, label, x in rows], VECTORS)


def made(n, width=32, seed=6, kind=float):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(4)), [float(np.float32(v)) for v in rng.normal(size=width)]) for i in rng.permutation(n)]
    rows += [(rows[k][0], None, rows[k][2]) for k in range(5)]  # repeated ids and vectors
    rows += [(3, 1, [float(np.float32(v)) for v in rng.normal(size=width)]), (None, None, [0.5] * width), (2000, 2, None), (2001, 2, [None] * width), (2002, 2, [float("nan")] * width), (2003, 3, [float("inf")] + [0.0] * (width - 1))]
    return rows


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("n, labels", [(400, 100_000), (30, 100_000), (90, 0)])
def test_vector_codes(spark, monkeypatch, n, labels):
    """More and fewer vectors than entries; labels broadcast and joined by shuffle."""
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", labels)
    rows = made(n)
    same(tuples(compress(vectors(spark, rows)), *CODES), brute.product_codes(rows))


def test_vector_codes_of_large_components(spark):
    rows = made(80, 16, 7) + [(5000 + k, 9, [float(np.float32(3e5 * (k + 1) * (-1) ** d)) for d in range(16)]) for k in range(6)]
    rows += [(-1, 9, [float(np.float32(1e8))] * 16)]
    same(tuples(compress(vectors(spark, rows)), *CODES), brute.product_codes(rows))


def test_vector_codes_of_odd_tables(spark):
    assert compress(vectors(spark, [])).count() == 0
    found = tuples(compress(vectors(spark, [(1, 1, [0.5] * 16), (2, 1, [0.5] * 32), (3, 1, []), (4, 2, [0.25] * 16)])), "vec_id", "code", "error")
    assert found == [(1, "00" * 16, 0), (2, None, None), (3, None, None), (4, "01" * 16, 0)]
    assert tuples(compress(vectors(spark, [(1, 1, [0.5] * 5)])), "vec_id", "code", "error", "label_error") == [(1, None, None, None)]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_cells_bound_distances(bits):
    """The filter never loses the nearest entry, and leaves most entries out."""
    rng = np.random.default_rng(bits)
    entries, x = (rng.integers(-300, 300, size=(n, 4)) for n in (64, 500))
    entries[7] = entries[3]
    index, distance, refined = Approximation(entries, bits).nearest(x)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert bits < 4 or refined < 0.2 * every.size
    assert ProductCodes().bits == 4
