"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` words; a shorter item is one window.  A window is in a
document where all its words follow one another there, so all its shingles (runs of five words, of
fewer in windows of fewer words) are there too: at full containment the necessary prefix of a
window's shingles, ordered by rarity, is the first one alone.

1. One pass over the documents finds the places of all shingles that windows hold.  A bit filter of
   bounded size, a literal of the plan, leaves out most others; a document without such a place
   keeps its counts only, others their words too.  The result is written.
2. The documents in which each shingle occurs are counted, and the rarest of a window is its
   prefix; a window with a shingle that no document has is out.
3. Places are joined to windows on the prefix.  The shingle's place in the window and in the
   document gives the only start the window can have; it must lie inside the document (position
   and length bounds), and then the words of the two windows are compared.
4. Per document, places of windows are merged to hit words, and windows lead to their items.

Windows with equal words are one, whichever items have them.  Windows are broadcast up to
``BROADCAST_WINDOWS`` of them; more are joined by shuffle, where a hot shingle is split by adaptive
joins.  What is collected per document is bounded by its words and by the items found in it.

Defined results: a null text, and one without words, has no words and no hits; an item without words
has no windows; an item is an id, so rows that repeat an id are one item, and those without id are
one whose name is empty; windows occur in whole texts, however long; repeated documents are judged
one by one; an empty table on either side gives no hits; extra columns are ignored by
:func:`contaminated` and pass through :func:`drop_contaminated`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of digits, small letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast: ten words of each, so some hundred MB at the very most.
BROADCAST_WINDOWS = 200_000
#: Bits of the filter, at least and at most, and bits looked at for a shingle.
LEAST_BITS, MOST_BITS, PROBES = 1 << 12, 1 << 22, 3


@dataclass(frozen=True)
class Containment:
    window: int = 10
    shingle: int = 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _shingle(words: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, start + k) for k in range(size)])


def _starts(words: Column, size: int) -> Column:
    """0-based starts of all runs of ``size`` words."""
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(none)


def _bits(h: Column, bits: int) -> list[Column]:
    """Places of a shingle in the filter."""
    return [F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit(bits - 1).cast("bigint")) for k in range(PROBES)]


def _power(at: Column) -> Column:
    """2 to the power of the last six bits of a place."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def item_windows(items: DataFrame, how: Containment, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(window, words) of distinct windows, and (window, item) of the items that have them."""
    listed = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_column)).alias("words"))
    listed = listed.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(how.window)))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.slice("words", i, F.col("size")))
    listed = listed.select("item", F.explode(runs).alias("words"))
    # Words hold no space, so joined words name a window.
    pairs = keep(listed.select("item", F.array_join("words", " ").alias("window"), "words").dropDuplicates(["item", "window"]), "windows")
    return pairs.select("window", "words").dropDuplicates(["window"]), pairs.select("window", "item")


def _window_shingles(windows: DataFrame, sizes: list[int], how: Containment) -> DataFrame:
    """window, words, h, p: every shingle of a window and its place there."""
    kind = "array<struct<p:int,h:bigint>>"
    out = F.array().cast(kind)
    for size in sizes:
        hashed = F.transform(_starts(F.col("words"), size), lambda p: F.struct(p.alias("p"), _shingle(F.col("words"), p, size).alias("h")))  # noqa: B023
        out = F.when(F.least(F.size("words"), F.lit(how.shingle)) == size, hashed.cast(kind)).otherwise(out)
    return windows.withColumn("_s", F.explode(out)).select("window", "words", "_s.h", "_s.p")


def _filter(shingles: DataFrame) -> np.ndarray:
    """The bit filter of all shingles, 64 bits a number.  At most MOST_BITS / 64 rows reach the driver."""
    distinct = shingles.select("h").distinct()
    bits, wanted = LEAST_BITS, 128 * distinct.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    at = distinct.select(F.explode(F.array(*_bits(F.col("h"), bits))).alias("at"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(_power(F.col("at"))).alias("bits")).collect():
        out[row["i"]] = row["bits"]
    return out


def _may_hold(h: Column, filled: np.ndarray) -> Column:
    table, out = F.lit(filled), F.lit(True)
    for at in _bits(h, 64 * len(filled)):
        out = out & (F.get(table, F.shiftright(at, 6).cast("int")).bitwiseAND(_power(at)) != 0)
    return out


def _scanned(docs: DataFrame, sizes: list[int], filled: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """row, id, n_words; with places of the filter's shingles (q, h) also those and the words."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), words_of(F.col(text_column)).alias("words"))

    def found(size: int) -> Column:
        hashed = F.transform(_starts(F.col("words"), size), lambda q: F.struct(q.alias("q"), _shingle(F.col("words"), q, size).alias("h")))
        return F.filter(hashed, lambda x: _may_hold(x["h"], filled))

    df = df.withColumn("places", F.concat(*[found(s) for s in sizes]) if sizes else F.array().cast("array<struct<q:int,h:bigint>>"))
    some = F.size("places") > 0
    return df.select("row", "id", F.size("words").cast("bigint").alias("n_words"), F.when(some, F.col("places")).alias("places"), F.when(some, F.col("words")).alias("words"))


def _occurrences(scanned: DataFrame, shingles: DataFrame, how: Containment, few: bool) -> DataFrame:
    """row, start, size, window of every window in every document."""
    reach = how.window - 1
    place = scanned.where("places IS NOT NULL").select("row", "n_words", "words", F.explode("places").alias("x"))
    place = place.select(
        "row", "n_words", F.col("x.q").alias("q"), F.col("x.h").alias("h"),
        # The words that a window through this place can have, and where they begin.
        F.greatest(F.col("x.q") - reach, F.lit(0)).alias("left"), F.slice("words", F.greatest(F.col("x.q") - reach, F.lit(0)) + 1, F.lit(2 * how.window)).alias("near"),
    )
    told = scanned.where("places IS NOT NULL").select("row", F.explode(F.array_distinct(F.transform("places", lambda x: x["h"]))).alias("h"))
    counts = told.groupBy("h").agg(F.count("*").alias("documents"))
    # The left join keeps shingles of no document at 0, so that they come first and end their window.
    ranked = shingles.join(F.broadcast(counts) if few else counts, "h", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    first = ranked.groupBy("window").agg(F.min_by(F.struct("h", "p", "words", "documents"), F.struct("documents", "p")).alias("f"))
    prefix = first.where("f.documents > 0").select("window", "f.h", "f.p", F.col("f.words").alias("wanted"))
    met = place.join(F.broadcast(prefix) if few else prefix, "h")
    start, size = F.col("q") - F.col("p"), F.size("wanted")
    inside = met.where((start >= 0) & (start + size <= F.col("n_words")))
    # left is q - reach, or 0 in the first words; the window begins p before q.
    proven = inside.where(F.slice("near", start - F.col("left") + 1, size) == F.col("wanted"))
    return proven.select("row", start.alias("start"), size.alias("size"), "window")


def _hit_words(spans: Column) -> Column:
    """Words inside sorted (start, size), each counted once."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["start"] + x["size"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], x["start"] + x["size"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def contaminated(
    docs: DataFrame, items: DataFrame, how: Containment | None = None, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text"
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated; and the names of the items, sorted."""
    how = how or Containment()
    windows, owners = item_windows(items, how, item_id_column, item_text_column)
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(how.shingle)).alias("n")).distinct().collect())  # how.shingle sizes at most
    shingles = _window_shingles(windows, sizes, how)
    scanned = keep(_scanned(docs, sizes, _filter(shingles), id_column, text_column), "scanned")
    few = windows.count() <= BROADCAST_WINDOWS
    found = keep(_occurrences(scanned, shingles, how, few), "occurrences")
    spans = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans")).select("row", _hit_words(F.col("spans")).alias("n_hit"))
    named = found.select("row", "window").distinct().join(F.broadcast(owners) if few else owners, "window").select("row", "item").distinct()
    listed = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = scanned.select("row", "id", "n_words").join(spans.join(listed, "row"), "row", "left")
    return out.select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, how: Containment | None = None, text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs``, unchanged, in which no window occurs."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_column).alias("_body"))
    judged = contaminated(rows, items, how, "_row", "_body", item_id_column, item_text_column)
    return judged.where("NOT contaminated").select("_row.*")
