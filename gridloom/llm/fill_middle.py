"""Fill-in-middle transformation by relational units.

A text is a row of units: matches of a pattern, from left to right; a code point that the pattern
does not match is a unit of its own, so units tile every text.  Units are exploded with their
position as runs of ``Units.run`` of them (a run is one match of the repeated pattern), windows
over the runs give the running sums of units and of code points, cut requests ask for a number of
units and are joined to the run of their last unit's ordinal, and the code points before each cut
are aggregated per document.  Two substrings then make prefix, middle and suffix.

What is cut is named by the SHA-256 of its id and text, on which alone the cuts depend, so nothing
rests on row numbers that a recomputed task may give anew, and rows that repeat each other combine
before they are shuffled.  Runs are a row of numbers per thousand units; texts are shuffled once, to
meet their cuts, in a join whose hot keys are split.

Defined results: a null text counts as empty; an empty text has no units and is plain; a null id is
drawn as an empty string; whole texts are cut, however long; rows that repeat an id are cut one by
one, and equal rows alike; an empty table gives an empty one; extra columns are ignored by
:func:`fill_middle_digests` and pass through :func:`fill_middle`, whose own columns replace those
of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import fenced, keep

#: Units of one code point.
CODE_POINTS = r"(?s:.)"


@dataclass(frozen=True)
class Units:
    pattern: str = CODE_POINTS
    #: Consecutive units that are one row.
    run: int = 1024

    @property
    def tile(self) -> str:
        """A unit, or the code point that starts none."""
        return self.pattern if self.pattern == CODE_POINTS else rf"(?:{self.pattern}|{CODE_POINTS})"

    @property
    def runs(self) -> str:
        # Possessive, which the pattern engine walks in a loop; a repeated group that may give back recurses.
        return rf"(?:{self.tile}){{1,{self.run}}}+"

    def count(self, text: Column) -> Column:
        return F.char_length(text) if self.pattern == CODE_POINTS else F.regexp_count(text, F.lit(self.tile))

    def length(self, text: Column, units: Column) -> Column:
        """Code points of the first ``units`` units of a run."""
        if self.pattern == CODE_POINTS:
            return units
        first = F.slice(F.regexp_extract_all(text, F.lit(self.tile), F.lit(0)), F.lit(1), units.cast("int"))
        return F.char_length(F.array_join(first, ""))


@dataclass(frozen=True)
class FillMiddle:
    units: Units = Units()
    seed: int = 1
    plain_percent: int = 10
    spm_percent: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix_mark, self.suffix_mark, self.middle_mark)
        borders = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b))))
        if len(set(marks)) < 3 or not all(marks) or borders or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("marks must differ, and neither hold nor overlap one another, or outputs cannot be taken apart")

    def draws(self, row_id: Column) -> list[Column]:
        """Four numbers below 2**32 that follow from the seed and an id."""
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"), 256)
        return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]

    def holds_mark(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix_mark)) | F.contains(text, F.lit(self.suffix_mark)) | F.contains(text, F.lit(self.middle_mark))


def _key(row_id: Column, text: Column) -> Column:
    """Name of an id and a text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"), 256))


def unit_runs(texts: DataFrame, units: Units) -> DataFrame:
    """_key, _ordinal, _id, _units, _chars (and _run where units are not code points) of every run, once for equal rows."""
    runs = texts.select(_key(F.col("_id"), F.col("_text")).alias("_key"), "_id", F.posexplode(F.regexp_extract_all("_text", F.lit(units.runs), F.lit(0))).alias("_ordinal", "_run"))
    runs = runs.select(
        "_key", "_ordinal", "_id", units.count(F.col("_run")).cast("bigint").alias("_units"), F.char_length("_run").cast("bigint").alias("_chars"),
        *([] if units.pattern == CODE_POINTS else ["_run"]),
    )
    return runs.dropDuplicates(["_key", "_ordinal"])


def cut_offsets(runs: DataFrame, how: FillMiddle) -> DataFrame:
    """_key, _n (units) and the code points before both cuts; texts without units have no row."""
    units, text = how.units, Window.partitionBy("_key")
    before = text.orderBy("_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    placed = runs.withColumns({"_units_before": F.coalesce(F.sum("_units").over(before), zero), "_chars_before": F.coalesce(F.sum("_chars").over(before), zero)})
    h1, h2, *_ = how.draws(F.col("_id"))
    totals = runs.groupBy("_key").agg(F.sum("_units").alias("_n"), F.max("_id").alias("_id"))
    a, b = (F.pmod(h, F.col("_n") + 1) for h in (h1, h2))
    wanted = totals.select("_key", "_n", F.posexplode(F.array(F.least(a, b), F.greatest(a, b))).alias("_cut", "_at"))
    # A cut after u units lies in the run of unit u - 1; one after none at the start of the first.
    wanted = wanted.withColumn("_ordinal", F.floor(F.greatest(F.col("_at") - 1, F.lit(0)) / units.run).cast("int"))
    met = wanted.join(placed, ["_key", "_ordinal"])
    run = F.col("_run") if units.pattern != CODE_POINTS else F.lit(None)
    offset = F.col("_chars_before") + units.length(run, F.col("_at") - F.col("_units_before"))
    return met.select("_key", "_n", "_cut", offset.alias("_offset")).groupBy("_key").agg(
        F.max("_n").alias("_n"),
        F.max(F.when(F.col("_cut") == 0, F.col("_offset"))).alias("_prefix_end"),
        F.max(F.when(F.col("_cut") == 1, F.col("_offset"))).alias("_middle_end"),
    )


def restored(output: Column, form: Column, how: FillMiddle) -> Column:
    """The text that an output of a form was made from."""
    first = F.when(form == "psm", F.lit(how.prefix_mark)).otherwise(F.lit(how.suffix_mark))
    second = F.when(form == "psm", F.lit(how.suffix_mark)).otherwise(F.lit(how.prefix_mark))
    cut, end = F.instr(output, second), F.instr(output, F.lit(how.middle_mark))
    opening = F.char_length(first) + 1
    a = F.substr(output, opening, cut - opening)
    b = F.substr(output, cut + F.char_length(second), end - cut - F.char_length(second))
    middle = F.substr(output, end + len(how.middle_mark))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


def _transformed(docs: DataFrame, how: FillMiddle, id_column: str, text_column: str, others: list[str]) -> DataFrame:
    """_id, the struct _others, n, form, prefix_chars, middle_chars, output."""
    _, _, h3, h4 = how.draws(F.col("_id"))
    rows = docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"), *([F.struct(*others).alias("_others")] if others else []),
    )
    offsets = cut_offsets(keep(unit_runs(rows, how.units), "runs"), how)
    cut = rows.withColumn("_key", _key(F.col("_id"), F.col("_text"))).join(offsets, "_key", "left")
    plain = F.col("_n").isNull() | how.holds_mark(F.col("_text")) | (h3 % 100 >= 100 - how.plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < how.spm_percent, "spm").otherwise("psm")
    cut = cut.withColumns({"form": form, "n": F.coalesce("_n", F.lit(0).cast("bigint"))})
    prefix = F.substr("_text", F.lit(1), F.col("_prefix_end").cast("int"))
    middle = F.substr("_text", (F.col("_prefix_end") + 1).cast("int"), (F.col("_middle_end") - F.col("_prefix_end")).cast("int"))
    suffix = F.substr("_text", (F.col("_middle_end") + 1).cast("int"))
    p, s, m = (F.lit(x) for x in (how.prefix_mark, how.suffix_mark, how.middle_mark))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("form") != "plain"
    return cut.withColumns(
        {
            "output": output,
            "prefix_chars": F.when(moved, F.col("_prefix_end")),
            "middle_chars": F.when(moved, F.col("_middle_end") - F.col("_prefix_end")),
        }
    )


def fill_middle(docs: DataFrame, how: FillMiddle | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with its text transformed, and n, form, prefix_chars and middle_chars beside it."""
    own = ("n", "form", "prefix_chars", "middle_chars")
    others = [c for c in docs.columns if c not in (id_column, text_column, *own)]
    df = _transformed(docs, how or FillMiddle(), id_column, text_column, others)
    picked = {id_column: F.col("_id"), text_column: F.col("output")}
    columns = [picked[c].alias(c) if c in picked else F.col("_others")[c].alias(c) for c in docs.columns if c not in own]
    return df.select(*columns, *own)


def fill_middle_digests(docs: DataFrame, how: FillMiddle | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: units, form, lengths in code points, and the digests of the output and of the text restored from it."""
    how = how or FillMiddle()
    # The output is made once: it is long, and both digests need it.
    df = fenced(_transformed(docs, how, id_column, text_column, []).select("_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return df.select(
        F.col("_id").alias(id_column), "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"), how)).alias("restored_sha256"),
    )
