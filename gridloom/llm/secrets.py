"""Secret scan in DataFrame functions only: pattern kinds and sliding-window entropy.

Pattern kinds are found by regular expressions.  Positions come from the gaps: splitting a text
by a pattern gives what lies between its matches, so running lengths of gaps and matches are the
spans, in code points.

The entropy method looks at candidate runs of key-like characters.  A window slides over each
candidate; the counts of the characters inside it, packed into a few 64-bit numbers, are updated by
the one that enters and the one that leaves, and so is the sum of c*log2(c), kept as fixed-point
integers so that the result does not depend on the order of additions.  The entropy of a window of W
characters is log2(W) - sum/W.  Each character class has its own threshold.  Candidates on the allow
list, which speaks of whole candidates only, and those that lie inside a pattern span are not
reported; one that reaches beyond a pattern span is scored and reported whole.

Local to a row, no shuffle.  Time grows with a text's length, and with n*log(n) of its n matches:
running sums double their reach a round, spans are looked up by bisection, texts are cut from blocks
that lie near, and every repeated group of a pattern is possessive, so that the pattern engine walks
it in a loop however long the candidate.

Defined results: a null text counts as empty; an empty text has no spans; whole texts are scanned
whatever their length; repeated rows give repeated results; an empty table gives an empty one;
clashing extra columns are ignored by :func:`find_secrets` and passed through by :func:`redact`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fenced

SCALE = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# The patterns of the base kinds, in their order, with the group and least length a match needs.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Three short humps in a row: letters of random case, not words in camel case.
SHUFFLED_CASE = r"[A-Z][a-z]{1,2}[A-Z]+[a-z]{1,2}[A-Z]+[a-z]"
#: Whole candidates that are no secrets, each with a pattern that takes the leave back: prose, slugs and
#: identifiers, numbers, UUIDs, paths of words
#: with short numbers, the key that documentations show, fillers, one repeated character.
ALLOWED = (
    (r"^[A-Za-z_/+=-]+$", SHUFFLED_CASE),
    (r"^[0-9_/+=-]+$", None),
    (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", None),
    (r"^/?([A-Za-z]+[0-9]{0,4}[/_-])++([A-Za-z]+[0-9]{0,4}|[0-9]{1,8})?/?$", SHUFFLED_CASE),
    (r"^[A-Za-z0-9/+]*(EXAMPLE|example)(KEY|key)?$", None),
    (r"^((x{4,}|X{4,}|0{4,}|(1234567890)++|1234567)[_/+=-]*)++$", None),
    (r"^(.)\1+$", None),
)
#: Characters of the blocks that texts are cut from.
BLOCK = 4096


@dataclass(frozen=True)
class EntropyRules:
    window: int = 20
    thresholds: dict[str, float] = field(default_factory=lambda: {"hex": 2.9, "alnum": 3.6, "base64": 3.8})
    allowed: tuple[tuple[str, str | None], ...] = ALLOWED


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """``both`` of every value and all before it; the reach doubles each round."""

    def doubled(done: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(done, lambda x, i: F.coalesce(both(x, F.get(done, i - reach)), x))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)
    return F.when(F.size(values) > 1, F.aggregate(rounds, values, doubled)).otherwise(values)


def _matches(df: DataFrame, text: str, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """``df`` with the matches of ``pattern`` whose ``group`` has ``least`` characters or more: array<struct<s, e, t>>."""
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    found = F.col(text).rlike(pattern)
    whole, wanted = (F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(g))) for g in (0, group))
    gaps = F.when(found, F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)))
    df = df.withColumns({"_whole": whole, "_wanted": wanted, "_gaps": gaps})
    steps = F.transform("_whole", lambda m, i: F.char_length(m) + F.get("_gaps", i))
    df = df.withColumn("_ends", _running(steps, lambda x, before: x + before))
    spans = F.transform("_whole", lambda m, i: F.struct((F.get("_ends", i) - F.char_length(m)).alias("s"), F.get("_ends", i).alias("e"), m.alias("t")))
    kept = F.filter(spans, lambda x, i: F.char_length(F.get("_wanted", i)) >= least)
    return df.withColumn(name, F.coalesce(kept.cast("array<struct<s:int,e:int,t:string>>"), none)).drop("_whole", "_wanted", "_gaps", "_ends")


def _up_to(spans: str, place: Column) -> Column:
    """How many of the sorted spans start at ``place`` or before, by bisection."""
    n = F.size(spans)

    def halved(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = (acc["low"] < acc["high"]) & (F.get(spans, middle)["s"] <= place)
        return F.struct(F.when(right, middle + 1).otherwise(acc["low"]).alias("low"), F.when(right, acc["high"]).otherwise(middle).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double") + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), n.alias("high")), halved, lambda acc: acc["low"])


def _uncovered() -> Column:
    """Candidates, less those that a pattern span covers.

    A candidate is all of a run, and the characters of hexadecimal and access keys are among its own:
    such a span that covers it is the candidate.  Assignments do not overlap, so the last that starts
    at the candidate or before is the only one that can cover it.
    """
    return F.filter(
        "_runs",
        lambda c: ~c["t"].rlike(r"^[0-9a-f]+$") & ~c["t"].rlike(r"^AKIA[A-Z0-9]{14,}$") & ~F.coalesce(F.get("_assign", _up_to("_assign", c["s"]) - 1)["e"] >= c["e"], F.lit(False)),
    )


def _least_sum(codes: Column, window: int) -> Column:
    """Least sum of c*log2(c), in units of 1/SCALE, of any full window; null if the run is shorter."""
    table = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0).cast("bigint") for c in range(window + 1)])
    bits = window.bit_length()
    held = 63 // bits  # counts in a number
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), -(-len(ALPHABET) // held)).alias("n"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(None).cast("bigint").alias("best"),
    )
    number = lambda code: F.floor(code / held).cast("int")
    shift = lambda code: F.pmod(code, F.lit(held)) * bits

    def count(n: Column, code: Column) -> Column:
        word = F.call_function("shiftright", F.get(n, number(code)), shift(code))
        return word.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")

    def step(acc: Column, i: Column) -> Column:
        enters, leaves = F.get(codes, i), F.get(codes, i - window)
        one = lambda code, k: F.when(number(code) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift(code))).otherwise(F.lit(0).cast("bigint"))
        n_in, n_out = count(acc["n"], enters), count(acc["n"], leaves)
        grown = F.get(table, n_in + 1) - F.get(table, n_in)
        shrunk = F.coalesce(F.get(table, n_out - 1) - F.get(table, n_out), F.lit(0).cast("bigint"))
        stays = F.coalesce(enters == leaves, F.lit(False))
        total = acc["sum"] + F.when(stays, F.lit(0).cast("bigint")).otherwise(grown + shrunk)
        counts = F.when(stays, acc["n"]).otherwise(F.transform(acc["n"], lambda v, k: v + one(enters, k) - one(leaves, k)))
        best = F.when(i >= window - 1, F.least(acc["best"], total)).otherwise(acc["best"])
        return F.struct(counts.alias("n"), total.alias("sum"), best.alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])


def _class_of(t: Column) -> Column:
    return F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def _scanned(docs: DataFrame, text_column: str, rules: EntropyRules) -> DataFrame:
    """``docs`` with ``_spans``: array<struct<s, k, e>> of every span, ordered by start and kind."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_column), F.lit("")))
    for name, pattern, group, least in KINDS:
        df = _matches(df, "_text", f"_{name}", pattern, group, least)

    def of_kind(name: str, kind: int) -> Column:
        return F.transform(f"_{name}", lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))

    base = F.concat(*[of_kind(name, kind) for kind, (name, *_) in enumerate(KINDS)])
    df = _matches(df.withColumn("_base", F.sort_array(base)), "_text", "_runs", CANDIDATE, 0, 1)
    df = df.withColumn("_candidates", F.when(F.size("_runs") > 0, _uncovered()).otherwise(F.col("_runs"))).drop("_runs")

    def allowed(t: Column) -> Column:
        out = F.lit(False)
        for pattern, unless in rules.allowed:
            out = out | (t.rlike(pattern) if unless is None else t.rlike(pattern) & ~t.rlike(unless))
        return out

    def places(t: Column) -> Column:
        return F.transform(F.slice(F.split(t, ""), F.lit(1), F.char_length(t)), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)

    coded = F.transform(
        F.filter("_candidates", lambda c: ~allowed(c["t"])),
        lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), _class_of(c["t"]).alias("class"), places(c["t"]).alias("codes")),
    )
    df = df.withColumn("_coded", F.when(F.size("_candidates") > 0, coded))
    def limit(c: Column) -> Column:
        out = F.lit(None).cast("bigint")
        for name, least in rules.thresholds.items():
            most = math.floor((math.log2(rules.window) - least) * rules.window * SCALE)
            out = F.when(c["class"] == name, F.lit(most).cast("bigint")).otherwise(out)
        return out

    scored = F.transform(
        "_coded",
        lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.coalesce(_least_sum(c["codes"], rules.window) <= limit(c), F.lit(False)).alias("hit")),
    )
    df = df.withColumn("_scored", F.when(F.size("_coded") > 0, scored))
    found = F.transform(F.filter("_scored", lambda c: c["hit"]), lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS)).alias("k"), c["e"].alias("e")))
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    df = df.withColumn("_spans", F.when(F.size("_scored") > 0, F.sort_array(F.concat("_base", found))).otherwise(F.coalesce("_base", empty)))
    return df.drop("_candidates", "_coded", "_scored")


def _rendered(spans: str) -> Column:
    names = F.array(*[F.lit(name) for name, *_ in KINDS], F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: EntropyRules | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans."""
    rules = rules or EntropyRules()
    df = _scanned(docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_raw")), "_raw", rules)
    out = df.select(
        F.col("_id").alias(id_column),
        *[F.size(f"_{name}").cast("bigint").alias(f"n_{name}") for name, *_ in KINDS],
        F.sha2(_rendered("_base").cast("binary"), 256).alias("base_sha256"),
        _rendered("_spans").alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("bigint").alias("n_entropy"),
    )
    return fenced(out)


def redact(docs: DataFrame, rules: EntropyRules | None = None, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans count as one.

    Rows without spans, null texts included, and all other columns stay as they are.
    """
    rules = rules or EntropyRules()
    names = docs.columns
    df = _scanned(docs.select(F.struct("*").alias("_row"), F.col(text_column).alias("_raw")), "_raw", rules)
    # The furthest end of a span and all before it; a span that starts beyond it opens a new hole.
    df = df.withColumn("_reach", _running(F.transform("_spans", lambda x: x["e"]), F.greatest))
    before = lambda i: F.coalesce(F.get("_reach", i - 1), F.lit(0))
    opens = F.filter(F.transform("_spans", lambda x, i: F.struct(before(i).alias("a"), x["s"].alias("b"))), lambda x: x["a"] <= x["b"])
    blocks = F.when(F.size("_spans") > 0, F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    df = df.withColumns({"_opens": opens, "_blocks": blocks})

    def part(a: Column, b: Column) -> Column:
        """Characters a to b of the text, from the blocks in which they lie."""
        first, last = (F.floor(x / BLOCK).cast("int") for x in (a, b))
        return F.substr(F.array_join(F.slice("_blocks", first + 1, last - first + 1), ""), F.pmod(a, F.lit(BLOCK)) + 1, b - a)

    parts = F.transform("_opens", lambda x: F.concat(part(x["a"], x["b"]), F.lit(mark)))
    end = F.element_at("_reach", -1)
    pieces = F.concat(F.array_join(parts, ""), part(end, F.char_length("_text")))
    cleaned = F.when(F.size("_spans") > 0, pieces).otherwise(F.col("_raw"))
    return fenced(df.select(*[(cleaned if c == text_column else F.col("_row")[c]).alias(c) for c in names]))
