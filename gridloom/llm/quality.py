"""Quality rules by distribution divergence, in DataFrame functions only.

Each document is held against the reference of its language: the histogram of character classes
and the histogram of common words.  Both are compared by Jensen-Shannon divergence (base 2, so
0..1; the distance is its root).  Short documents have noisy histograms, so below ``min_words``
the divergence says nothing and only the counting rules apply.

Everything is local to a row: one scan, no shuffle, whatever the size or the skew of the table.

Defined results: a null text counts as empty; an empty text has zero counts and fails the rules;
a null or unknown ``lang`` is judged by the character classes of a fallback language alone, and only
where at least half of the letters have case, as no reference here speaks of other scripts: such texts
have no divergence and the counting rules decide; rows are judged one by one,
so repeated rows give repeated results and an empty table gives an empty one.  Columns of the
input that clash with result columns are ignored: the result carries ``id_column`` and its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, fenced

# The forty words that ordinary prose uses most, with about the percentage of running
# words that each takes; rounded from general knowledge of the languages, not fitted to any table.
_PERCENT_OF_WORDS = {
    "en": """the 5.6 of 2.9 and 2.6 to 2.5 a 2.1 in 1.9 that 1.1 is 1.0 it 1.0 for 0.9 was 0.9 on 0.7 with 0.7 as 0.7 be 0.6 he 0.6 i 0.6
        by 0.55 are 0.5 this 0.5 at 0.5 from 0.45 have 0.45 his 0.45 not 0.45 or 0.4 had 0.4 but 0.4 you 0.4 they 0.35 which 0.35 an 0.35
        were 0.3 we 0.3 her 0.3 she 0.3 all 0.3 will 0.3 one 0.3 there 0.25""",
    "de": """der 3.5 die 3.4 und 2.8 in 1.9 den 1.2 von 1.0 zu 1.0 das 1.0 mit 0.9 ist 0.9 sich 0.8 des 0.8 auf 0.8 für 0.8 im 0.8 nicht 0.8
        dem 0.7 ein 0.7 eine 0.7 sie 0.7 als 0.6 auch 0.6 es 0.6 an 0.5 werden 0.5 aus 0.5 er 0.5 hat 0.5 dass 0.4 nach 0.4 wird 0.4 bei 0.4
        einer 0.4 sind 0.4 wie 0.35 um 0.3 am 0.3 noch 0.3 einem 0.3 über 0.3""",
    "fr": """de 4.9 la 2.8 le 2.2 et 2.1 les 1.8 à 1.6 des 1.5 en 1.2 du 1.1 un 1.0 que 1.0 une 0.9 est 0.9 qui 0.9 pour 0.8 dans 0.8 il 0.8 a 0.8
        au 0.7 par 0.6 pas 0.6 sur 0.6 ne 0.6 avec 0.5 ce 0.5 se 0.5 je 0.5 plus 0.4 son 0.4 on 0.4 vous 0.4 sa 0.35 mais 0.35 ou 0.35
        elle 0.35 nous 0.35 sont 0.3 aux 0.3 cette 0.3 été 0.25""",
    "es": """de 5.2 la 3.2 que 2.9 el 2.8 en 2.5 y 2.4 a 1.9 los 1.5 se 1.1 del 1.1 las 1.0 un 1.0 por 0.9 con 0.9 no 0.9 es 0.9 una 0.8 su 0.7
        para 0.6 al 0.6 lo 0.6 como 0.5 más 0.5 o 0.4 le 0.4 pero 0.35 ha 0.35 me 0.35 sus 0.3 si 0.3 sin 0.3 sobre 0.3 este 0.3 ya 0.3
        entre 0.25 cuando 0.25 todo 0.25 esta 0.25 ser 0.25 son 0.25""",
}
# About the percentage of characters of each class in ordinary prose, of the same origin.
CLASSES = ("lower", "upper", "digit", "space", "other")
_PERCENT_OF_CHARACTERS = {"en": (77.5, 2.5, 0.5, 16.5, 3.0), "de": (77.0, 5.5, 0.5, 14.0, 3.0), "fr": (76.5, 2.5, 0.5, 16.5, 4.0), "es": (77.5, 2.2, 0.5, 16.5, 3.3)}


def _shares(text: str) -> dict[str, float]:
    parts = text.split()
    return {w: round(float(p) / 100, 6) for w, p in zip(parts[::2], parts[1::2], strict=True)}


COMMON_WORDS = {lang: _shares(text) for lang, text in _PERCENT_OF_WORDS.items()}
CHARACTER_CLASSES = {lang: tuple(round(p / 100, 6) for p in row) for lang, row in _PERCENT_OF_CHARACTERS.items()}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    guard_words: int = 50
    max_class_divergence: float = 0.06
    max_word_divergence: float = 0.125
    #: Sampling noise of the word histogram falls as 1/n; so much is allowed on top, over n words.
    word_noise: float = 3.5
    common_words: dict[str, dict[str, float]] = field(default_factory=lambda: COMMON_WORDS)
    classes: dict[str, tuple[float, ...]] = field(default_factory=lambda: CHARACTER_CLASSES)
    #: Language whose character classes judge texts of a null or unknown language in a script with case.
    fallback: str = "en"


def js_divergence(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of shares."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2.0 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(shares, reference, lambda p, q: 0.5 * (half(p, q) + half(q, p)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def with_rest(shares: Column) -> Column:
    """The shares and what they leave of the whole."""
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), 1.0 - F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x))))


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _with_counts(df: DataFrame, rules: QualityRules) -> DataFrame:
    w = rules.window
    longest = max((len(x) for words in rules.common_words.values() for x in words), default=0)
    df = df.select("_id", "_lang", "_text", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    # One hash per window; windows of one text are compared by 64 bits.
    windows = F.when(
        F.size("_words") >= w,
        F.transform(
            F.slice("_words", F.lit(1), F.size("_words") - (w - 1)),
            lambda x, i: F.xxhash64(x, *[F.get("_words", i + k) for k in range(1, w)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return df.select(
        "_id",
        "_lang",
        "_text",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        # Longer words are none of the common ones; those that stay are two spaces apart.
        F.array_join(F.filter("_words", lambda x: F.char_length(x) <= longest), "  ").alias("_joined"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )


def _with_repeats(df: DataFrame, window: int) -> DataFrame:
    """n_repeat_words: words inside windows that occur twice or more in their text."""
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.select(
        *[c for c in df.columns if c != "_windows"],
        F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"),
    )

    def repeated(x: Column, j: Column) -> Column:
        before, after = F.get("_sorted", j - 1), F.get("_sorted", j + 1)
        return ((j > 0) & (before["h"] == x["h"])) | F.coalesce(after["h"] == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("_sorted", repeated), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + (p + window - F.greatest(acc["end"], p))).alias("n"), (p + window).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return df.select(
        *[c for c in df.columns if c != "_sorted"],
        F.when(F.col("_sorted").isNull(), F.lit(0).cast("bigint")).otherwise(covered).alias("n_repeat_words"),
    )


def _class_shares() -> Column:
    """Shares of the named character classes; null for an empty text."""
    size = F.char_length("_text").cast("double")
    runs = [r"\P{Ll}+", r"\P{Lu}+", r"\P{Nd}+"]
    counts = [F.char_length(F.regexp_replace("_text", r, "")) for r in runs] + [F.char_length("_text") - F.col("word_chars")]
    return F.when(size > 0, F.array(*[c / size for c in counts]))


def _has_case() -> Column:
    """At least half of the letters are small or capital ones."""
    count = lambda others: F.char_length(F.regexp_replace("_text", others, ""))
    return 2 * count(r"[^\p{Ll}\p{Lu}]+") >= count(r"\P{L}+")


def _by_language(table: dict, pick, otherwise: Column | None = None) -> Column:
    out: Column = F.lit(None) if otherwise is None else otherwise
    for lang, reference in table.items():
        out = F.when(F.col("_lang") == lang, pick(reference)).otherwise(out)
    return out


def _word_shares() -> Column:
    """Shares of the language's common words; null without a reference.

    ``_padded`` holds words two spaces apart, so that neighbours share no separator and the bytes
    that a removal saves are a count.
    """
    return F.transform(
        "_common",
        lambda w: (F.octet_length("_padded") - F.octet_length(F.replace("_padded", F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))))
        / (F.octet_length(w) + 2).cast("double")
        / F.col("n_words").cast("double"),
    )


def quality_signals(
    docs: DataFrame,
    rules: QualityRules | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str | None = "lang",
) -> DataFrame:
    """Counts, divergences and verdict per row; see the module for the defined cases."""
    rules = rules or QualityRules()
    lang = F.col(lang_column) if lang_column else F.lit(None).cast("string")
    df = docs.select(F.col(id_column).alias("_id"), lang.alias("_lang"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    df = _with_repeats(_with_counts(df, rules), rules.window)
    df = df.select(
        "*",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
    )
    judged = F.col("n_words") >= rules.guard_words
    df = df.select(
        *[c for c in df.columns if c not in ("_text", "_lines", "_joined")],
        F.when(judged, _class_shares()).alias("_classes"),
        F.when(judged, F.concat(F.lit(" "), F.lower("_joined"), F.lit(" "))).alias("_padded"),
        _by_language(rules.common_words, lambda words: F.array(*[F.lit(w) for w in words])).alias("_common"),
        _by_language(rules.common_words, lambda words: _doubles([*words.values(), 1.0 - sum(words.values())])).alias("_expected"),
        _by_language(rules.classes, _doubles, F.when(judged & _has_case(), _doubles(rules.classes[rules.fallback]))).alias("_expected_classes"),
    )
    df = df.select("*", F.when(judged, _word_shares()).alias("_words"))
    df = df.select(
        "*",
        js_divergence(with_rest(F.col("_classes")), F.col("_expected_classes")).alias("class_divergence"),
        js_divergence(with_rest(F.col("_words")), F.col("_expected")).alias("word_divergence"),
    )
    too_far = F.coalesce(F.col("class_divergence") > rules.max_class_divergence, F.lit(False)) | F.coalesce(
        F.col("word_divergence") > rules.max_word_divergence + rules.word_noise / F.col("n_words"), F.lit(False)
    )
    return fenced(df.select(
        F.col("_id").alias(id_column),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~too_far).alias("kept"),
        "class_divergence", "word_divergence",
    ))


def keep_quality(docs: DataFrame, rules: QualityRules | None = None, text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """The rows of ``docs``, unchanged, that the rules keep."""
    lang = F.col(lang_column) if lang_column and lang_column in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_column).alias("_body"), lang.alias("_language"))
    judged = quality_signals(rows, rules, id_column="_row", text_column="_body", lang_column="_language")
    return judged.where("kept").select("_row.*")
