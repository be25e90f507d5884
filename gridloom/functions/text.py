"""Text expressions: Unicode strip, box parsing, prompt and answer rendering, file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt, the answer and the box pattern that models are trained and scored with.
PROMPT_TEMPLATE = 'Find the bounding box for the text: "{query}". Output format: <box> [x0, y0, x1, y1] </box>'
BOX_FORMAT = "<box> [{x0}, {y0}, {x1}, {y1}] </box>"
#: All characters that count as white space when text is stripped.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
BOX = rf"<box>{SPACE}*\[{SPACE}*" + rf"{SPACE}*,{SPACE}*".join([NUMBER] * 4) + rf"{SPACE}*\]{SPACE}*</box>"


def strip(text: Column) -> Column:
    """``text`` without white space at either end, Unicode white space included."""
    # The search for the end tries every place of a text, so it is made only where there is something to strip.
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")).otherwise(text)


def stripped_length(text: Column) -> Column:
    """Code points of the stripped text."""
    return F.char_length(strip(text))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def parse_box(text: Column) -> Column:
    """First box in the text as struct<x0, y0, x1, y1> of floats; null without one."""
    # One search of the text; the numbers are then read from what was found.
    numbers = F.regexp_extract_all(F.regexp_extract(text, BOX, 0), F.lit(NUMBER), F.lit(1))

    def box(found: Column) -> Column:
        parts = [F.get(found, F.lit(i)).try_cast("double").cast("float").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
        return F.when(F.size(found) == 4, F.struct(*parts))

    return F.get(F.transform(F.array(numbers), box), F.lit(0))


def is_one_box(text: Column) -> Column:
    """Whether the stripped text is a single box and nothing else."""
    return strip(text).rlike(rf"\A(?:{BOX})\z")


def completion_text(messages: Column) -> Column:
    """Contents of a list of messages, joined; a null content reads None."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("None"))), "")


def render_prompt(query: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """Literal replacement: neither quotes nor pattern characters of the query mean anything."""
    return F.replace(F.lit(template), F.lit("{query}"), query)


def render_answer(x0: Column, y0: Column, x1: Column, y1: Column, template: str = BOX_FORMAT) -> Column:
    """The box rounded half to even, in the answer format; a missing number reads null."""
    values = {f"{{{name}}}": F.coalesce(F.rint(c.cast("double")).cast("bigint").cast("string"), F.lit("null")) for name, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)}
    parts = re.split("(" + "|".join(map(re.escape, values)) + ")", template)
    return F.concat(*[values[part] if part in values else F.lit(part) for part in parts])


def chat_messages(prompt: Column, answer: Column | None = None) -> Column:
    """A user turn with image and instruction, and the assistant's answer where there is one."""

    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    turns = [F.struct(F.lit("user").alias("role"), F.array(part("image", F.lit(None).cast("string")), part("text", prompt)).alias("content"))]
    if answer is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), F.array(part("text", answer)).alias("content")))
    return F.array(*turns)
