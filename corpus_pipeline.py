"""Corpus pipeline: quality rules, near-duplicates, secrets, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept; its
result is written to the shared folder and read again.  All stages but the last return the columns
of ``documents``; the last returns the pieces of the packed sequences with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import forget, keep
from gridloom.llm.mixing import materialise
from gridloom.llm.near_dup import drop_near_duplicates
from gridloom.llm.packing import pack
from gridloom.llm.quality import keep_quality
from gridloom.llm.secrets import redact
from gridloom.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes; a null or unknown language is judged by character
    classes alone; whole texts are judged, however long; rows are judged one by one, so repeated rows
    and null ids stay or go alike; an empty table stays empty; columns of any name pass through.
    """
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id (null ids last).

    Rows without words stay; rows that repeat id and text are one document, rows of one id with unlike
    texts are two; whole texts are compared; an empty table stays empty; columns of any name pass through.
    """
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in their texts and ``n_chars`` follows; every document stays.

    Null and empty texts stay as they are, with their ``n_chars``; whole texts are scanned; repeated
    rows are masked alike; an empty table stays empty; columns of any name pass through.
    """
    return redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times, as whole rows.

    Rows without words weigh nothing and stay once; a null source is a source of its own; rows that
    repeat an id are mixed one by one, null ids too; an empty table stays empty; columns of any name
    pass through.
    """
    return materialise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids.

    A null or empty text is the end id alone; a long text gives whole sequences and a rest; rows that
    repeat an id, or have none, are packed one by one; an empty table gives no pieces; columns other
    than id and text are ignored.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: SQL can express neither the tokenizer nor the plan of the packing stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        forget(before)  # a table that no later stage reads; the input is none of ours
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
