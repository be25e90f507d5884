"""Scoring and framing of streams: the same stateless expressions on Structured Streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.scoring import RewardRules, score
from gridloom.operators.elements import filter_frame
from gridloom.operators.encode import with_frame_boxes


def score_stream(completions: DataFrame, rules: RewardRules = RewardRules()) -> DataFrame:
    """A stream of (completion, target_bbox, ...) with a column per reward channel."""
    return score(completions, rules)


def frame_stream(elements: DataFrame) -> DataFrame:
    """A stream of element-frame rows, filtered and letterboxed."""
    return with_frame_boxes(filter_frame(elements))


def write_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only sink; the checkpoint makes it exactly-once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
