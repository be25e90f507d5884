"""Metrics as a table: counters and means of batch plans and of streams, a row each.

Batch plans count on the way (:meth:`MetricTable.counted`), so no table is read twice for its counters;
frames of means, one row a step, are turned into rows by Spark; streams report what they observe after
every micro-batch through a listener.  All append to one Parquet table, which is read like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "run string, step bigint, name string, value double"


class MetricTable:
    """Rows (run, step, name, value) of one run, appended below ``path``."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run
        self._open: list[tuple[int, Observation]] = []

    def counted(self, df: DataFrame, step: int = 0, **counters: Column) -> DataFrame:
        """``df``; once an action has run over it, :meth:`record` writes its counters."""
        seen = Observation()
        self._open.append((step, seen))
        return df.observe(seen, *[c.alias(name) for name, c in counters.items()])

    def record(self) -> None:
        """Write the counters of the plans that have run; waits for those that are running."""
        told, self._open = self._open, []
        self._append([(step, name, value) for step, seen in told for name, value in seen.get.items()])

    def means(self, frame: DataFrame, step: str | None = None) -> None:
        """Write a frame of numbers, one row a step (or one row), a metric per column."""
        names = [c for c in frame.columns if c != step]
        at = F.col(f"`{step}`").cast("bigint") if step else F.lit(0).cast("bigint")
        listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])
        rows = frame.select(F.lit(self.run).alias("run"), at.alias("step"), F.explode(listed).alias("m"))
        rows.select("run", "step", "m.name", "m.value").write.mode("append").parquet(self.path)

    def listener(self) -> StreamingQueryListener:
        """Writes what the session's streams observe, the number of the micro-batch as the step."""
        table = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                pass

            def onQueryProgress(self, event) -> None:
                progress = event.progress
                rows = [(progress.batchId, name, value) for seen in progress.observedMetrics.values() for name, value in seen.asDict().items()]
                table._append([*rows, (progress.batchId, "rows", progress.numInputRows)] if rows else [])

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                pass

        return Listener()

    def _append(self, rows: Sequence[tuple[int, str, float | int | None]]) -> None:
        """A handful of rows: one for each counter of a plan, whatever its size."""
        if rows:
            told = [(self.run, int(step), name, None if value is None else float(value)) for step, name, value in rows]
            self.spark.createDataFrame(told, METRICS).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(METRICS).parquet(self.path)
