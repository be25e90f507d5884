"""Connected components with Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import forget, keep


#: Edges that one task contracts in memory.
TASK_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars: each node with the least node it reaches inside the task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            parent[max(x, y)] = parent.setdefault(min(x, y), min(x, y))
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for every node of an edge.

    Every task first contracts a bounded number of edges to stars.  Then large-star and small-star
    steps alternate on (u, v) with u > v until every edge leads to a root; each step is a minimum
    per key and a join, and its result is written to the shared folder.
    """
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    parts = -(-clean.count() // TASK_EDGES)
    dealt = clean.repartition(parts) if parts > 1 else clean.coalesce(1)
    now = keep(dealt.mapInArrow(_contract, "u bigint, v bigint").distinct(), "stars", 12)
    while parts > 1 and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large", 12)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = keep(linked.unionByName(least.withColumnRenamed("m", "v")).where("u > v").distinct(), "small", 12)
        forget(now, large)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
