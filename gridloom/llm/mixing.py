"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that each belongs to.  The flow
network has a quota per source, an edge from a source to every pattern that holds it, and for each
pattern one edge per copy of its documents, of the pattern's size, whose costs rise convexly.  The
cheapest flow meets the quotas with as little repetition as there can be.  Only the patterns reach
the driver: one row per distinct set of sources, never one per document.

What flows into a pattern is turned into documents: whole copies for all, and one more copy for
the first documents of a seeded order until the flow is spent.  Where that order stops is found by
a radix search on the seeded keys: each pass sums sizes by 1,024 digits of the key, and only the
documents of one digit are looked at again, so no source is ever sorted in one task.  Copies of one
id share a key and are told apart by further digits.

Defined results: a null text counts as empty (size 0, nothing taken); a null source is a source of
its own, last in order; an empty table gives an empty result; rows that repeat an id are mixed one
by one; the seeded order depends on seed, id and size alone, so reruns agree; extra columns are
ignored by :func:`mix` and kept by :func:`materialise`.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import WORD, keep

KEY_BITS, DIGIT_BITS = 60, 10
#: Rows of one key digit that are ordered by a window; more than this and the digit is split again.
WINDOW_ROWS = 10_000
#: Patterns up to which their table is broadcast.
BROADCAST_PATTERNS = 100_000


def cyclic_weights(sources: list[str | None], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights that repeat over the sources in code-point order, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(ordered)}


def water_fill(sizes: dict, weights: dict, total: int, most: int) -> dict:
    """Targets that share ``total`` by weight, none above ``most`` times its source's size."""
    capped: set = set()
    while True:
        free = [s for s in sizes if s not in capped]
        weight = sum(weights[s] for s in free)
        level = (total - sum(most * sizes[s] for s in capped)) / weight if weight else 0.0
        over = {s for s in free if level * weights[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else level * weights[s] for s in sizes}
        capped |= over


@dataclass
class _Edge:
    to: int
    room: int
    cost: int
    back: int


class FlowNetwork:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.edges: list[list[_Edge]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.edges[a].append(_Edge(b, room, cost, len(self.edges[b])))
        self.edges[b].append(_Edge(a, 0, -cost, len(self.edges[a]) - 1))
        return a, len(self.edges[a]) - 1

    def run(self, source: int, sink: int) -> int:
        n, flow, potential = len(self.edges), 0, [0] * len(self.edges)
        while True:
            distance: list[float] = [float("inf")] * n
            distance[source], came, heap = 0, {}, [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > distance[u]:
                    continue
                for i, e in enumerate(self.edges[u]):
                    if e.room and (new := d + e.cost + potential[u] - potential[e.to]) < distance[e.to]:
                        distance[e.to], came[e.to] = new, (u, i)
                        heapq.heappush(heap, (new, e.to))
            if sink not in came:
                return flow
            for v, d in enumerate(distance):
                if d < float("inf"):
                    potential[v] += d
            room, v = None, sink
            while v != source:
                u, i = came[v]
                room = self.edges[u][i].room if room is None else min(room, self.edges[u][i].room)
                v = u
            v = sink
            while v != source:
                u, i = came[v]
                e = self.edges[u][i]
                e.room -= room
                self.edges[v][e.back].room += room
                v = u
            flow += room


def _together(patterns: dict[tuple, int]) -> list[list[tuple]]:
    """Patterns in groups that share no source."""
    parent: dict = {}

    def find(s):
        while parent.setdefault(s, s) != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for p in patterns:
        for s in p:
            parent[find(s)] = find(p[0])
    groups: dict = defaultdict(list)
    for p in patterns:
        if p:
            groups[find(p[0])].append(p)
    return list(groups.values())


def route(quotas: dict, patterns: dict[tuple, int], most: int) -> dict[tuple, int]:
    """Words to take of each pattern: the cheapest flow from quotas to copies.

    ``patterns`` has the size of each; the c-th copy of a word costs c*(c-1)/2.  Sources that overlap
    neither directly nor through others get networks of their own.
    """
    out = {p: 0 for p in patterns}
    for group in _together(patterns):
        sources = sorted({s for p in group for s in p}, key=lambda s: (s is None, s or ""))
        network = FlowNetwork(2 + len(sources) + len(group))
        at_source = {s: 2 + i for i, s in enumerate(sources)}
        for s in sources:
            network.add(0, at_source[s], quotas.get(s, 0), 0)
        copies = {}
        for i, p in enumerate(group):
            here = 2 + len(sources) + i
            for s in p:
                network.add(at_source[s], here, most * patterns[p], 0)
            copies[p] = [network.add(here, 1, patterns[p], c * (c + 1) // 2) for c in range(most)]
        network.run(0, 1)
        for p, edges in copies.items():
            out[p] = sum(patterns[p] - network.edges[a][i].room for a, i in edges)
    return out


def seeded_key(seed: int, *columns: Column) -> Column:
    """A 60-bit integer that depends on the seed and the columns alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


@dataclass(frozen=True)
class _Stop:
    """Rows before ``low`` of (key, tie) give a copy, those in [low, high) give ``words`` in all."""

    low: tuple[int, int]
    high: tuple[int, int]
    words: int


def _thresholds(base: DataFrame, wanted: dict[int, int]) -> dict[int, _Stop]:
    """Where the seeded order of each pattern stops: digit by digit of the key, then of the tie."""
    found, open_ = {}, {p: (0, w) for p, w in wanted.items() if w > 0}
    lows = {p: [0, 0] for p in open_}
    for column in (0, 1):
        bits = KEY_BITS
        name = ("key", "tie")[column]
        while open_ and bits:
            shift = max(0, bits - DIGIT_BITS)
            by_low = defaultdict(list)
            for p in open_:
                by_low[tuple(lows[p])].append(p)
            ranges = F.lit(False)
            for low, ps in by_low.items():
                inside = (F.col(name) >= low[column]) & (F.col(name) < low[column] + (1 << bits))
                ranges = ranges | (F.col("pattern").isin(ps) & inside & ((F.col("key") == low[0]) if column else F.lit(True)))
            sums: dict[int, list] = defaultdict(list)
            digits = base.where(ranges).groupBy("pattern", F.shiftright(name, shift).alias("digit"))
            for r in digits.agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect():
                sums[r["pattern"]].append((r["digit"], r["words"], r["n"]))
            after = {}
            for p, (_, words) in open_.items():
                for digit, total, n in sorted(sums[p]):
                    if words <= total:
                        lows[p][column] = digit << shift
                        if n <= WINDOW_ROWS or (column and not shift):
                            high = (lows[p][0], lows[p][1] + (1 << shift)) if column else (lows[p][0] + (1 << shift), 0)
                            found[p] = _Stop(tuple(lows[p]), high, words)
                        else:
                            after[p] = (n, words)
                        break
                    words -= total
            open_, bits = after, shift
    return found


def mix(
    docs: DataFrame,
    sources: Column,
    weights=cyclic_weights,
    seed: int = 17,
    most: int = 3,
    whole_documents: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """id, size, taken, sources, targets of every row.

    ``sources`` is an array of the sources that a row belongs to.  ``targets`` maps, in the order
    of ``sources``, to (source_size, target).  The last document of a pattern gives only the words
    still missing, unless ``whole_documents`` rounds it to a whole copy.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD)).cast("bigint")
    base = docs.select(F.col(id_column).alias("id"), F.array_sort(F.array_distinct(sources)).alias("sources"), size.alias("size"), F.col(text_column).alias("_told"), *carry)
    # Rows of one key are told apart by their texts, so that a rerun takes the same; those that repeat
    # the text too by where they were written, which splits any number of them.
    half = KEY_BITS // 2
    low = lambda x: F.xxhash64(x).bitwiseAND((1 << half) - 1)
    tie = F.shiftleft(low(F.coalesce(F.col("_told"), F.lit(""))), half).bitwiseOR(low(F.monotonically_increasing_id()))
    base = keep(base.withColumns({"key": seeded_key(seed, F.col("id"), F.col("size")), "tie": tie}).drop("_told"), "sizes", 1 if carry else 6)
    patterns = {tuple(r["sources"]): r["words"] for r in base.groupBy("sources").agg(F.sum("size").alias("words")).collect()}
    sizes: dict = defaultdict(int)
    for p, words in patterns.items():
        for s in p:
            sizes[s] += words
    targets = water_fill(sizes, weights(list(sizes)), sum(patterns.values()), most)
    taken = route({s: round(t) for s, t in targets.items()}, patterns, most)
    order = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    number = {p: i for i, p in enumerate(order)}
    rows = []
    extra: dict[int, int] = {}
    for p in order:
        copies, left = divmod(taken[p], patterns[p]) if patterns[p] else (0, 0)
        extra[number[p]] = left
        rows.append((list(p), number[p], copies, [(sizes[s], targets[s]) for s in p]))
    pair = T.StructType([T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    schema = T.StructType(
        [T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("pattern", T.IntegerType()), T.StructField("copies", T.LongType()), T.StructField("targets", T.ArrayType(pair))]
    )

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(rows) <= BROADCAST_PATTERNS else df

    base = base.join(small(spark.createDataFrame(rows, schema)), "sources")
    edges = _thresholds(base.select("pattern", "key", "tie", "size"), extra)
    none = _Stop((0, 0), (0, 0), 0)
    limits = [(number[p], *(e := edges.get(number[p], none)).low, *e.high, e.words) for p in order]
    names = ("low_key", "low_tie", "high_key", "high_tie", "words")
    limit_schema = T.StructType([T.StructField("pattern", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names]])
    base = base.join(small(spark.createDataFrame(limits, limit_schema)), "pattern")

    def before(bound: str) -> Column:
        return (F.col("key") < F.col(f"{bound}_key")) | ((F.col("key") == F.col(f"{bound}_key")) & (F.col("tie") < F.col(f"{bound}_tie")))

    at_edge = before("high") & ~before("low")
    clear = base.where(~at_edge).withColumn("more", F.when(before("low"), F.col("size")).otherwise(F.lit(0).cast("bigint")))
    running = F.sum("size").over(Window.partitionBy("pattern").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0))
    edge = base.where(at_edge).withColumn("running", running)
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), F.col("words") - (F.col("running") - F.col("size"))))
    if whole_documents:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("bigint"))
    edge = edge.withColumn("more", part).drop("running")
    out = clear.unionByName(edge)
    return out.select(
        F.col("id").alias(id_column), "size", (F.col("copies") * F.col("size") + F.col("more")).alias("taken"), "sources", "targets", *carry
    )


def mix_sources(docs: DataFrame, source_column: str = "source", **how) -> DataFrame:
    """Mix of documents that each have one source: id, size, source_size, target, taken."""
    mixed = mix(docs, F.array(F.col(source_column).cast("string")), **how)
    id_column, carry = how.get("id_column", "doc_id"), how.get("carry", ())
    first = F.get("targets", F.lit(0))
    return mixed.select(id_column, "size", first["source_size"].alias("source_size"), first["target"].alias("target"), "taken", *carry)


def materialise(docs: DataFrame, source_column: str = "source", text_column: str = "text", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row once per copy, rows of no copy dropped.

    Rows without words weigh nothing, so they can neither help nor hurt a quota and stay once.
    """
    row = docs.select(F.struct("*").alias("_row"), F.col(text_column).alias("_text"), F.col(source_column).alias("_source"), F.col(how.pop("id_column", "doc_id")).alias("_id"))
    mixed = mix(row, F.array(F.col("_source").cast("string")), id_column="_id", text_column="_text", whole_documents=True, carry=("_row",), **how)
    copies = F.when(F.col("size") > 0, F.try_divide("taken", "size")).otherwise(F.lit(1)).cast("int")
    repeated = mixed.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select("_row.*")
