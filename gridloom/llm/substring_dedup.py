"""Removal of long repeated word spans by a compacted De Bruijn graph.

The graph's edges are the k-mers: all windows of ``window`` consecutive words of one document; its
nodes are their first and last ``window - 1`` words.  An edge is repeated if its word sequence
starts at two places or more, in any documents.

1. Seeds.  So that not every word becomes a row, edges that cannot be repeated go first.  An edge's
   seed is the least hash among its 16-word parts; neighbouring edges of one seed are a stretch.
   Equal edges have equal seeds: a seed found once belongs to no repeated edge, and a seed found
   again in one and the same stretch only needs no look inside it.  Seeds travel as one binary per
   group of texts and bucket, each distinct one once per group.
2. Edges.  What is left becomes rows (id, nodes, source coordinate): a whole stretch where its seed
   knows no other, single edges elsewhere, each distinct one once per group.  Those at two places
   or more stay, each with the least coordinate as its source.
3. Compaction.  Nodes with one edge in and one edge out do not branch.  Joining the edges that end
   in such a node with those that start there gives the links of the nonbranching paths; linked
   edges that follow each other at their source become one path, at most ``BLOCK`` edges long.
4. Proof.  The source of every path gives its words, which are joined to the coordinates of all
   other places and compared with the words there, word by word.  Equal windows have equal hashes,
   so none is missed; if any place differs, hashes have collided and all is done again with others.

Last, the proven edges are laid over their coordinates, and the words they cover are removed.

A seed, edge or path has at most one row per group of texts (1 MB), so a passage that fills the
corpus is a small share of all rows, and joins on it can be split.  Defined results: a null or empty
text has no words and keeps none; a text of fewer words than the window keeps all; rows that repeat
a text lose what they share; null ids are carried along; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import forget, keep
from gridloom.llm.wordhash import SECOND, RollingHash, hash_words

PART = 16  # words of a seed
BLOCK = 4096  # edges of a path at most
ATTEMPTS = 8  # with other hashes each; a second one is not to be expected in any corpus
UNIQUE, PLAIN, BRANCHING = 0, 1, 2


@dataclass(frozen=True)
class _Paths:
    """Paths of one group: edges [first, last] by their start, their seed and digest."""

    first: np.ndarray
    last: np.ndarray
    seed: np.ndarray
    digest: np.ndarray


class _Group:
    """Hashes of the words of a group's texts, one after the other."""

    def __init__(self, texts: list[bytes], window: int, seed: int = 0, bits: int = 64):
        self.window = window
        hashes, self.starts = hash_words(texts, seed)
        if bits < 64:
            hashes %= np.uint64(1 << bits)
        self.n = len(hashes)
        self.hashes = hashes
        self.rolling = RollingHash(hashes)
        inside = np.zeros(max(0, self.n - window + 1), dtype=bool)  # starts of edges
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if b - a >= window:
                inside[a : b - window + 1] = True
        self.inside = inside

    def paths(self) -> _Paths:
        empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not self.inside.any():
            return _Paths(empty[0], empty[0], empty[1], empty[1])
        reach = self.window - PART + 1  # parts of an edge
        parts = self.rolling.windows(PART)
        least, span = parts, 1
        while span * 2 <= reach:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        least = np.minimum(least[: len(parts) - reach + 1], least[reach - span : len(parts) - span + 1])
        edges = np.flatnonzero(self.inside)
        seed = least[edges]
        new = np.ones(len(edges), dtype=bool)
        new[1:] = (edges[1:] != edges[:-1] + 1) | (seed[1:] != seed[:-1])
        document = np.searchsorted(self.starts, edges, side="right")
        new[1:] |= document[1:] != document[:-1]
        at = np.flatnonzero(new)
        first, last, seed = edges[at], edges[np.append(at[1:], len(edges)) - 1], seed[at]
        digest = self.rolling.ranges(first, last + self.window)
        # A seed at two places of one path: edges inside the path may be equal.
        column = np.arange(reach)
        left = (parts[first[:, None] + column] == seed[:, None]).argmax(axis=1) + first
        right = last + reach - 1 - (parts[last[:, None] + column[::-1]] == seed[:, None]).argmax(axis=1)
        digest[left != right] = 0
        return _Paths(first, last, seed, digest)

    def seeds(self, paths: _Paths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds in order, each one's digest (0 if it branches here) and whether it occurs again here."""
        order = np.lexsort((paths.digest, paths.seed))
        seed, digest = paths.seed[order], paths.digest[order]
        at = np.flatnonzero(np.append(True, seed[1:] != seed[:-1])) if len(seed) else np.zeros(0, np.int64)
        end = np.append(at[1:], len(seed)) - 1 if len(seed) else at
        same = digest[at] == digest[end]
        one = np.where(same, digest[at], 0)
        return seed[at], one, (end > at) | (one == 0)

    def edges(self, paths: _Paths, codes: np.ndarray, seeds: np.ndarray) -> _Edges:
        """The rows of this group: whole stretches of plain seeds, single edges of branching ones."""
        code = codes[np.searchsorted(seeds, paths.seed)] if len(seeds) else np.zeros(0, np.uint8)
        plain, open_ = code == PLAIN, code == BRANCHING
        lengths = paths.last[open_] - paths.first[open_] + 1
        single = np.repeat(paths.first[open_] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        start = np.concatenate((paths.first[plain], single))
        n = np.concatenate(((paths.last - paths.first + 1)[plain], np.ones(len(single), np.int64)))
        end = start + n + self.window - 1
        if not len(start):
            none = np.zeros(0, np.uint64)
            return _Edges(start, n, none, none)
        return _Edges(start, n, self.rolling.ranges(start, end), RollingHash(self.hashes, SECOND).ranges(start, end))


@dataclass(frozen=True)
class _Edges:
    """Rows of edges that follow each other: first start, number, two hashes."""

    start: np.ndarray
    n: np.ndarray
    one: np.ndarray
    two: np.ndarray


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct pairs in order, whether each occurs again, and the pair of every row."""
    order = np.lexsort((one, two))  # stable: the first of equals has the least place
    new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])) if len(one) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    again = np.diff(np.append(at, len(one))) > 1
    which = np.empty(len(one), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[at], again, which


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits; what tells entries of a bucket apart is all 64 bits and more."""
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


ENTRY = "bucket int, grp bigint, entries binary"
VERDICT = "grp bigint, bucket int, codes binary"
_ENTRY = pa.schema([("bucket", pa.int32()), ("grp", pa.int64()), ("entries", pa.binary())])
_VERDICT = pa.schema([("grp", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary())])


def _gather(docs: DataFrame, id_column: str, text_column: str, group_bytes: int) -> DataFrame:
    """grp, payload: texts in groups of about ``group_bytes``, compressed; a longer text is a group."""
    df = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            grp = (part << 32) | number
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([grp], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["grp", "payload"])

        for batch in batches:
            lengths = np.asarray(pa.compute.binary_length(batch.column(1)).fill_null(0))
            at = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= group_bytes:
                    held.append(batch.slice(at, i + 1 - at))
                    at = i + 1
                    yield flush()
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield flush()

    return keep(df.mapInArrow(run, "grp bigint, payload binary"), "groups")


def _open(payload: bytes) -> tuple[pa.Array, list[bytes]]:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    texts = table.column("text").cast(pa.large_binary()).to_pylist()
    ids = table.column("id")
    return (ids.chunk(0) if ids.num_chunks else pa.array([], ids.type)), texts


def _by_bucket(grp: int, bucket: np.ndarray, records: np.ndarray) -> Iterator[dict]:
    order = np.argsort(bucket, kind="stable")
    buckets, at = np.unique(bucket[order], return_index=True)
    for b, rows in zip(buckets.tolist(), np.split(order, at[1:]), strict=True):
        yield {"bucket": b, "grp": grp, "entries": records[rows].tobytes()}


_SEED = np.dtype([("seed", "<u8"), ("digest", "<u8"), ("again", "u1")])


def _judge_seeds(records: np.ndarray) -> np.ndarray:
    order = np.lexsort((records["digest"], records["seed"]))
    seed, digest = records["seed"][order], records["digest"][order]
    at = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    end = np.append(at[1:], len(seed)) - 1
    repeated = (end > at) | np.logical_or.reduceat(records["again"][order] > 0, at)
    branches = (digest[at] != digest[end]) | (digest[at] == 0)
    code = np.where(repeated, np.where(branches, BRANCHING, PLAIN), UNIQUE).astype(np.uint8)
    out = np.empty(len(records), np.uint8)
    out[order] = np.repeat(code, end - at + 1)
    return out


def _exchange(entries: DataFrame, kind: np.dtype, judge) -> DataFrame:
    """Verdicts, one byte per entry, on the entries of every bucket; grp, verdicts."""

    def run(table: pa.Table) -> pa.Table:
        raws = table.column("entries").to_pylist()
        codes = judge(np.frombuffer(b"".join(raws), dtype=kind))
        ends = np.cumsum([len(r) // kind.itemsize for r in raws])
        parts = [c.tobytes() for c in np.split(codes, ends[:-1])]
        return pa.table([table.column("grp"), table.column("bucket"), pa.array(parts, pa.binary())], schema=_VERDICT)

    judged = entries.groupBy("bucket").applyInArrow(run, VERDICT)
    return judged.groupBy("grp").agg(F.collect_list(F.struct("bucket", "codes")).alias("verdicts"))


def _spread(bucket: np.ndarray, verdicts: list[dict] | None, n: int) -> np.ndarray:
    """Verdicts back in the order of the entries they were given for."""
    out, verdicts = np.zeros(n, np.uint8), verdicts or []
    order = np.argsort(bucket, kind="stable")  # entries of one bucket lie together, in the order they were sent
    asked, lie = np.array([v["bucket"] for v in verdicts], dtype=np.int64), bucket[order]
    for v, a, b in zip(verdicts, np.searchsorted(lie, asked), np.searchsorted(lie, asked, side="right"), strict=True):
        out[order[a:b]] = np.frombuffer(v["codes"], np.uint8)
    return out


EDGE = "id bigint, check bigint, u bigint, v bigint, n int, grp bigint, at bigint, again boolean"


def _repeated(edges: DataFrame) -> DataFrame:
    """Edges at two places or more: grp, at, n, their source (grp0, at0), and nodes u, v at the source.

    Sources are aggregates, which combine before they are shuffled, and edges meet theirs in a join,
    whose hot keys are split; so a passage that every group holds fills no task.
    """
    sources = edges.groupBy("id", "check").agg(F.min(F.struct("grp", "at")).alias("source"), F.count("*").alias("copies"), F.max("again").alias("again"))
    marked = edges.drop("again").join(sources.where("copies > 1 OR again").select("id", "check", "source"), ["id", "check"])
    own = F.col("grp") == F.col("source.grp")
    nodes = [F.when(own, F.col(c)).alias(c) for c in ("u", "v")]
    return marked.select("grp", "at", "n", F.col("source.grp").alias("grp0"), F.col("source.at").alias("at0"), *nodes)


def _compacted(repeated: DataFrame) -> DataFrame:
    """grp0, at0, n, path: every repeated edge with the start of its path, both at their source.

    Edges are linked at nodes of one edge in and one edge out.  A link whose edges do not follow
    each other at one source begins a new path there.
    """
    edges = repeated.where("grp = grp0").select("grp0", "at0", "n", "u", "v")
    into = edges.groupBy("v").agg(F.count("*").alias("ends"), F.min(F.struct("grp0", "at0", "n")).alias("left")).where("ends = 1")
    from_ = edges.groupBy("u").agg(F.count("*").alias("starts"), F.min(F.struct("grp0", "at0")).alias("right")).where("starts = 1")
    links = into.join(from_, into["v"] == from_["u"]).where("left.grp0 = right.grp0 AND left.at0 + left.n = right.at0")
    linked = edges.join(links.select("right.grp0", "right.at0", F.lit(True).alias("linked")), ["grp0", "at0"], "left")
    order = Window.partitionBy("grp0").orderBy("at0")
    block = F.expr(f"at0 DIV {BLOCK}")
    begins = F.col("linked").isNull() | (block != F.lag(block).over(order))
    path = F.last(F.when(F.col("begins"), F.col("at0")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return linked.withColumn("begins", begins).withColumn("path", path).select("grp0", "at0", "n", "path")


def _passages(groups: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """grp0, path, words: the words of every path, read at its source."""
    spans = paths.groupBy("grp0", "path").agg((F.max(F.col("at0") + F.col("n")) + window - 1).alias("end"))
    wanted = spans.groupBy(F.col("grp0").alias("grp")).agg(F.collect_list(F.struct("path", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = [w for text in _open(row["payload"])[1] for w in text.split()]
                starts = [s["path"] for s in row["spans"]]
                found = [b" ".join(words[s["path"] : s["end"]]) for s in row["spans"]]
                grp = pa.array([row["grp"]] * len(starts), pa.int64())
                yield pa.RecordBatch.from_arrays([grp, pa.array(starts, pa.int64()), pa.array(found, pa.binary())], names=["grp0", "path", "words"])

    return groups.join(wanted, "grp").select("grp", "payload", "spans").mapInArrow(run, "grp0 bigint, path bigint, words binary")


def _runs(at: np.ndarray, n: np.ndarray, at0: np.ndarray, *same: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first row, start, start of the last edge) of edges that follow each other here and at their source."""
    if not len(at):
        return
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + n[:-1]) | (at0[1:] - at[1:] != at0[:-1] - at[:-1])
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    yield from zip(first.tolist(), at[first].tolist(), (at + n - 1)[last].tolist(), strict=True)


def remove_repeats(
    docs: DataFrame,
    window: int = 35,
    group_bytes: int = 1 << 20,
    groups_per_bucket: int = 24,
    id_column: str = "doc_id",
    text_column: str = "text",
    bits: int = 64,
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, spans: spans are removed word ranges [start, end).

    ``bits`` is what the first attempt keeps of a word's hash; fewer than 64 serve to test the proof.
    """
    groups = _gather(docs, id_column, text_column, group_bytes)
    kind = docs.schema[id_column].dataType.simpleString()
    n_buckets = max(1, -(-groups.count() // groups_per_bucket))
    for attempt in range(ATTEMPTS):
        out = _judged(groups, kind, n_buckets, window, attempt, bits if attempt == 0 else 64)
        if out.where("disputed").isEmpty():
            forget(groups)
            return out.drop("disputed").withColumnRenamed("id", id_column)
        forget(out)
    raise RuntimeError(f"word hashes collided in {ATTEMPTS} attempts")


def _judged(groups: DataFrame, kind: str, n_buckets: int, window: int, seed: int, bits: int) -> DataFrame:
    """Rows of the result and whether words differ from those that hashes took them for."""

    def send_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = _Group(_open(row["payload"])[1], window, seed, bits)
                found, digest, again = group.seeds(group.paths())
                records = np.empty(len(found), _SEED)
                records["seed"], records["digest"], records["again"] = found, digest, again
                if len(records):
                    yield pa.RecordBatch.from_pylist(list(_by_bucket(row["grp"], _bucket(found, n_buckets), records)), schema=_ENTRY)

    codes = keep(_exchange(groups.mapInArrow(send_seeds, ENTRY), _SEED, _judge_seeds), "seeds", 12)
    with_seeds = groups.join(codes, "grp", "left").select("grp", "payload", "verdicts")

    def edges_of(group: _Group, verdicts: list[dict] | None) -> _Edges:
        paths = group.paths()
        seeds, _, _ = group.seeds(paths)
        return group.edges(paths, _spread(_bucket(seeds, n_buckets), verdicts, len(seeds)), seeds)

    def send_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = _Group(_open(row["payload"])[1], window, seed, bits)
                edges = edges_of(group, row["verdicts"])
                places, again, _ = _distinct(edges.one, edges.two)
                start, n = edges.start[places], edges.n[places]
                u, v = group.rolling.ranges(start, start + window - 1), group.rolling.ranges(start + n, start + n + window - 1)
                grp = np.full(len(start), row["grp"], np.int64)
                columns = [x.view(np.int64) for x in (edges.one[places], edges.two[places], u, v)]
                arrays = [pa.array(x) for x in (*columns, n.astype(np.int32), grp, start, again)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "check", "u", "v", "n", "grp", "at", "again"])

    edges = keep(with_seeds.mapInArrow(send_edges, EDGE), "edges")
    repeated = keep(_repeated(edges), "repeated")
    forget(edges)
    paths = keep(_compacted(repeated), "paths")
    passages = keep(_passages(groups, paths, window), "passages")
    named = keep(repeated.select("grp", "at", "n", "grp0", "at0").join(paths.select("grp0", "at0", "path"), ["grp0", "at0"]), "places")
    asked = named.where("grp <> grp0").select("grp", "grp0", "path").distinct().join(passages, ["grp0", "path"])
    proofs = asked.groupBy("grp").agg(F.collect_list(F.struct("grp0", "path", "words")).alias("proofs"))
    places = named.groupBy("grp").agg(F.collect_list(F.struct("at", "n", "grp0", "at0", "path")).alias("places"))
    everything = with_seeds.join(places, "grp", "left").join(proofs, "grp", "left").select("grp", "payload", "verdicts", "places", "proofs")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            for i, row in enumerate(batch.select([0, 1, 2, 4]).to_pylist()):
                ids, texts = _open(row["payload"])
                group = _Group(texts, window, seed, bits)
                words = [text.split() for text in texts]
                flat = [w for each in words for w in each]
                edges = edges_of(group, row["verdicts"])
                first, _, which = _distinct(edges.one, edges.two)
                origin = edges.start[first][which] if len(first) else edges.start
                found = {c: np.zeros(0, np.int64) for c in ("at", "n", "grp0", "at0", "path")}
                if listed[i].is_valid:
                    values = listed[i].values
                    found = {c: np.asarray(values.field(c), dtype=np.int64) for c in found}
                    order = np.argsort(found["at"])
                    found = {c: x[order] for c, x in found.items()}
                # Against the words at the sources elsewhere, then against the first place in here.
                proofs = {(p["grp0"], p["path"]): p["words"].split() for p in row["proofs"] or []}
                wrong = np.zeros(group.n + 1, np.int64)
                for j, at, last in _runs(found["at"], found["n"], found["at0"], found["grp0"], found["path"]):
                    if found["grp0"][j] != row["grp"]:
                        there = int(found["at0"][j] - found["path"][j])
                        n = last + window - at
                        if proofs[int(found["grp0"][j]), int(found["path"][j])][there : there + n] != flat[at : at + n]:
                            wrong[at] = 1
                repeated_here = np.isin(origin, found["at"])
                order = np.flatnonzero(repeated_here)
                order = order[np.argsort(edges.start[order])]
                start, n, origin = edges.start[order], edges.n[order], origin[order]
                for j, at, last in _runs(start, n, origin):
                    here, length = int(origin[j]), last + window - at
                    if here != at and flat[here : here + length] != flat[at : at + length]:
                        wrong[at] = 1
                # +1 where a covered run of words starts, -1 where it ends
                steps = np.zeros(group.n + 1, np.int64)
                np.add.at(steps, start, 1)
                np.add.at(steps, start + n - 1 + window, -1)
                covered = np.cumsum(steps[:-1]) > 0
                disputed = bool(wrong.any())
                out = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
                for kept, a, b in zip(words, group.starts[:-1].tolist(), group.starts[1:].tolist(), strict=True):
                    gone = covered[a:b]
                    if gone.any():
                        rims = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
                        kept = [kept[x] for x in np.flatnonzero(~gone).tolist()]
                    else:
                        rims = np.zeros((0, 2), np.int64)
                    out["n_words"].append(b - a)
                    out["n_removed"].append(int(gone.sum()))
                    out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    out["spans"].append([{"start": int(x), "end": int(y)} for x, y in rims])
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(span)), pa.array([disputed] * len(ids), pa.bool_())],
                    names=["id", "n_words", "n_removed", "kept_sha256", "spans", "disputed"],
                )

    columns = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, disputed boolean"
    out = keep(everything.mapInArrow(lay, columns), "spans")
    forget(codes, repeated, paths, passages, named)
    return out
