"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout: one zstandard frame per document (its ids as little-endian unsigned 32-bit
integers), a skippable frame with the ids of the documents, and last the seek table of the public
zstandard seekable format: per frame its compressed size, its plain size and a checksum (the low
half of XXH64 of the plain bytes).  A reader takes the footer, then the table, and decompresses
the frames of the documents it wants and no others.

Files are written by the tasks of one range-partitioned, sorted stage, each under a name of its
own that is put in place by a rename when it is whole; a task that runs again writes the same
bytes.  They go to the shared folder, through Arrow's file systems.  Ranges are cut by id, a hash
of the text and a row number, so neither null nor repeated ids nor copies fill one file.

Defined results: a null text counts as empty, so its document holds the end id alone; rows with a
null id come first; rows that repeat an id follow each other in the order of a hash of their texts;
an empty table writes no file; extra columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import new_path
from gridloom.llm.tokens import piece_encoder

# Fixed values of the public zstandard seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
HAS_CHECKSUM = 0x80


class CorruptFrame(ValueError):
    """A frame, table or footer that does not hold what it announces."""


def open_filesystem(uri: str):
    """Arrow file system and path of a folder or file that Hadoop names ``uri``."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Appends documents to an open binary stream and closes it with index and seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=level)
        self.entries, self.ids = [], []

    def add(self, doc_id: int | None, plain: bytes) -> None:
        frame = self.compressor.compress(plain)
        self.stream.write(frame)
        self.entries.append((len(frame), len(plain), _checksum(plain)))
        self.ids.append(doc_id)

    def close(self) -> None:
        index = b"".join(struct.pack("<?q", x is not None, x or 0) for x in self.ids)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), HAS_CHECKSUM, SEEKABLE_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        import zstandard

        self.file, self.decompressor = file, zstandard.ZstdDecompressor()
        size = file.size()
        if size < 17:
            raise CorruptFrame("too short for a seek table")
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE_FOOTER or flags != HAS_CHECKSUM:
            raise CorruptFrame("no seek table at the end")
        body = 12 * n + 9
        if size < body + 8 or struct.unpack("<II", file.read_at(8, size - body - 8)) != (SEEK_TABLE, body):
            raise CorruptFrame("seek table of another size")
        raw = file.read_at(12 * n, size - body)
        self.entries = list(struct.iter_unpack("<III", raw))
        self.offsets, at = [], 0
        for length, _, _ in self.entries:
            self.offsets.append(at)
            at += length
        if struct.unpack("<II", file.read_at(8, at)) != (SKIPPABLE, 9 * n):
            raise CorruptFrame("no document index after the frames")
        self.ids = [x if there else None for there, x in struct.iter_unpack("<?q", file.read_at(9 * n, at + 8))]

    def read(self, i: int) -> bytes:
        """Plain bytes of the i-th document, checked against its checksum."""
        length, plain_size, checksum = self.entries[i]
        plain = self.decompressor.decompress(self.file.read_at(length, self.offsets[i]), max_output_size=plain_size)
        if len(plain) != plain_size or _checksum(plain) != checksum:
            raise CorruptFrame(f"frame {i} fails its checksum")
        return plain


@dataclass(frozen=True)
class TokenFiles:
    """What was written: the folder and, in ascending order, a row per file."""

    path: str
    files: list[dict]


MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def write_token_files(
    docs: DataFrame,
    path: str | None = None,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    level: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> TokenFiles:
    """Encode every text, append ``end_id``, and write the files in ascending id order.

    One range shuffle of the texts.  The driver gets one manifest row per file.
    """
    spark = docs.sparkSession
    root = path or new_path(spark, "token-files")
    df = docs.select(F.col(id_column).cast("bigint").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    keys = ["_id", "_hash", "_row"]
    df = df.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = piece_encoder(tokenizer), TaskContext.get().partitionId()
        fs, folder = open_filesystem(root)
        writer, stream, n_tokens = None, None, 0
        name = f"{folder}/part-{part:07d}.ids"
        own = f"{folder}/.{part:07d}-{uuid.uuid4().hex}"
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    stream = fs.open_output_stream(own)
                    writer = FrameWriter(stream, level)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
                    n_tokens += len(ids) // 4 + 1
        if writer is None:
            return
        writer.close()
        n_bytes = stream.tell()
        stream.close()
        if fs.get_file_info(name).is_file:  # of an earlier attempt, with the same bytes
            fs.delete_file(own)
        else:
            fs.move(own, name)
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "path": f"{root}/part-{part:07d}.ids", "n_docs": len(writer.ids), "n_tokens": n_tokens, "n_bytes": n_bytes}],
            schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]),
        )

    files = sorted((r.asDict() for r in ordered.mapInArrow(run, MANIFEST).collect()), key=lambda r: r["part"])
    return TokenFiles(root, files)


def read_token_files(spark: SparkSession, written: TokenFiles, doc_ids: set[int] | None = None, id_column: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32, ids of the documents in the files, or of ``doc_ids`` alone.

    A task per file; only frames of wanted documents are decompressed.  ``start`` counts the ids
    of all documents before, across files.
    """
    rows, before = [], 0
    for f in written.files:
        rows.append((f["path"], before))
        before += f["n_tokens"]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("before", T.LongType())])
    files = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))
    out = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_filesystem(row["path"])
                with fs.open_input_file(path) as file:
                    reader, start, held = FrameReader(file), row["before"], []
                    for i, doc_id in enumerate(reader.ids):
                        n = reader.entries[i][1] // 4
                        if doc_ids is None or doc_id in doc_ids:
                            plain = reader.read(i)
                            held.append({"id": doc_id, "start": start, "n_tokens": n, "ids_crc32": zlib.crc32(plain), "ids": plain})
                        start += n
                        if len(held) == 512:
                            yield pa.RecordBatch.from_pylist(held, schema=out)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=out)

    read = files.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return read.withColumnRenamed("id", id_column)
