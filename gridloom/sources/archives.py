"""ZIP archives, in one file or in ordered parts, as tables of their members, and image headers."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import basename
from gridloom.sources.annotations import IMAGE_SUFFIX, cached
from gridloom.sources.joined import JoinedFile


def _archive(paths: Sequence[str]) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(JoinedFile(paths), 1 << 20))


MEMBERS = "archive string, paths array<string>, name string, offset bigint, packed bigint, size bigint, method int, crc bigint"
_NAMES = [c.split()[0] for c in MEMBERS.split(", ")]
_LOCAL_HEADER = 30
STORED, DEFLATED = 0, 8


class BadMember(ValueError):
    """A member of an archive whose bytes are not what the archive's directory says."""


def list_members(spark: SparkSession, archives: dict[str, Sequence[str]]) -> DataFrame:
    """archive, paths, name, offset, packed, size, method, crc of all files in archives, from their directories alone.

    An archive is given by its name and its parts, in the order they are joined.  Nothing is inflated,
    so members can be joined, filtered and counted before any of them is read.
    """
    named = spark.createDataFrame([(n, list(p)) for n, p in archives.items()], "archive string, paths array<string>")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                infos = [i for i in _archive(row["paths"]).infolist() if not i.is_dir()]
                for at in range(0, len(infos), 10_000):
                    told = [(row["archive"], row["paths"], i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in infos[at : at + 10_000]]
                    yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, t, strict=True)) for t in told], schema=_MEMBERS)

    return named.repartition(max(1, len(archives)), "archive").mapInArrow(listed, MEMBERS)


def _content(source: JoinedFile, member: dict) -> bytes:
    """A member by its place: the bytes behind its local header, inflated and checked."""
    reader = io.BufferedReader(source, 1 << 16)
    reader.seek(member["offset"])
    head = reader.read(_LOCAL_HEADER)
    if head[:4] != b"PK\x03\x04":
        raise BadMember(f"{member['archive']}: no file at {member['offset']}")
    reader.seek(member["offset"] + _LOCAL_HEADER + sum(struct.unpack("<HH", head[26:30])))
    raw = reader.read(member["packed"])
    reader.detach()
    if member["method"] not in (STORED, DEFLATED):
        raise BadMember(f"{member['archive']}: {member['name']} is packed by method {member['method']}")
    out = zlib.decompress(raw, -zlib.MAX_WBITS) if member["method"] == DEFLATED else raw
    if len(out) != member["size"] or zlib.crc32(out) != member["crc"]:
        raise BadMember(f"{member['archive']}: {member['name']} is damaged")
    return out


def read_members(members: DataFrame, member_bytes: int = 64 << 20, sizes: bool = False) -> DataFrame:
    """archive, name, content (with ``sizes`` also img_w, img_h) of rows of :func:`list_members`.

    Members are dealt in stretches of about ``member_bytes`` of their archive, in the order they lie
    there, and each is read by range: what is not asked for is neither fetched nor inflated.  The sizes
    are told from the content while it is at hand.
    """
    kinds = {"archive": pa.string(), "name": pa.string(), "content": pa.binary()} | ({"img_w": pa.int32(), "img_h": pa.int32()} if sizes else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[tuple, JoinedFile] = {}
        for batch in batches:
            for member in batch.to_pylist():
                paths = tuple(member["paths"])
                if paths not in opened:
                    opened = {paths: JoinedFile(paths)}
                content = _content(opened[paths], member)
                row = {"archive": member["archive"], "name": member["name"], "content": content}
                if sizes:
                    row["img_w"], row["img_h"] = _size(content) or (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in kinds.items()], names=list(kinds))

    dealt = members.select(*_NAMES).withColumn("part", F.floor(F.col("offset") / member_bytes)).repartition("archive", "part")
    schema = "archive string, name string, content binary" + (", img_w int, img_h int" if sizes else "")
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(read, schema)


def read_zip(spark: SparkSession, archives: dict[str, Sequence[str]], pattern: str | None = None, member_bytes: int = 64 << 20) -> DataFrame:
    """archive, name, content of the files in archives of any size whose names fit ``pattern``."""
    members = list_members(spark, archives)
    return read_members(members.where(F.col("name").rlike(pattern)) if pattern else members, member_bytes)


_MEMBERS = pa.schema(
    [("archive", pa.string()), ("paths", pa.list_(pa.string())), ("name", pa.string()), ("offset", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("crc", pa.int64())]
)


def archive_images(spark: SparkSession, root: str, source: str, paths: Sequence[str]) -> DataFrame:
    """source, rel_path, basename, content, img_w, img_h of a source's archive, in one pass and once.

    The table appears when its last file is committed: a run that is killed half way leaves nothing
    that a later one would read, and one that finds it unpacks nothing.
    """

    def build() -> DataFrame:
        members = list_members(spark, {source: paths}).where(F.lower("name").rlike(IMAGE_SUFFIX))
        files = read_members(members, sizes=True)
        return files.select(F.col("archive").alias("source"), F.col("name").alias("rel_path"), basename(F.col("name")).alias("basename"), "content", "img_w", "img_h")

    return cached(spark, root, {"source": source, "paths": list(paths)}, build)


def _size(content: bytes) -> tuple[int, int] | None:
    try:
        return image_size(content)
    except (struct.error, IndexError, ValueError):
        return None


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, JPEG, WebP or BMP file; None for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        kind = content[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", content[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content):
            if content[at] != 0xFF:
                return None
            marker = content[at + 1]
            if marker == 0xFF:
                at += 1
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            else:
                at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def with_image_size(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with img_w and img_h; null for what is no image."""
    schema = files.drop(content).schema.add("img_w", T.IntegerType()).add("img_h", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_size(x) if x is not None else None for x in batch.column(content).to_pylist()]
            rest = batch.drop_columns([content])
            arrays = [*rest.columns, *(pa.array([s and s[i] for s in sizes], pa.int32()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest.schema.names, "img_w", "img_h"])

    return files.select(*files.drop(content).columns, content).mapInArrow(run, schema)
