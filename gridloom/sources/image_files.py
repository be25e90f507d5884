"""Image files extracted from archives into folders, a source at a time and each whole or not at all.

``ingest`` writes the members of archives as files below ``<root>/<source>/run-<id>/``, from the tasks
that inflate them.  What tasks have written is told to the driver in commit messages, a few names each;
when all have ended, a manifest per source names the run and the tables of its files, and with that the
source appears.  A run that fails or is killed leaves no manifest, so nothing of it is ever read; one
that finds a manifest of its own configuration unpacks nothing.

Defined results: of members that lead to one path the last of the archive stays; parts of a name that
lead out of the folder are left out, as is a name of nothing else; a source without images has a
manifest of no files; an attempt that is repeated writes the same files under its own names first, so
a lost or a speculative one leaves none half written.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.sources.annotations import IMAGE_SUFFIX
from gridloom.sources.archives import _size, list_members, read_members
from gridloom.sources.interim import file_system

MANIFEST = "_manifest.json"
FILES = "source string, rel_path string, stored string, bytes bigint, crc bigint, img_w int, img_h int"
_FILES = pa.schema(
    [("source", pa.string()), ("rel_path", pa.string()), ("stored", pa.string()), ("bytes", pa.int64()), ("crc", pa.int64()), ("img_w", pa.int32()), ("img_h", pa.int32())]
)
#: Files that a task tells of in one table at most.
TOLD = 50_000


@dataclass
class Part:
    """A table of files that a task has written."""

    source: str
    place: str
    files: int
    bytes: int


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


def safe_path(name: Column) -> Column:
    """A member's name as a path that stays below its folder."""
    steps = F.split(F.regexp_replace(name, r"\\", "/"), "/")
    return F.array_join(F.filter(steps, lambda s: ~s.isin("", ".", "..")), "/")


class ImageFiles(DataSource):
    """Options: ``path``; ``configs``, a JSON object of each source's configuration."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "source string, rel_path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), json.loads(self.options["configs"]))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, configs: dict[str, str]):
        self.path, self.configs, self.run = path, configs, f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = file_system(self.path)
        attempt, out, made = uuid.uuid4().hex, Written(), set()
        told: dict[str, list[tuple]] = {}
        for batch in iterator:
            for row in batch.to_pylist():
                source, content = row["source"], row["content"]
                stored = f"{source}/{self.run}/{row['rel_path']}"
                folder, _, name = f"{root}/{stored}".rpartition("/")
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                _publish(files, f"{folder}/.{attempt}", f"{folder}/{name}", content)
                rows = told.setdefault(source, [])
                rows.append((source, row["rel_path"], stored, len(content), zlib.crc32(content), *(_size(content) or (None, None))))
                if len(rows) == TOLD:
                    out.parts.append(self._tell(files, root, source, told.pop(source)))
        out.parts += [self._tell(files, root, s, rows) for s, rows in told.items()]
        return out

    def _tell(self, files: fs.FileSystem, root: str, source: str, rows: list[tuple]) -> Part:
        folder = f"{root}/{source}/{self.run}.files"
        files.create_dir(folder, recursive=True)
        place = f"{uuid.uuid4().hex}.parquet"
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FILES.types, strict=True)], schema=_FILES)
        with files.open_output_stream(f"{folder}/{place}") as f:
            pq.write_table(table, f)
        return Part(source, place, len(rows), sum(r[3] for r in rows))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        parts: dict[str, list[Part]] = {s: [] for s in self.configs}
        for message in messages:
            for part in message.parts if message else ():
                parts[part.source].append(part)
        for source, mine in parts.items():
            files.create_dir(f"{root}/{source}", recursive=True)
            told = {"config": self.configs[source], "run": self.run, "files": sum(p.files for p in mine), "bytes": sum(p.bytes for p in mine), "parts": sorted(p.place for p in mine)}
            _publish(files, f"{root}/{source}/.{self.run}", f"{root}/{source}/{MANIFEST}", json.dumps(told).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        for source in self.configs:
            _drop(files, f"{root}/{source}", lambda name: name.startswith(self.run))


def _publish(files: fs.FileSystem, first: str, place: str, content: bytes) -> None:
    """A file that is whole from the moment that it has its name."""
    with files.open_output_stream(first) as f:
        f.write(content)
    files.move(first, place)


def _drop(files: fs.FileSystem, folder: str, which) -> int:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    gone = [x.path for x in found if x.type == fs.FileType.Directory and which(x.base_name)]
    for place in gone:
        files.delete_dir(place)
    return len(gone)


def manifest(root: str, source: str) -> dict | None:
    """What the last whole run of a source has left: config, run, files, bytes, parts; None if there is none."""
    files, place = file_system(f"{root.rstrip('/')}/{source}/{MANIFEST}")
    if files.get_file_info(place).type != fs.FileType.File:
        return None
    with files.open_input_stream(place) as f:
        return json.loads(f.read())


def committed(spark: SparkSession, root: str, sources: Sequence[str]) -> DataFrame:
    """source, rel_path, stored (below ``root``), bytes, crc, img_w, img_h of the files of whole runs."""
    root, parts = root.rstrip("/"), []
    for source in sources:
        told = manifest(root, source)
        parts += [f"{root}/{source}/{told['run']}.files/{p}" for p in told["parts"]] if told else []
    return spark.read.schema(FILES).parquet(*parts) if parts else spark.createDataFrame([], FILES)


def sweep(root: str, source: str) -> int:
    """Delete what runs without a manifest, or with one that was replaced, have left; not while one is at work."""
    told = manifest(root, source)
    files, place = file_system(f"{root.rstrip('/')}/{source}")
    current = told["run"] if told else None
    return _drop(files, place, lambda name: name.startswith("run-") and name not in (current, f"{current}.files"))


def ingest(spark: SparkSession, root: str, archives: dict[str, Sequence[str]], pattern: str = IMAGE_SUFFIX, member_bytes: int = 64 << 20) -> DataFrame:
    """Extract the images of the archives of sources that have not been extracted yet; :func:`committed` of all.

    An archive is given by its source and its parts, in the order they are joined.
    """
    configs = {s: hashlib.md5(json.dumps({"paths": list(p), "pattern": pattern}, sort_keys=True).encode()).hexdigest() for s, p in archives.items()}
    waiting = [s for s in archives if (manifest(root, s) or {}).get("config") != configs[s]]
    if waiting:
        spark.dataSource.register(ImageFiles)
        members = list_members(spark, {s: archives[s] for s in waiting}).where(F.lower("name").rlike(pattern)).withColumn("rel_path", safe_path(F.col("name")))
        whole = F.struct(*[c for c in members.columns if c not in ("archive", "rel_path")])
        last = members.where("rel_path <> ''").groupBy("archive", "rel_path").agg(F.max_by(whole, "offset").alias("m"))
        # A member's name becomes its path here, so that contents meet their paths without a join.
        chosen = last.select("archive", "m.*", "rel_path").withColumn("name", F.col("rel_path"))
        rows = read_members(chosen, member_bytes).select(F.col("archive").alias("source"), F.col("name").alias("rel_path"), "content")
        rows.write.format("image_files").mode("append").option("configs", json.dumps({s: configs[s] for s in waiting})).save(root)
    return committed(spark, root, list(archives))
