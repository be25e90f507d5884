"""A data source that lists the images of a folder, hidden ones too, with the sizes in their headers.

``spark.read.format("image_folder").load(path)`` after :func:`register`.  The driver walks down only
until there are enough folders to deal out; each task walks through its own, and reads of every image
the first bytes alone, more only where a JPEG's size comes later.  Contents are never read: a plan
that asks for no size opens no file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.sources.archives import image_size
from gridloom.sources.interim import file_system

# The suffixes of image files.
SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")
#: Folders that the driver lists at most before it deals them out, and bytes of a file that are read first.
WALKED, HEADER = 1_000, 4096
_COLUMNS = "rel_path string, basename string, bytes bigint"


def has_image_suffix(name: str) -> bool:
    """Whether a name ends in one of the suffixes, whatever their case; a name that is nothing else has none."""
    stem, dot, suffix = name.rpartition(".")
    return bool(stem) and dot + suffix.lower() in SUFFIXES


def header_size(files: fs.FileSystem, place: str, size: int) -> tuple[int, int] | None:
    """Width and height of an image from as few of its bytes as they take; None for anything else."""
    with files.open_input_file(place) as f:
        read = HEADER
        while True:
            head = f.read_at(min(read, size), 0)
            try:
                found = image_size(head)
            except (struct.error, IndexError, ValueError):
                return None
            if found or read >= size or head[:2] != b"\xff\xd8":
                return found
            read *= 8


@dataclass
class Folder(InputPartition):
    place: str
    #: Whether folders below belong to it too.
    deep: bool

    def __init__(self, place: str, deep: bool):
        super().__init__(place)
        self.place, self.deep = place, deep


class ImageFolder(DataSource):
    """Options: ``path``; ``sizes``, false to open no file; ``folders``, how many a listing is dealt out by at least."""

    @classmethod
    def name(cls) -> str:
        return "image_folder"

    def schema(self) -> str:
        sizes = str(self.options.get("sizes", "true")).lower() != "false"
        return _COLUMNS + (", img_w int, img_h int" if sizes else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], "img_w" in schema.fieldNames(), int(self.options.get("folders", 64)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, sizes: bool, folders: int):
        self.path, self.sizes, self.folders = path, sizes, folders

    def partitions(self) -> list[Folder]:
        files, root = file_system(self.path)
        waiting, done, walked = [root], [], 0
        # Breadth first: a folder that is walked here is dealt without those below it.
        while waiting and len(waiting) + len(done) < self.folders and walked < WALKED:
            place = waiting.pop(0)
            walked += 1
            done.append(Folder(place, False))
            waiting += [x.path for x in files.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.Directory]
        return [*done, *(Folder(p, True) for p in waiting)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, root = file_system(self.path)
        names = [c.split()[0] for c in _COLUMNS.split(", ")] + (["img_w", "img_h"] if self.sizes else [])
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds)], names=names)

        rows, waiting = [], [partition.place]
        while waiting:
            for x in files.get_file_info(fs.FileSelector(waiting.pop())):
                if x.type == fs.FileType.Directory:
                    waiting += [x.path] if partition.deep else []
                elif x.is_file and has_image_suffix(x.base_name):
                    size = (header_size(files, x.path, x.size) or (None, None)) if self.sizes else ()
                    rows.append((x.path[len(root.rstrip("/")) + 1 :], x.base_name, x.size, *size))
                if len(rows) >= 1000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageFolder)


def list_images(spark: SparkSession, path: str, source: str, sizes: bool = True, folders: int = 64) -> DataFrame:
    """source, rel_path, basename, bytes and, with ``sizes``, img_w and img_h (null for no image) of the images below ``path``."""
    register(spark)
    listed = spark.read.format("image_folder").option("sizes", str(sizes).lower()).option("folders", folders).load(path)
    return listed.select(F.lit(source).alias("source"), "*")
