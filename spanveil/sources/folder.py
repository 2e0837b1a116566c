"""A folder as a Spark data source that lists and doesn't open: a row for each file, and one for each directory that can't be listed.

    spark.dataSource.register(FolderSource)
    spark.read.format("spanveil_folder").load("/shared/mail")

Any address that Arrow's file systems know will do (a path that all machines share, s3://, hdfs://). Directories below the root are
parts that tasks walk; the contents of what is wanted of the list are read later, dealt anew by path (``files.read_folder``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from posixpath import splitext

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, suffix string, bytes long, modified timestamp, error string"


def open_store(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return pafs.FileSystem.from_uri(address) if "://" in address else (pafs.LocalFileSystem(), address)


def _hidden(name: str) -> bool:
    return name.startswith(".") or name == "__pycache__"


@dataclass
class Walk(InputPartition):
    """A directory to be walked with all below it, or (not ``deep``) only its own files."""

    path: str
    deep: bool = field(default=True)

    def __post_init__(self) -> None:
        super().__init__(self.path)


class FolderReader(DataSourceReader):
    def __init__(self, address: str, recursive: bool) -> None:
        self._address, self._recursive, self._suffixes = address, recursive, None

    def partitions(self) -> Sequence[Walk]:
        store, root = open_store(self._address)
        if store.get_file_info(root).type == pafs.FileType.File:
            return [Walk(root, False)]
        try:
            below = [i for i in store.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory and not _hidden(i.base_name)]
        except OSError:
            below = []  # the task that lists the root reports it
        return [Walk(root, False), *(Walk(i.path) for i in below if self._recursive)]

    def read(self, partition: Walk) -> Iterator[tuple]:
        store, _ = open_store(self._address)
        todo = [partition.path]
        while todo:
            at = todo.pop()
            try:
                info = store.get_file_info(at)
                inside = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at))
            except OSError as e:
                yield (at, "", None, None, f"unlistable: {type(e).__name__}")
                continue
            for i in inside:
                if _hidden(i.base_name):
                    continue
                if i.type == pafs.FileType.Directory:
                    todo += [i.path] if partition.deep else []
                elif i.type == pafs.FileType.File:
                    suffix = splitext(i.base_name)[1].lower()
                    if self._suffixes is None or suffix in self._suffixes:
                        yield (i.path, suffix, i.size, i.mtime, None)
                else:
                    yield (i.path, "", None, None, "unlistable: no such file")


class PushedReader(FolderReader):
    """With conditions on the suffix taken over, in sessions that hand conditions to sources in Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the suffix are taken over; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("suffix",):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self._suffixes = values if self._suffixes is None else self._suffixes & values
            else:
                yield f


class FolderSource(DataSource):
    """Options: ``path`` (or load's argument), and ``recursive`` (true). Hidden files and directories and ``__pycache__`` are left out."""

    @classmethod
    def name(cls) -> str:
        return "spanveil_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        kind = PushedReader if self.options.get("pushed", "false") == "true" else FolderReader
        return kind(self.options["path"], self.options.get("recursive", "true").lower() == "true")


def list_folder(spark: SparkSession, address: str, recursive: bool = True) -> DataFrame:
    """The list of a folder, or of one file: path, suffix, bytes, modified and error."""
    spark.dataSource.register(FolderSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("spanveil_folder").option("recursive", str(recursive)).option("pushed", pushed).load(address)
