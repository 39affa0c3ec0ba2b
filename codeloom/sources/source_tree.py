"""Source trees as a Spark data source, and their text."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.settings import Repo
from codeloom.sources.file_profile import SKIP_DIRS
from codeloom.sources.ignore_rules import EXCLUDE_FILE

LISTING = "repo_id string, file_path string, abs_path string, size bigint, mtime double"
READ_BATCH_BYTES = 16 * 1024 * 1024


class Folder(NamedTuple):
    """A folder to list; ``deep`` also lists everything below it."""

    repo_id: str
    root: str
    path: str
    deep: bool


class Folders(InputPartition):
    def __init__(self, folders: list[Folder]):
        self.folders = folders


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repos = json.loads(options["repos"])
        self.skip = set(json.loads(options.get("skipdirs", "[]")))
        self.target = int(options.get("partitions", "64"))

    def _below(self, path: str) -> list[str]:
        """Folders to enter: neither skipped nor hidden, as nothing in those is indexed."""
        with os.scandir(path) as entries:
            return [
                e.path
                for e in entries
                if e.is_dir(follow_symlinks=False)
                and e.name not in self.skip
                and not e.name.startswith(".")
            ]

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough to share out evenly.

        A repository that holds most of the files is split over many tasks this way; the
        number of tasks stays at the target however many folders a level has.
        """
        deep = [Folder(r, p, p, True) for r, p in self.repos if os.path.isdir(p)]
        flat: list[Folder] = []
        while deep and len(deep) < 4 * self.target:
            flat += [folder._replace(deep=False) for folder in deep]
            deep = [f._replace(path=p) for f in deep for p in self._below(f.path)]
        folders = [*deep, *flat]
        shares = max(1, min(self.target, len(folders)))
        return [Folders(folders[i::shares]) for i in range(shares)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.folders:
            pending = [folder.path]
            while pending:
                path = pending.pop()
                if folder.deep:
                    pending.extend(self._below(path))
                yield from self._files(folder, path)

    def _files(self, folder: Folder, path: str) -> Iterator[tuple]:
        with os.scandir(path) as entries:
            paths = sorted(e.path for e in entries if e.is_file())
        if path == folder.root:
            paths.append(os.path.join(path, EXCLUDE_FILE))
        for name in paths:
            try:
                stat = os.stat(name)
            except OSError:
                continue
            relative = os.path.relpath(name, folder.root)
            yield (folder.repo_id, relative, name, stat.st_size, stat.st_mtime)


class SourceTree(DataSource):
    """``spark.read.format("sourcetree")``: every file below the given repositories.

    Unlike the file sources of Spark it also sees names that start with ``_`` or ``.``.
    """

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def list_files(
    spark: SparkSession,
    repos: Iterable[Repo],
    skip_dirs: Iterable[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Listing of all repositories; skipped and hidden folders are never entered."""
    spark.dataSource.register(SourceTree)
    share = partitions or 2 * spark.sparkContext.defaultParallelism
    return (
        spark.read.format("sourcetree")
        .option("repos", json.dumps([[r.repo_id, os.path.abspath(r.path)] for r in repos]))
        .option("skipdirs", json.dumps([*SKIP_DIRS, *skip_dirs]))
        .option("partitions", str(share))
        .load()
    )


def read_contents(listing: DataFrame) -> DataFrame:
    """Listing with ``content``: UTF-8 text, undecodable bytes dropped.

    Rows are spread by path first, so tasks read about the same number of files however the
    listing was split. A file that vanished in between yields no row.
    """
    names = listing.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, held = [], [], 0
            for at, path in enumerate(batch.column(names.index("abs_path")).to_pylist()):
                try:
                    with open(path, encoding="utf-8", errors="ignore") as handle:
                        text = handle.read()
                except OSError:
                    continue
                rows.append(at)
                texts.append(text)
                held += len(text)
                if held >= READ_BATCH_BYTES:
                    yield batch.take(pa.array(rows)).append_column("content", pa.array(texts, pa.string()))
                    rows, texts, held = [], [], 0
            if rows:
                yield batch.take(pa.array(rows)).append_column("content", pa.array(texts, pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema)
    spread = listing.repartition("repo_id", "file_path")
    return spread.mapInArrow(read, f"{schema}, content string")
