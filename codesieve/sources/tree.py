"""File trees as a Spark data source.

``spark.read.format("source_tree").load(root)`` lists the entries of one directory, hidden and empty
files included.  ``list_tree`` opens the directories below it on the executors, level by level, so
neither the driver nor one task ever holds the whole tree.  Contents are read in a last step
(``read_contents``), after the cheap filters on path and size, so excluded files are never opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING_SCHEMA = "path string, size bigint, is_directory boolean, error string"
ROWS_PER_BATCH = 10_000
#: Contents that one task reads.
BYTES_PER_TASK = 128 * 1024 * 1024


def _list_local(directory: str) -> Iterator[tuple]:
    """Entries of a local directory; links to directories are not followed, what cannot be read is an error row."""
    try:
        with os.scandir(directory) as entries:
            for entry in entries:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.path, 0, True, None
                    elif entry.is_file():
                        yield entry.path, entry.stat().st_size, False, None
                except OSError as problem:
                    yield entry.path, None, False, str(problem)
    except OSError as problem:
        yield directory, None, False, str(problem)


def _list_remote(directory: str) -> Iterator[tuple]:
    from pyarrow import fs

    try:
        filesystem, path = fs.FileSystem.from_uri(directory)
        scheme = directory[:len(directory) - len(path)]
        for info in filesystem.get_file_info(fs.FileSelector(path, recursive=False)):
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                is_directory = info.type == fs.FileType.Directory
                yield scheme + info.path, 0 if is_directory else info.size, is_directory, None
    except OSError as problem:
        yield directory, None, False, str(problem)


def list_directory(directory: str) -> Iterator[tuple]:
    """Path, size, whether it is a directory, and error of each entry."""
    return _list_remote(directory) if "://" in directory else _list_local(directory)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.root)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root = partition.value
        if "://" not in root and os.path.isfile(root):
            yield root, os.path.getsize(root), False, None
        else:
            yield from list_directory(root)


class TreeSource(DataSource):
    """Data source ``source_tree``: entries of one directory (or a single file)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def _open_directories(batches):
    """The entries of each directory."""
    import itertools

    import pandas as pd

    rows = (row for batch in batches for path in batch["path"] for row in list_directory(path))
    for chunk in itertools.batched(rows, ROWS_PER_BATCH):
        yield pd.DataFrame(chunk, columns=["path", "size", "is_directory", "error"]).astype({"size": "Int64"})


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def list_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Files below ``root``: full path, path relative to the root, name, size and error (why it could not be listed).

    Directories are opened level by level and spread over all tasks on each, until none is left, so no task walks a
    subtree.  Only paths are shuffled; each level is listed once and kept.
    """
    spark.dataSource.register(TreeSource)
    base, tasks = root.rstrip("/") or "/", tasks or _tasks(spark)
    level = spark.read.format("source_tree").load(root).persist()
    entries = level
    while not (directories := level.filter("is_directory")).isEmpty():
        level = directories.select("path").repartition(tasks, "path").mapInPandas(_open_directories, LISTING_SCHEMA).persist()
        entries = entries.unionByName(level)
    entries = entries.filter("not is_directory")
    name = F.substring_index("path", "/", -1)
    below = F.when(F.col("path") == base, name) \
        .otherwise(F.substring(F.col("path"), len(base.rstrip("/")) + 2, 1 << 30))
    return entries.select(F.col("path").alias("full_path"), below.alias("path"), name.alias("name"), "size", "error")


def _read_files(batches):
    import pyarrow as pa

    max_bytes = 64 * 1024 * 1024
    for batch in batches:
        columns = batch.schema.names
        paths = batch.column(columns.index("full_path")).to_pylist()
        start, contents, errors, held = 0, [], [], 0

        def chunk(end: int):
            part = batch.slice(start, end - start)
            return pa.RecordBatch.from_arrays(
                part.columns + [pa.array(contents, pa.binary()), pa.array(errors, pa.string())],
                columns + ["content", "read_error"])

        for index, path in enumerate(paths):
            data, error = None, None
            try:
                if "://" in path:
                    from pyarrow import fs
                    filesystem, inner = fs.FileSystem.from_uri(path)
                    with filesystem.open_input_file(inner) as stream:
                        data = stream.read()
                else:
                    with open(path, "rb") as stream:
                        data = stream.read()
            except OSError as problem:
                error = str(problem)
            contents.append(data)
            errors.append(error)
            held += len(data or b"")
            if held >= max_bytes:  # bounded Arrow batches whatever the file sizes
                yield chunk(index + 1)
                start, contents, errors, held = index + 1, [], [], 0
        if contents:
            yield chunk(len(paths))


def read_contents(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``content`` and ``read_error`` to a (filtered) listing.

    The listing is spread over ``partitions`` tasks first, because one subtree may hold most files.
    Only paths are shuffled.  The default is so many tasks that each reads about 128 MB, and at least the larger
    of the shuffle partitions and four tasks per core.
    """
    if partitions is None:
        total = listing.agg(F.sum("size")).first()[0] or 0
        partitions = max(_tasks(listing.sparkSession), -(-total // BYTES_PER_TASK))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields)
    return listing.repartition(partitions, "full_path") \
        .mapInArrow(_read_files, f"{schema}, content binary, read_error string")
