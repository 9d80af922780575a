"""Directory trees on a file system that every executor sees, as raw file rows.

Directories are expanded level by level: each level's listing is a Spark job whose result is written,
and the directories among it are the next level's input. Files are then read in tasks of about equal
size, however they lie in repositories and folders. The driver and a single task never list a tree.

Spark's own binary file source skips names that start with "." or "_", which are among the most telling
files of a repository.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit import constants as K
from corpaudit.schemas import RAW_FILES
from corpaudit.storage import stored

__all__ = ["list_repo_dirs", "read_repo_dirs", "repo_ids"]

# Executors need not have this package installed.
for _module in (sys.modules[__name__], K):
    cloudpickle.register_pickle_by_value(_module)
_BROKEN_SYMLINK = K.BROKEN_SYMLINK

# What a listing tells; `enter` marks the directories of the next level.
ENTRIES = "repo_id string, root string, path string, kind string, size long, unreadable boolean, error string, enter boolean"
_ENTRY = pa.schema([
    ("repo_id", pa.string()), ("root", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()),
    ("unreadable", pa.bool_()), ("error", pa.string()), ("enter", pa.bool_()),
])
_RAW = pa.schema([
    ("repo_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()),
    ("unreadable", pa.bool_()), ("error", pa.string()), ("content", pa.binary()),
])
_BATCH_BYTES = 32 * 1024 * 1024
_BATCH_ROWS = 4096

# Directories listed by one task, and bytes read by one; a file counts for so many at least.
LISTED_DIRS = 256
READ_BYTES = 128 << 20
FILE_BYTES = 16 << 10


def _entries(repo: str, root: str, below: str, ignored: frozenset, hidden: bool) -> Iterator[tuple]:
    """Rows of one directory, as they come from the file system."""
    here = os.path.join(root, below) if below else root
    try:
        with os.scandir(here) as found:
            for entry in found:
                path = f"{below}/{entry.name}" if below else entry.name
                if entry.is_dir(follow_symlinks=True):
                    # pruned directories keep a row: their presence is evidence
                    passed = entry.name in ignored or entry.name == ".git" or entry.name.startswith(".") and not hidden
                    yield repo, root, path, "dir", 0, False, None, not passed and not entry.is_symlink()
                elif hidden or not entry.name.startswith("."):
                    size, error = 0, None
                    try:
                        if entry.is_symlink() and not os.path.exists(entry.path):
                            error = _BROKEN_SYMLINK
                        else:
                            size = entry.stat().st_size
                    except OSError as failure:
                        error = str(failure)
                    yield repo, root, path, "file", size, error is not None, error, False
    except OSError as failure:
        yield repo, root, below or ".", "dir", 0, True, str(failure), False


def _listing(ignored: frozenset, hidden: bool):
    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRY)]
            return pa.RecordBatch.from_arrays(columns, schema=_ENTRY)

        for batch in batches:
            for directory in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "root", "path"))):
                for row in _entries(*directory, ignored, hidden):
                    rows.append(row)
                    if len(rows) >= _BATCH_ROWS:
                        yield flushed()
                        rows = []
        if rows:
            yield flushed()

    return listing


def _roots(spark: SparkSession, roots: Sequence[str] | Mapping[str, str] | DataFrame) -> DataFrame:
    if isinstance(roots, DataFrame):
        return roots.select("repo_id", "root")
    named = [(repo, os.path.abspath(root)) for repo, root in repo_ids(roots).items()]
    return spark.createDataFrame(named, "repo_id string, root string")


def list_repo_dirs(
    spark: SparkSession,
    roots: Sequence[str] | Mapping[str, str] | DataFrame,
    *,
    ignored_dirs: Sequence[str] = K.IGNORED_DIRS,
    include_hidden: bool = True,
) -> DataFrame:
    """Files and directories below the roots (schema ENTRIES), listed by one job per level of depth.

    roots: paths, repository ids with paths, or a table (repo_id, root). Links to directories have a row
    and are not entered. A directory that cannot be listed is an error row, the root's path being ".".
    """
    listing = _listing(frozenset(ignored_dirs), include_hidden)
    level = stored(_roots(spark, roots).select("repo_id", "root", F.lit("").alias("path")), "roots")
    levels = []
    waiting = level.count()
    while waiting:
        spread = level.repartition(-(-waiting // LISTED_DIRS), "repo_id", "path")
        found = stored(spread.mapInArrow(listing, ENTRIES), "level")
        levels.append(found)
        level = found.filter("enter")
        waiting = level.count()
    if not levels:
        return spark.createDataFrame([], ENTRIES)
    return reduce(DataFrame.union, levels)


def _read(limit: int, names: frozenset):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                root, row["content"] = row.pop("root"), None
                # root manifests and READMEs are read at any size
                if row["kind"] == "file" and not row["unreadable"] and (row["size"] <= limit or row["path"] in names):
                    try:
                        with open(os.path.join(root, row["path"]), "rb") as handle:
                            row["content"] = handle.read()
                    except OSError:
                        pass  # size known, content not: counts as binary
                rows.append(row)
                held += len(row["content"] or b"")
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RAW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RAW)

    return read


def _in_shares(entries: DataFrame, limit: int) -> DataFrame:
    """The entries in partitions of about READ_BYTES to read, neighbours together.

    The rows are sorted over range partitions and written with their running sums; sums of the
    partitions before give each row its place in the whole, and so its share.
    """
    sort = ["repo_id", "path"]
    weight = F.when(F.col("size") <= limit, F.greatest("size", F.lit(FILE_BYTES))).otherwise(F.lit(FILE_BYTES))
    ordered = entries.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({
        "_task": F.spark_partition_id(), "_weight": weight.cast("long"), "_at": F.monotonically_increasing_id(),
    })
    kept = stored(ordered, "entries")
    here = W.partitionBy("_task").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    sums = kept.groupBy("_task").agg(F.sum("_weight").alias("_sum"))
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    starts = sums.select("_task", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    placed = kept.withColumn("_here", F.coalesce(F.sum("_weight").over(here), F.lit(0))).join(starts, "_task")
    share = F.floor((F.col("_start") + F.col("_here")) / READ_BYTES).cast("int")
    shared = placed.withColumn("_share", share).drop("_task", "_weight", "_at", "_here", "_start")
    return shared.repartitionById(total // READ_BYTES + 1, "_share").drop("_share")


def read_repo_dirs(
    spark: SparkSession,
    roots: Sequence[str] | Mapping[str, str] | DataFrame,
    *,
    ignored_dirs: Sequence[str] = K.IGNORED_DIRS,
    include_hidden: bool = True,
    max_file_size_mb: float = K.MAX_FILE_SIZE_MB,
) -> DataFrame:
    """Raw rows (schema RAW_FILES) of all files and directories below the roots.

    The trees are listed at once, contents are read when the rows are. A file beyond the size limit has
    no content unless it is a manifest or README of the root.
    """
    limit = int(max_file_size_mb * K.MEGABYTE)
    entries = list_repo_dirs(spark, roots, ignored_dirs=ignored_dirs, include_hidden=include_hidden).drop("enter")
    names = frozenset((*K.MANIFEST_NAMES, *K.README_NAMES))
    return _in_shares(entries, limit).mapInArrow(_read(limit, names), RAW_FILES)


def repo_ids(roots: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    """Repository id to directory; without given ids the directory's name, or its whole path where
    two directories share the name."""
    if isinstance(roots, Mapping):
        return dict(roots)
    paths = list(dict.fromkeys(os.path.realpath(r) for r in roots))
    names = [os.path.basename(p) or p for p in paths]
    return {n if names.count(n) == 1 else p: p for n, p in zip(names, paths)}
