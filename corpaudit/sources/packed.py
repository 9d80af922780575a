"""The corpus as a table of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import suffix
from corpaudit.schemas import FILES

# Content of a packed file and of a row group in it, about; repositories that a filter may name.
FILE_BYTES = 512 << 20
GROUP_BYTES = 32 << 20
FILTERED_REPOS = 1000

__all__ = ["read_files", "write_files", "file_records", "classify_binary", "size_gate_drop", "read_errors"]


def read_files(spark: SparkSession, path: str, repos: DataFrame | None = None) -> DataFrame:
    """Packed corpus, or those of its repositories that `repos` (repo_id) names.

    Only the columns a query names are read from storage. Names of few repositories are a filter on
    storage, so row groups of other repositories are not read; beyond FILTERED_REPOS they are a join.
    """
    files = spark.read.schema(FILES).parquet(path)
    if repos is None:
        return files
    some = repos.select("repo_id").distinct().limit(FILTERED_REPOS + 1).collect()
    if len(some) > FILTERED_REPOS:
        return files.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
    return files.filter(F.col("repo_id").isin([r.repo_id for r in some]))


def write_files(files: DataFrame, path: str, *, file_bytes: int = FILE_BYTES, group_bytes: int = GROUP_BYTES) -> None:
    """Pack a corpus; flags become physical columns that filters push down to.

    The rows are clustered by repository and path. Files hold about file_bytes of content on average and
    row groups about group_bytes; a large repository spans many of them, many small ones share one.
    """
    kept = files.select(*FILES.fieldNames())
    # of the content that is there: a file's recorded size may be any, and every part is a task
    total = kept.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    parts = int(total // file_bytes) + 1
    ordered = kept.repartitionByRange(parts, "repo_id", "path").sortWithinPartitions("repo_id", "path")
    ordered.write.option("parquet.block.size", group_bytes).parquet(path)


def classify_binary(
    extension: Column,
    content: Column,
    *,
    binary_extensions: Sequence[str] = K.BINARY_EXTENSIONS,
    sniff_bytes: int = K.SNIFF_BYTES,
) -> Column:
    """Known binary extension, no content, or a NUL among the first bytes."""
    head = F.substring(content, 1, sniff_bytes)
    has_nul = F.position(F.lit(b"\x00"), head) > 0
    return extension.isin(*binary_extensions) | content.isNull() | has_nul


def file_records(
    raw: DataFrame,
    *,
    max_file_size_mb: float = K.MAX_FILE_SIZE_MB,
    source_extensions: Sequence[str] = K.SOURCE_EXTENSIONS,
    binary_extensions: Sequence[str] = K.BINARY_EXTENSIONS,
) -> DataFrame:
    """Raw rows (schema RAW_FILES) to file records (schema FILES).

    Metadata decides first, so the content of oversized files is never looked
    at; files that could not be read keep their row, flagged.
    """
    limit = int(max_file_size_mb * K.MEGABYTE)
    extension = suffix(F.col("path"))
    described = raw.withColumn("extension", extension)
    usable = (F.col("kind") == "file") & ~F.col("unreadable")
    binary = F.when(~usable, F.lit(False)).when(F.col("size") > limit, F.lit(True)).otherwise(
        classify_binary(F.col("extension"), F.col("content"), binary_extensions=binary_extensions)
    )
    flagged = described.withColumn("is_binary", binary)
    source = usable & ~F.col("is_binary") & F.col("extension").isin(*source_extensions)
    return flagged.withColumn("is_source", source).select(*FILES.fieldNames())


def size_gate_drop(files: DataFrame, *, max_file_size_mb: float = K.MAX_FILE_SIZE_MB) -> DataFrame:
    """Drop oversized and unreadable files instead of keeping them flagged."""
    limit = int(max_file_size_mb * K.MEGABYTE)
    return files.filter((F.col("size") <= limit) & ~F.col("unreadable"))


def read_errors(files: DataFrame) -> DataFrame:
    """One row per directory that could not be entered; unreadable files are no scan errors."""
    failed = files.filter((F.col("kind") == "dir") & F.col("error").isNotNull())
    return failed.select("repo_id", "path", "error")
