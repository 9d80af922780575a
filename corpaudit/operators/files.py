"""Filters over file records. All look at metadata columns only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import is_hidden, under_any_dir


def only_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("kind") == "file")


def drop_ignored_dirs(files: DataFrame, *, ignored_dirs: Sequence[str] = K.IGNORED_DIRS) -> DataFrame:
    """Drop what lies below an ignored directory; ".git" is always ignored."""
    names = sorted({*ignored_dirs, ".git"})
    return files.filter(~under_any_dir(F.col("path"), names))


def drop_hidden(files: DataFrame) -> DataFrame:
    return files.filter(~is_hidden(F.col("path")))


def scanned_files(
    files: DataFrame,
    *,
    ignored_dirs: Sequence[str] = K.IGNORED_DIRS,
    include_hidden: bool = True,
) -> DataFrame:
    """The files a scan looks at, out of everything a repository holds."""
    kept = drop_ignored_dirs(only_files(files), ignored_dirs=ignored_dirs)
    return kept if include_hidden else drop_hidden(kept)


def _readable_text(files: DataFrame) -> DataFrame:
    return only_files(files).filter(~F.col("is_binary") & ~F.col("unreadable"))


def secret_candidates(files: DataFrame) -> DataFrame:
    return _readable_text(files)


def is_code_candidate(prose_extensions: Sequence[str] = K.PROSE_EXTENSIONS):
    return (
        ~F.col("is_binary")
        & ~F.col("unreadable")
        & (F.col("is_source") | F.col("extension").isin(*prose_extensions))
    )


def code_candidates(files: DataFrame, *, prose_extensions: Sequence[str] = K.PROSE_EXTENSIONS) -> DataFrame:
    return only_files(files).filter(is_code_candidate(prose_extensions))


def is_duplicate_candidate(max_bytes: int | None = K.DUPLICATE_MAX_BYTES):
    wanted = ~F.col("is_binary") & ~F.col("unreadable") & (F.col("size") > 0)
    return wanted if max_bytes is None else wanted & (F.col("size") <= max_bytes)


def duplicate_candidates(files: DataFrame, *, max_bytes: int | None = K.DUPLICATE_MAX_BYTES) -> DataFrame:
    return only_files(files).filter(is_duplicate_candidate(max_bytes))


def python_audit_files(files: DataFrame, *, excluded_dirs: Sequence[str] = K.IGNORED_DIRS_IMPORTS) -> DataFrame:
    """Python files outside the excluded directories (a file so named is out too)."""
    path = F.col("path")
    named = F.substring_index(path, "/", -1).isin(*excluded_dirs)
    python = F.endswith(path, F.lit(".py"))
    return only_files(files).filter(python & ~under_any_dir(path, excluded_dirs) & ~named)
