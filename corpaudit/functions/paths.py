"""Path columns. Paths are relative to the repository root, "/"-separated."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["basename", "suffix", "under_any_dir", "is_hidden", "relative_path", "location"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix; ".env" and "name." have none."""
    return F.regexp_extract(F.lower(basename(path)), r"(?s)\A.+(\.[^.]+)\z", 1)


def under_any_dir(path: Column, names: Sequence[str]) -> Column:
    """True when a directory above the file carries one of the names."""
    choice = "|".join(re.escape(name) for name in names)
    return path.rlike(f"(?:^|/)(?:{choice})/")


def is_hidden(path: Column) -> Column:
    """True when the file or a directory above it starts with a dot."""
    return F.startswith(path, F.lit(".")) | F.contains(path, F.lit("/."))


def relative_path(path: Column, root: Column) -> Column:
    """Path below root; a path elsewhere stays as it is."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    inside = F.startswith(path, prefix)
    below = F.substr(path, F.length(prefix) + 1)
    return F.when(path == root, F.lit(".")).when(inside, below).otherwise(path)


def location(path: Column, line: Column, fallback: str = "Repository-wide") -> Column:
    """"path:line", "path" without a line, or the fallback without a path."""
    lined = F.concat(F.coalesce(path, F.lit("")), F.lit(":"), line.cast("string"))
    bare = F.when(F.length(path) > 0, path).otherwise(F.lit(fallback))
    return F.when(F.coalesce(line, F.lit(0)) != 0, lined).otherwise(bare)
