"""Text columns: decoding, lines, markers, placeholders. JVM expressions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpaudit import constants as K

__all__ = [
    "decode_text", "unify_newlines", "split_lines", "py_strip", "count_lines",
    "count_blank", "count_comments", "count_long", "count_marker",
    "is_comment_line", "has_marker", "is_placeholder", "readme_sections",
]

# Line separators other than "\n"; "\r\n" is one separator, tried first.
_RARE_SEPARATORS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_RARE_PATTERN = f"\r\n|[{_RARE_SEPARATORS}]"
# Whitespace in the Unicode sense, plus four control characters.
_SPACE = r"\s\x1c-\x1f"
_SPACE_IN_LINE = rf"[{_SPACE}&&[^\n]]"


def decode_text(content: Column, max_bytes: int | None = None) -> Column:
    """UTF-8 text of a binary column; bad bytes become U+FFFD, never an error."""
    if max_bytes is not None:
        content = F.substring(content, 1, max_bytes)
    return F.make_valid_utf8(content.cast("string"))


def unify_newlines(text: Column) -> Column:
    """Text with every line separator written as a single newline.

    Byte searches decide whether the regular expression has to run at all; for
    ordinary text it never does.
    """
    rare = reduce(or_, [F.contains(text, F.lit(c)) for c in _RARE_SEPARATORS])
    return F.when(rare, F.regexp_replace(text, _RARE_PATTERN, "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines without separators; no empty line after a trailing separator."""
    unified = unify_newlines(text)
    body = F.regexp_replace(unified, r"\n\z", "")
    empty = F.array().cast("array<string>")
    return F.when(F.length(text) == 0, empty).otherwise(F.split(body, "\n", -1))


def py_strip(text: Column) -> Column:
    """Strip Unicode whitespace at both ends (Spark's trim strips spaces only)."""
    return F.regexp_replace(text, rf"(?U)\A[{_SPACE}]+|[{_SPACE}]+\z", "")


# The counters below take text that went through unify_newlines. In Java "^"
# under (?md) matches after each newline but not at the very end of the input,
# which is exactly where the lines of split_lines start.

def count_lines(unified: Column) -> Column:
    breaks = F.octet_length(unified) - F.octet_length(
        F.replace(unified, F.lit("\n"), F.lit(""))
    )
    open_end = (F.octet_length(unified) > 0) & ~F.endswith(unified, F.lit("\n"))
    return (breaks + open_end.cast("int")).cast("bigint")


def count_blank(unified: Column) -> Column:
    return F.regexp_count(unified, F.lit(rf"(?dmU)^{_SPACE_IN_LINE}*$")).cast("bigint")


def count_comments(unified: Column, extension: Column) -> Column:
    """Lines that start, after whitespace, with a comment prefix of the extension."""
    both = set(K.COMMENT_PREFIXES["#"]) & set(K.COMMENT_PREFIXES["//"])
    prefixes = {"#|//": tuple(sorted(both))}
    for prefix, extensions in K.COMMENT_PREFIXES.items():
        prefixes[prefix] = tuple(e for e in extensions if e not in both)
    counted = F.when(F.lit(False), F.lit(0))
    for prefix, extensions in prefixes.items():
        pattern = rf"(?dmU)^{_SPACE_IN_LINE}*(?:{prefix})"
        counted = counted.when(
            extension.isin(*extensions), F.regexp_count(unified, F.lit(pattern))
        )
    return counted.otherwise(0).cast("bigint")


def count_long(unified: Column, limit: int = K.LONG_LINE_CHARS) -> Column:
    counted = F.regexp_count(unified, F.lit(rf"(?dm)^[^\n]{{{limit + 1}}}"))
    return F.when(F.octet_length(unified) <= limit, 0).otherwise(counted).cast("bigint")


def count_marker(unified_upper: Column, marker: str) -> Column:
    """Lines that contain the marker, each counted once."""
    counted = F.regexp_count(unified_upper, F.lit(marker + r"[^\n]*"))
    present = F.contains(unified_upper, F.lit(marker))
    return F.when(present, counted).otherwise(0).cast("bigint")


def is_comment_line(line: Column, extension: Column) -> Column:
    stripped = py_strip(line)
    tests = [
        extension.isin(*extensions) & F.startswith(stripped, F.lit(prefix))
        for prefix, extensions in K.COMMENT_PREFIXES.items()
    ]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def has_marker(line: Column, marker: str) -> Column:
    return F.contains(F.upper(line), F.lit(marker))


def is_placeholder(value: Column) -> Column:
    """True for values that stand in for a secret rather than being one."""
    bare = F.lower(F.regexp_replace(py_strip(value), "\\A['\"]+|['\"]+\\z", ""))
    return (
        (F.length(bare) < 8)
        | bare.isin(*K.PLACEHOLDERS)
        | bare.rlike(r"\A(?:x{4,}|\*{4,}|0{4,})\z")
    )


def readme_sections(text: Column) -> Column:
    """Sections a README covers, in fixed order."""
    lowered = F.lower(text)
    found = [
        F.when(
            reduce(or_, [F.contains(lowered, F.lit(word)) for word in words]),
            F.lit(section),
        )
        for section, words in K.README_SECTIONS.items()
    ]
    return F.array_compact(F.array(*found))
