"""Hashes, entropy, redaction, sizes, severities. JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpaudit import constants as K

__all__ = [
    "content_sha256", "stable_hash_int", "digest_id", "hashed_id", "shannon_entropy", "redact",
    "human_size", "severity_rank", "severity_penalty", "score_band",
    "strip_version_spec", "evaluated_once",
]


def evaluated_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content_sha256(content: Column, max_bytes: int | None = None) -> Column:
    if max_bytes is not None:
        content = F.substring(content, 1, max_bytes)
    return F.sha2(content, 256)


def _digest_int(digest: Column, modulo: int) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(modulo)


def stable_hash_int(value: Column, modulo: int = K.ID_MODULO) -> Column:
    """First 32 bits of the SHA-256 of the text, modulo a number."""
    return _digest_int(F.sha2(value.cast("binary"), 256), modulo)


def digest_id(prefix: str, digest: Column) -> Column:
    """An id from a SHA-256 in hexadecimal."""
    return F.concat(F.lit(prefix), F.lpad(_digest_int(digest, K.ID_MODULO).cast("string"), 3, "0"))


def hashed_id(prefix: str, value: Column) -> Column:
    return digest_id(prefix, F.sha2(value.cast("binary"), 256))


def shannon_entropy(value: Column) -> Column:
    """Bits per character of a short string; 0.0 for an empty one."""
    counts = F.transform(
        F.array_distinct(F.split(value, "")),
        lambda c: F.length(value) - F.length(F.replace(value, c, F.lit(""))),
    )
    total = F.length(value).cast("double")
    bits = F.aggregate(
        counts,
        F.lit(0.0),
        lambda acc, n: acc - F.when(n > 0, (n / total) * F.log2(n / total)).otherwise(0.0),
    )
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(bits + F.lit(0.0))


def redact(value: Column, keep_prefix: int = 4, min_stars: int = 4) -> Column:
    """Keep a short prefix, star out the rest; min_stars=0 is the compact form."""
    hidden = F.length(value) - keep_prefix
    stars = F.least(F.lit(16), F.greatest(F.lit(min_stars), hidden))
    return F.when(hidden <= 0, F.repeat(F.lit("*"), F.length(value))).otherwise(
        F.concat(F.left(value, F.lit(keep_prefix)), F.repeat(F.lit("*"), stars))
    )


def _tenths(num_bytes: Column, unit: int) -> Column:
    """num_bytes / unit (a power of two), one decimal, ties to the even digit."""
    scaled = num_bytes * 10
    whole = F.shiftright(scaled, unit.bit_length() - 1)
    twice_rest = (scaled - whole * unit) * 2
    up = (twice_rest > unit) | ((twice_rest == unit) & (whole % 2 == 1))
    tenths = whole + up.cast("int")
    first = F.floor(tenths / F.lit(10)).cast("string")
    return F.concat(first, F.lit("."), (tenths % 10).cast("string"))


def human_size(num_bytes: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB in steps of 1024, one decimal above B."""
    num_bytes = num_bytes.cast("bigint")
    shown = F.when(num_bytes < 1024, F.concat(num_bytes.cast("string"), F.lit("B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        text = F.concat(_tenths(num_bytes, 1024**power), F.lit(unit))
        shown = shown.when(num_bytes < 1024 ** (power + 1), text)
    return shown.otherwise(F.concat(_tenths(num_bytes, 1024**4), F.lit("TB")))


def _by_severity(severity: Column, values: dict[str, int]) -> Column:
    chain = F.when(F.lit(False), F.lit(0))
    for name, value in values.items():
        chain = chain.when(severity == name, F.lit(value))
    return chain


def severity_rank(severity: Column) -> Column:
    return _by_severity(severity, {name: i for i, name in enumerate(K.SEVERITIES)})


def severity_penalty(severity: Column) -> Column:
    return _by_severity(severity, K.PENALTIES)


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def strip_version_spec(dependency: Column) -> Column:
    return F.regexp_extract(dependency, r"(?sU)\A([^<>=!~\[\s]*)", 1)
