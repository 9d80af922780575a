"""Line statistics per file and per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit import constants as K
from corpaudit.functions import (
    count_blank, count_comments, count_lines, count_long, count_marker,
    decode_text, hashed_id, split_lines, unify_newlines,
)
from corpaudit.operators.files import code_candidates
from corpaudit.operators.findings import finding_rows

LINE_COUNTS = (
    "total_lines", "blank_lines", "comment_lines", "code_lines", "long_lines",
    "todo", "fixme", "xxx",
)


def with_text(files: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    return files.withColumn("text", decode_text(F.col("content"), max_bytes))


def lines(texts: DataFrame) -> DataFrame:
    """(repo_id, path, line_no from 1, line) of rows that carry a text."""
    # outer, as otherwise a size filter would split every text a second time
    exploded = texts.select("repo_id", "path", F.posexplode_outer(split_lines(F.col("text"))))
    return exploded.filter(F.col("pos").isNotNull()).select(
        "repo_id", "path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line")
    )


def with_line_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add the line counts to rows with a text and an extension, without exploding.

    Every count is one native pass over the text; nothing is shuffled and no
    line becomes a row.
    """
    unified = texts.withColumn("__unified", unify_newlines(F.col(text)))
    upper = unified.withColumn("__upper", F.upper("__unified"))
    body, extension = F.col("__unified"), F.col("extension")
    counted = upper.withColumns({
        "total_lines": count_lines(body),
        "blank_lines": count_blank(body),
        "comment_lines": count_comments(body, extension),
        "long_lines": count_long(body),
        **{m.lower(): count_marker(F.col("__upper"), m) for m in K.MARKERS},
    })
    code = F.col("total_lines") - F.col("blank_lines") - F.col("comment_lines")
    return counted.withColumn("code_lines", F.greatest(F.lit(0), code).cast("bigint")).drop(
        "__unified", "__upper"
    )


def file_line_stats(files: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    texts = with_text(code_candidates(files), max_bytes=max_bytes)
    return with_line_counts(texts).select("repo_id", "path", "extension", "size", *LINE_COUNTS)


def code_stats(file_stats: DataFrame, repos: DataFrame, python_stats: DataFrame | None = None) -> DataFrame:
    """Sums per repository; repositories without code get zeros.

    python_stats (see python_code.python_metrics) adds its four counts.
    """
    sums = file_stats.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("source_files"),
        *[F.sum(c).alias(c) for c in LINE_COUNTS],
    )
    names = ["source_files", *LINE_COUNTS]
    joined = repos.select("repo_id").join(sums, "repo_id", "left")
    if python_stats is not None:
        parsed = python_stats.groupBy("repo_id").agg(*python_sums())
        joined = joined.join(parsed, "repo_id", "left")
        names += ["functions", "classes", "imports", "syntax_errors"]
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in names]
    return joined.select("repo_id", *zeros)


def python_sums() -> list[Column]:
    return [
        F.sum("functions").alias("functions"),
        F.sum("classes").alias("classes"),
        F.sum("imports").alias("imports"),
        F.count("syntax_error").alias("syntax_errors"),
    ]


def extension_distribution(file_stats: DataFrame) -> DataFrame:
    return file_stats.groupBy("repo_id", "extension").agg(F.count(F.lit(1)).alias("files"))


def largest_files(file_stats: DataFrame, *, top: int = K.TOP_FILES) -> DataFrame:
    """Largest analyzed files per repository; each task forwards at most top rows."""
    window = W.partitionBy("repo_id").orderBy(F.desc("size"), "path")
    return (
        file_stats.select("repo_id", "path", "size")
        .withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= top)
    )


def long_line_findings(file_stats: DataFrame) -> DataFrame:
    many = file_stats.filter(F.col("long_lines") > K.LONG_LINES_PER_FILE)
    return finding_rows(
        many,
        id=hashed_id("CODE-LONGLINES-", F.col("path")),
        severity="LOW",
        category="Code Health",
        title="Many overlong lines",
        path=F.col("path"),
        explanation=F.concat(
            F.col("long_lines").cast("string"),
            F.lit(f" lines run past {K.LONG_LINE_CHARS} characters."),
        ),
        recommendation="Wrap or reformat the overlong lines.",
    )
