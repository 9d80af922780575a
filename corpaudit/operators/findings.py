"""The findings table: building rows, uniting them, ordering and ranking them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpaudit import constants as K
from corpaudit.functions import location, severity_rank
from corpaudit.operators.skew import numbered
from corpaudit.schemas import FINDING_COLUMNS

ALL_CLEAR = "Nothing of note was found; keep it that way."
DEFAULT_ACTION = "Look into the finding and settle it as your policies require."


def finding_rows(
    rows: DataFrame,
    *,
    id,
    severity,
    category: str,
    title,
    path="",
    line=None,
    evidence="",
    explanation="",
    recommendation="",
) -> DataFrame:
    """Project rows that carry repo_id to the findings schema."""
    rank = severity_rank(severity) if isinstance(severity, Column) else K.SEVERITIES.index(severity)
    values = {
        "repo_id": F.col("repo_id"),
        "id": id,
        "severity": severity,
        "severity_rank": rank,
        "category": category,
        "title": title,
        "path": path,
        "line": F.lit(line).cast("int"),
        "evidence": evidence,
        "explanation": explanation,
        "recommendation": recommendation,
    }
    return rows.select(*[F.lit(values[name]).alias(name) for name in FINDING_COLUMNS])


def report_if(condition: Column, **values) -> Column:
    """One possible finding of a row, for explode_reports."""
    return F.when(condition, F.struct(*[F.lit(v).alias(n) for n, v in values.items()]))


def explode_reports(rows: DataFrame, reports: Sequence[Column], category: str) -> DataFrame:
    """Findings of all reports in one pass over the rows.

    Every report has the same fields: id, severity, title, path, explanation,
    recommendation. The outer explode keeps rows from being computed twice.
    """
    listed = F.array_compact(F.array(*reports))
    found = rows.select("repo_id", F.explode_outer(listed).alias("report"))
    return finding_rows(
        found.filter(F.col("report").isNotNull()).select("repo_id", "report.*"),
        id=F.col("id"), severity=F.col("severity"), category=category, title=F.col("title"),
        path=F.col("path"), explanation=F.col("explanation"), recommendation=F.col("recommendation"),
    )


def all_findings(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of the checks that are enabled."""
    return reduce(DataFrame.unionByName, parts)


def canonical_order() -> list[Column]:
    """Most urgent first, then category, path, line and id."""
    return [
        F.col("severity_rank"),
        F.col("category"),
        F.col("path"),
        F.coalesce(F.col("line"), F.lit(0)),
        F.col("id"),
    ]


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Total order by repository; Spark range-partitions, so no task holds a repo."""
    return findings.orderBy("repo_id", *canonical_order())


def severity_at_or_above(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity_rank") <= K.SEVERITIES.index(severity.upper()))


def drop_info(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity") != "INFO")


def finding_counts(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings per severity for every repository, zeros included."""
    counts = findings.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in K.SEVERITIES]
    )
    zeros = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in K.SEVERITIES]
    return repos.select("repo_id").join(counts, "repo_id", "left").select("repo_id", *zeros)


def fix_plan(findings: DataFrame) -> DataFrame:
    """Numbered remediation steps per repository in canonical order."""
    action = F.when(F.length("recommendation") > 0, F.col("recommendation"))
    return numbered(findings, ["repo_id"], canonical_order(), "step").select(
        "repo_id",
        "step",
        F.col("severity").alias("priority"),
        "id",
        "title",
        location(F.col("path"), F.col("line")).alias("location"),
        F.col("explanation").alias("reason"),
        F.coalesce(action, F.lit(DEFAULT_ACTION)).alias("action"),
    )


def recommendations(findings: DataFrame, repos: DataFrame, *, max_items: int = K.TOP_RECOMMENDATIONS) -> DataFrame:
    """The most urgent distinct titles per repository, as advice.

    The first finding per title is a minimum, so partial aggregation shrinks a
    huge repository before the shuffle; the rank filter then keeps at most
    max_items rows per task and repository (WindowGroupLimit).
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(canonical_order())], "recommendation")
    firsts = (
        drop_info(findings)
        .groupBy("repo_id", "title")
        .agg(F.min(order).alias("first"))
        .select("repo_id", "first.*")
        .filter(F.length("recommendation") > 0)
    )
    ranked = firsts.withColumn(
        "position",
        F.row_number().over(W.partitionBy("repo_id").orderBy("o0", "o1", "o2", "o3", "o4")),
    ).filter(F.col("position") <= max_items)
    joined = repos.select("repo_id").join(ranked, "repo_id", "left")
    return joined.select(
        "repo_id",
        F.coalesce("position", F.lit(1)).cast(T.IntegerType()).alias("position"),
        F.coalesce("recommendation", F.lit(ALL_CLEAR)).alias("recommendation"),
    )


def error_limit(errors: DataFrame, *, max_items: int = K.TOP_ERRORS) -> DataFrame:
    """The first errors per repository by path."""
    window = W.partitionBy("repo_id").orderBy("path", "error")
    return (
        errors.withColumn("position", F.row_number().over(window))
        .filter(F.col("position") <= max_items)
        .select("repo_id", "position", "path", "error")
    )


def quality_gate(findings: DataFrame, repos: DataFrame, *, fail_on: str | None = None) -> DataFrame:
    """PASS or FAIL per repository; without a threshold any finding fails."""
    bound = len(K.SEVERITIES) if fail_on is None else K.SEVERITIES.index(fail_on.upper())
    breached = findings.groupBy("repo_id").agg(
        F.bool_or(F.col("severity_rank") <= bound).alias("breached")
    )
    failed = F.coalesce(F.col("breached"), F.lit(False))
    return (
        repos.select("repo_id")
        .join(breached, "repo_id", "left")
        .select("repo_id", F.when(failed, "FAIL").otherwise("PASS").alias("gate"))
    )
