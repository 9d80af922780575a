"""Health scores: penalties per dimension, one weighted number per repository."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import severity_penalty


def _dimension() -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for category, dimension in K.CATEGORY_DIMENSIONS.items():
        chain = chain.when(F.col("category") == category, F.lit(dimension))
    return chain


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def dimension_scores(findings: DataFrame, repos: DataFrame, doc_scores: DataFrame | None = None) -> DataFrame:
    """Five scores per repository, 100 where nothing was found.

    One partial aggregation over (repo_id, severity, category): a huge
    repository costs each task a single row. doc_scores (repo_id, doc_score)
    caps the documentation dimension.
    """
    penalty = severity_penalty(F.col("severity"))
    lost = findings.groupBy("repo_id").agg(
        *[
            F.sum(F.when(F.col("category") == category, penalty)).alias(dimension)
            for category, dimension in K.CATEGORY_DIMENSIONS.items()
        ]
    )
    joined = repos.select("repo_id").join(lost, "repo_id", "left")
    scores = {d: 100 - F.coalesce(F.col(d), F.lit(0)) for d in K.DIMENSIONS}
    if doc_scores is not None:
        joined = joined.join(doc_scores.select("repo_id", "doc_score"), "repo_id", "left")
        scores["documentation"] = F.least(scores["documentation"], F.coalesce("doc_score", F.lit(0)))
    return joined.select("repo_id", *[_clamped(s).alias(d) for d, s in scores.items()])


def overall_score(dimensions: DataFrame, *, weights: Mapping[str, str] = K.WEIGHTS) -> DataFrame:
    """Weighted sum in exact decimals, ties to even.

    Dimensions without a weight are left out of the result.
    """
    terms = [
        F.col(d).cast("decimal(3,0)") * F.lit(str(w)).cast("decimal(9,6)") for d, w in weights.items()
    ]
    overall = F.bround(reduce(add, terms), 0).cast("int")
    kept = [d for d in K.DIMENSIONS if d in weights]
    return dimensions.select("repo_id", overall.alias("overall"), *kept)


def scores(
    findings: DataFrame,
    repos: DataFrame,
    doc_scores: DataFrame | None = None,
    *,
    weights: Mapping[str, str] = K.WEIGHTS,
) -> DataFrame:
    return overall_score(dimension_scores(findings, repos, doc_scores), weights=weights)


def reason_text() -> Column:
    """Why a finding costs points."""
    penalty = severity_penalty(F.col("severity"))
    return F.concat(
        F.lit("-"), penalty.cast("string"), F.lit(" for "), F.col("severity"),
        F.lit(" finding ["), F.col("id"), F.lit("] "), F.col("title"),
    )


def doc_reason(doc_score: Column) -> Column:
    return F.concat(F.lit("README score: "), doc_score.cast("string"), F.lit("/100"))


def score_reasons(findings: DataFrame, doc_scores: DataFrame) -> DataFrame:
    """One row per deduction and one README line per repository."""
    deductions = findings.filter(severity_penalty(F.col("severity")) > 0).select(
        "repo_id", _dimension().alias("dimension"), reason_text().alias("reason")
    )
    readme = doc_scores.select(
        "repo_id", F.lit("documentation").alias("dimension"), doc_reason(F.col("doc_score")).alias("reason")
    )
    return deductions.filter(F.col("dimension").isNotNull()).unionByName(readme)
