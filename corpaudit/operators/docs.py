"""README quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import decode_text, readme_sections
from corpaudit.operators.findings import explode_reports, report_if
from corpaudit.operators.hygiene import exists_at


def readme_facts(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.length(text).alias("length_chars"), readme_sections(text).alias("sections")]


def readme_candidates(files: DataFrame) -> DataFrame:
    """Root READMEs with their measures; the text itself is not shuffled."""
    present = files.filter(exists_at(K.README_NAMES))
    name = F.substring_index("path", "/", 1)
    texts = present.select(
        "repo_id",
        name.alias("readme"),
        F.when(F.col("path") == name, decode_text(F.col("content"))).alias("text"),
    )
    return texts.select("repo_id", "readme", *readme_facts(F.col("text")))


def readme_scores(candidates: DataFrame, repos: DataFrame) -> DataFrame:
    """The preferred README per repository and its score; none scores 0."""
    preference = F.array_position(F.array(*[F.lit(n) for n in K.README_NAMES]), F.col("readme"))
    best = candidates.groupBy("repo_id").agg(
        F.min_by(F.struct("readme", "length_chars", "sections"), preference).alias("best")
    )
    length = F.coalesce(F.col("best.length_chars"), F.lit(0))
    sections = F.coalesce(F.col("best.sections"), F.array().cast("array<string>"))
    by_length = F.least(F.lit(50), F.floor(length / F.lit(40)).cast("int"))
    by_section = F.floor(F.size(sections) * 50 / F.lit(len(K.README_SECTIONS))).cast("int")
    score = F.when(F.col("best").isNull(), 0).otherwise(F.least(F.lit(100), by_length + by_section))
    return (
        repos.select("repo_id")
        .join(best, "repo_id", "left")
        .select(
            "repo_id",
            F.col("best.readme").alias("readme"),
            length.alias("length_chars"),
            sections.alias("sections"),
            score.alias("doc_score"),
        )
    )


def readme_findings(scores: DataFrame) -> DataFrame:
    """A missing, short or incomplete README, in one pass over the scores."""
    required = F.array(*[F.lit(s) for s in K.REQUIRED_SECTIONS])
    rows = scores.withColumn("absent", F.array_except(required, F.col("sections")))
    readme, listed = F.col("readme"), F.array_join("absent", ", ")
    reports = [
        report_if(
            readme.isNull(), id="DOC-000", severity="MEDIUM", title="No README", path="",
            explanation="Nothing documents the project.",
            recommendation="Write a README: what it is, how to install and use it, its license.",
        ),
        report_if(
            readme.isNotNull() & (F.col("length_chars") < K.SHORT_README_CHARS),
            id="DOC-001", severity="MEDIUM", title="Very short README", path=readme,
            explanation=F.concat(
                F.lit("It has "), F.col("length_chars").cast("string"), F.lit(" characters.")
            ),
            recommendation="Say more about installation, use and configuration.",
        ),
        report_if(
            readme.isNotNull() & (F.size("absent") > 0),
            id="DOC-002", severity="LOW", title="README leaves out sections", path=readme,
            explanation=F.concat(F.lit("It says nothing on: "), listed),
            recommendation=F.concat(F.lit("Cover these: "), listed),
        ),
    ]
    return explode_reports(rows, reports, "Documentation")
