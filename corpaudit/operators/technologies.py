"""Technologies a repository shows, in order of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import basename, under_any_dir
from corpaudit.operators.files import scanned_files
from corpaudit.operators.hygiene import exists_at


def nested_markers(spark) -> DataFrame:
    rows = [(n.lower(), tech) for tech, names in K.NESTED_MARKERS.items() for n in names]
    return spark.createDataFrame(rows, "marker string, technology string")


def technologies(files: DataFrame, repos: DataFrame, *, ignored_dirs: Sequence[str] = K.IGNORED_DIRS) -> DataFrame:
    """(repo_id, technologies): root markers, then nested ones by path, then counts.

    files: everything; root markers count even where a scan would not look.
    """
    scanned = ~under_any_dir(F.col("path"), sorted({*ignored_dirs, ".git"})) & (F.col("kind") == "file")
    text = scanned & ~F.col("is_binary")
    at_root = {t: exists_at(names) for t, names in K.ROOT_MARKERS.items()}
    by_count = {t: F.count_if(text & F.col("extension").isin(*e)) for t, e in K.EXTENSION_MARKERS.items()}
    facts = files.groupBy("repo_id").agg(
        *[F.bool_or(c).alias(f"root_{i}") for i, c in enumerate(at_root.values())],
        *[n.alias(f"count_{i}") for i, n in enumerate(by_count.values())],
    )

    named = scanned_files(files, ignored_dirs=ignored_dirs).select(
        "repo_id", "path", F.lower(basename(F.col("path"))).alias("marker")
    )
    nested = (
        named.join(F.broadcast(nested_markers(files.sparkSession)), "marker")
        .groupBy("repo_id", "technology")
        .agg(F.min("path").alias("path"))
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(F.struct("path", "technology"))).alias("nested"))
    )

    joined = repos.select("repo_id").join(facts, "repo_id", "left").join(nested, "repo_id", "left")
    marked = F.concat(
        F.array_compact(F.array(*[F.when(F.col(f"root_{i}"), F.lit(t)) for i, t in enumerate(at_root)])),
        F.coalesce(F.col("nested.technology"), F.array().cast("array<string>")),
    )
    joined = joined.withColumn("marked", marked)
    many = {t: F.col(f"count_{i}") >= 2 for i, t in enumerate(by_count)}
    typed = many["TypeScript"] | F.array_contains("marked", "TypeScript")
    many["JavaScript"] = many["JavaScript"] & ~typed & ~F.array_contains("marked", "Node.js")
    counted = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in many.items()]))
    found = F.array_distinct(F.concat("marked", counted))
    unknown = F.array(F.lit(K.UNKNOWN_TECHNOLOGY))
    listed = joined.withColumn("found", found)
    return listed.select(
        "repo_id", F.when(F.size("found") > 0, F.col("found")).otherwise(unknown).alias("technologies")
    )
