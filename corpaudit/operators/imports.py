"""Which modules Python code imports, and where they come from."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Looks like the standard library, is not. Fixed value.
KNOWN_THIRD_PARTY = ("typing_extensions",)


def stdlib_modules() -> list[str]:
    """Names the running interpreter calls its own."""
    return sorted({*sys.stdlib_module_names, *sys.builtin_module_names})


def module_classes(
    spark,
    first_party: Sequence[str] = (),
    *,
    stdlib: Sequence[str] | None = None,
    third_party: Sequence[str] = KNOWN_THIRD_PARTY,
) -> DataFrame:
    """(module, is_stdlib, is_first_party, is_third_party), a few hundred rows."""
    stdlib = set(stdlib_modules() if stdlib is None else stdlib)
    first, third = set(first_party), set(third_party)
    rows = [(m, m in stdlib, m in first, m in third) for m in sorted(stdlib | first | third)]
    return spark.createDataFrame(
        rows, "module string, is_stdlib boolean, is_first_party boolean, is_third_party boolean"
    )


def import_classes(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct modules per repository with their class.

    imports (repo_id, path, module) is reduced to distinct modules before the
    join; Spark chooses how, by the size of the name list.
    """
    counted = imports.groupBy("repo_id", "module").agg(F.count(F.lit(1)).alias("files"))
    joined = counted.join(modules, "module", "left")
    known = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_stdlib", "is_first_party", "is_third_party")}
    name = (
        F.when(known["is_first_party"], "first_party")
        .when(known["is_stdlib"], "stdlib")
        .when(known["is_third_party"], "third_party")
        .otherwise("needs_review")
    )
    return joined.select(
        "repo_id", "module", "files", name.alias("class"),
        known["is_stdlib"].alias("is_stdlib"), known["is_first_party"].alias("is_first_party"),
    )


def unknown_modules(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct imported modules that are neither first party nor stdlib."""
    own = modules.filter(F.col("is_stdlib") | F.col("is_first_party")).select("module")
    return imports.select("repo_id", "module").distinct().join(own, "module", "left_anti").select(
        "repo_id", "module"
    )


def import_census(classes: DataFrame, repos: DataFrame) -> DataFrame:
    """Module counts per repository and the verdict of the audit."""
    counts = classes.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("modules"),
        F.count_if("is_stdlib").alias("stdlib"),
        F.count_if("is_first_party").alias("first_party"),
        F.count_if(F.col("class") == "third_party").alias("third_party"),
        F.count_if(F.col("class") == "needs_review").alias("needs_review"),
    )
    names = ["modules", "stdlib", "first_party", "third_party", "needs_review"]
    zeros = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]
    filled = repos.select("repo_id").join(counts, "repo_id", "left").select("repo_id", *zeros)
    verdict = (
        F.when(F.col("needs_review") > 0, "NEEDS REVIEW")
        .when(F.col("third_party") > 0, "FAIL")
        .otherwise("PASS")
    )
    return filled.withColumn("verdict", verdict)
