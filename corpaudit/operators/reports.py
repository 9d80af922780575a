"""Report tables: summary, nested documents, CSV rows, dashboard data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import location, severity_penalty
from corpaudit.operators.findings import canonical_order, finding_counts, sorted_findings
from corpaudit.operators.scoring import doc_reason, reason_text
from corpaudit.operators.skew import numbered

# Entries per section in one report document.
PART_ROWS = 10_000
_CSV = ["id", "severity", "category", "title", "path", "line", "explanation", "recommendation"]


def file_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files_scanned"))


def summary(
    repos: DataFrame, scanned_counts: DataFrame, code_stats: DataFrame, findings: DataFrame, scores: DataFrame
) -> DataFrame:
    """One row per repository: sizes, findings per severity, scores."""
    counts = finding_counts(findings, repos)
    joined = (
        repos.select("repo_id")
        .join(scanned_counts, "repo_id", "left")
        .join(code_stats.select("repo_id", "source_files", "total_lines"), "repo_id", "left")
        .join(counts, "repo_id", "left")
        .join(scores, "repo_id", "left")
    )
    zeros = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("files_scanned", "source_files", "total_lines")}
    return joined.withColumns(zeros)


def csv_findings(findings: DataFrame) -> DataFrame:
    """Findings as eight text-friendly columns after repo_id; evidence stays out."""
    line = F.when(F.coalesce("line", F.lit(0)) != 0, F.col("line").cast("string"))
    filled = findings.withColumn("line_text", F.coalesce(line, F.lit("")))
    columns = [F.col("line_text").alias("line") if c == "line" else F.col(c) for c in _CSV]
    return filled.select("repo_id", *columns)


def csv_summary(summaries: DataFrame) -> DataFrame:
    """(repo_id, name, value) rows of the block below the findings."""
    names = {
        "files_scanned": "files_scanned", "source_files": "source_files", "total_lines": "total_lines",
        "overall_score": "overall", "security_score": "security",
        "dependencies_score": "dependencies", "code_health_score": "code_health",
        "documentation_score": "documentation", "hygiene_score": "hygiene",
    }
    pairs = [F.struct(F.lit(n).alias("name"), F.col(c).cast("bigint").alias("value")) for n, c in names.items()]
    rows = summaries.select("repo_id", F.explode(F.array(*pairs)).alias("pair"))
    return rows.select("repo_id", "pair.name", "pair.value")


def write_csv(findings: DataFrame, summaries: DataFrame, folder: str) -> None:
    ordered = csv_findings(sorted_findings(findings))
    ordered.write.option("header", True).option("emptyValue", "").csv(f"{folder}/findings")
    csv_summary(summaries).write.option("header", True).csv(f"{folder}/summary")


def write_json(report: DataFrame, folder: str) -> None:
    report.write.json(folder)


def dashboard_findings(findings: DataFrame) -> DataFrame:
    where = location(F.col("path"), F.col("line"), fallback="")
    return findings.select(
        "repo_id", "id", "severity", "category", "title", where.alias("location"), "explanation"
    )


def dashboard_dependencies(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        "repo_id", "ecosystem", "manifest_file",
        F.size("runtime").alias("runtime_dependencies"),
        F.when(F.col("lockfile_present"), "yes").otherwise("no").alias("lockfile"),
    )


_ORDER = "o0 int, o1 string, o2 string, o3 int, o4 string"


def _entries(rows: DataFrame, name: str, order: Sequence[Column], entry: Column) -> DataFrame:
    """Rows of one list: repository, list, place in it, and the entry under the list's name."""
    kinds = [f.strip().split() for f in _ORDER.split(",")]
    places = [c.cast(kind).alias(column) for c, (column, kind) in zip(order, kinds)]
    return rows.select("repo_id", F.lit(name).alias("list"), *places, entry.alias(name))


def _lists(tables: Sequence[DataFrame], names: Sequence[str], part_rows: int) -> DataFrame:
    """All lists in parts of at most part_rows entries each, in order, per (repo_id, part).

    The entries of all lists are one tall table that is numbered once.
    """
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    order = [F.col(f.strip().split()[0]) for f in _ORDER.split(",")]
    steps = numbered(tall, ["repo_id", "list"], order, "__step")
    part = F.floor((F.col("__step") - 1) / F.lit(part_rows)).cast("int").alias("part")

    def gathered(name: str) -> Column:
        pair = F.when(F.col("list") == name, F.struct("__step", F.col(name).alias("entry")))
        return F.transform(F.array_sort(F.collect_list(pair)), lambda e: e["entry"]).alias(name)

    return steps.groupBy("repo_id", part).agg(*[gathered(n) for n in names])


def json_report(
    *,
    repos: DataFrame,
    summaries: DataFrame,
    technologies: DataFrame,
    manifests: DataFrame,
    code_stats: DataFrame,
    extensions: DataFrame,
    largest: DataFrame,
    findings: DataFrame,
    duplicate_members: DataFrame,
    doc_scores: DataFrame,
    recommendations: DataFrame,
    errors: DataFrame,
    weights: Mapping[str, str] = K.WEIGHTS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Nested documents per repository.

    Every list of a repository is cut into parts of part_rows entries; part 0
    also holds what there is once. Lists that fit are whole in part 0, longer
    ones go on in further parts, nothing left out. So a document has a bounded
    size and no task collects a whole huge repository. Equal files are listed
    one by one (duplicate_members with first_path), each with the first file of
    its group.
    """
    finding = F.struct(
        "id", "severity", "category", "title", "path", "line", "evidence", "explanation",
        "recommendation", reason_text().alias("reason"), severity_penalty(F.col("severity")).alias("penalty"),
    )
    none = F.lit(0)
    names = ["raw", "duplicate_groups", "extension_distribution", "errors"]
    tables = [
        _entries(findings, "raw", canonical_order(), finding),
        _entries(
            duplicate_members, "duplicate_groups", [none, F.col("first_path"), F.col("member")],
            F.struct(F.col("first_path").alias("first"), F.col("member").alias("path")),
        ),
        _entries(extensions, "extension_distribution", [none, F.col("extension")], F.struct("extension", "files")),
        _entries(errors, "errors", [none, F.col("path"), F.col("error")], F.concat_ws(": ", "path", "error")),
    ]
    lists = _lists(tables, names, part_rows)

    def listed(rows: DataFrame, order: str, entry: Column, name: str) -> DataFrame:
        # bounded per repository: six manifests, ten files, eight recommendations
        pair = F.struct(F.col(order).alias("o"), entry.alias("entry"))
        lists = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(pair)).alias("es"))
        return lists.select("repo_id", F.transform("es", lambda e: e["entry"]).alias(name))

    measures = [c for c in code_stats.columns if c != "repo_id"]
    declared = F.struct(
        "ecosystem", "manifest_file", F.col("runtime").alias("runtime_dependencies"),
        F.col("dev").alias("dev_dependencies"), "pinned", "lockfile_present",
        F.col("duplicates").alias("duplicate_declarations"),
    )
    head = (
        repos.select("repo_id")
        .join(summaries, "repo_id", "left")
        .join(technologies, "repo_id", "left")
        .join(listed(manifests, "manifest_file", declared, "manifests"), "repo_id", "left")
        .join(code_stats.select("repo_id", F.struct(*measures).alias("code")), "repo_id", "left")
        .join(listed(largest, "position", F.struct("path", "size"), "largest_files"), "repo_id", "left")
        .join(listed(recommendations, "position", F.col("recommendation"), "advice"), "repo_id", "left")
        .join(doc_scores.select("repo_id", "doc_score"), "repo_id", "left")
        .withColumn("part", F.lit(0))
    )
    whole = head.join(lists, ["repo_id", "part"], "full_outer")

    is_head = F.col("part") == 0
    raw = F.coalesce("raw", F.array().cast(lists.schema["raw"].dataType))

    def reasons(category: str, dimension: str) -> Column:
        own = F.transform(
            F.filter(raw, lambda f: (f["category"] == category) & (f["penalty"] > 0)), lambda f: f["reason"]
        )
        if dimension == "documentation":
            line = F.when(is_head, F.array(doc_reason(F.col("doc_score"))))
            own = F.concat(own, F.coalesce(line, F.array().cast("array<string>")))
        return own.alias(dimension)

    kept = [f for f in lists.schema["raw"].dataType.elementType.fieldNames() if f not in ("reason", "penalty")]
    plain = F.transform(raw, lambda f: F.struct(*[f[c].alias(c) for c in kept]))
    weight_map = F.create_map(*[x for d, w in weights.items() for x in (F.lit(d), F.lit(float(w)))])
    counts = F.struct(*[F.col(s) for s in K.SEVERITIES])
    ratings = F.struct(
        *[F.col(c) for c in ("overall", *K.DIMENSIONS)],
        weight_map.alias("weights"),
        F.struct(*[reasons(c, d) for c, d in K.CATEGORY_DIMENSIONS.items()]).alias("reasons"),
    )
    return whole.select(
        "repo_id",
        "part",
        F.when(is_head, F.struct(F.col("repo_id").alias("name"), F.col("technologies").alias("detected_technologies"))).alias("project"),
        F.when(is_head, F.struct("files_scanned", "source_files", "total_lines", counts.alias("finding_counts"))).alias("summary"),
        ratings.alias("scores"),
        F.coalesce("manifests", F.array().cast(head.schema["manifests"].dataType)).alias("dependencies"),
        F.col("code"),
        F.col("largest_files"),
        F.col("extension_distribution"),
        F.col("duplicate_groups"),
        plain.alias("findings"),
        F.col("advice").alias("recommendations"),
        F.col("errors"),
    )
