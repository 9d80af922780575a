"""End-to-end audits.

The corpus is read once. Everything that needs content is computed in that
pass and written as a narrow table of file features, without content; all
reports are queries over it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import content_sha256, decode_text, is_hidden, under_any_dir
from corpaudit.operators import (
    code, dependencies, diff, docs, findings, hygiene, imports, python_code,
    reports, scoring, secrets, technologies,
)
from corpaudit.operators.hygiene import exists_at
from corpaudit.operators.files import is_code_candidate, is_duplicate_candidate, python_audit_files
from corpaudit.plans.reuse import KEY, FeatureStore, content_key, features_once, options_id
from corpaudit.schemas import FILES
from corpaudit.sources.packed import file_records, read_errors
from corpaudit.storage import new_folder, stored


@dataclass(frozen=True)
class ScanOptions:
    """What to scan and how to judge it."""

    ignored_dirs: Sequence[str] = K.IGNORED_DIRS
    include_hidden: bool = True
    enable_secrets: bool = True
    enable_dependencies: bool = True
    rules: Sequence[secrets.SecretRule] = secrets.SECRET_RULES
    min_stars: int = 4
    prose_extensions: Sequence[str] = K.PROSE_EXTENSIONS
    duplicate_max_bytes: int | None = K.DUPLICATE_MAX_BYTES
    # None reads whole texts
    code_max_bytes: int | None = None
    secret_max_bytes: int | None = None
    weights: Mapping[str, str] = field(default_factory=lambda: dict(K.WEIGHTS))
    store: bool = True


@dataclass(frozen=True)
class ScanTables:
    """Results of a scan, each a DataFrame keyed by repo_id."""

    repos: DataFrame
    features: DataFrame
    findings: DataFrame
    scores: DataFrame
    doc_scores: DataFrame | None
    code_stats: DataFrame
    summary: DataFrame
    duplicates: DataFrame
    technologies: DataFrame | None = None
    manifests: DataFrame | None = None
    extensions: DataFrame | None = None
    largest: DataFrame | None = None
    recommendations: DataFrame | None = None
    errors: DataFrame | None = None

    def report(self, **options) -> DataFrame:
        """Nested documents, see reports.json_report."""
        return reports.json_report(
            repos=self.repos, summaries=self.summary, technologies=self.technologies,
            manifests=self.manifests, code_stats=self.code_stats, extensions=self.extensions,
            largest=self.largest, findings=self.findings, duplicate_members=self.duplicates,
            doc_scores=self.doc_scores, recommendations=self.recommendations, errors=self.errors,
            **options,
        )


@dataclass(frozen=True)
class _Marks:
    """What a file's name and metadata say about which features its content gets."""

    scanned: Column
    is_code: Column
    searched: Column
    is_manifest: Column
    is_readme: Column
    has_readme: Column
    copied: Column

    @staticmethod
    def of(options: ScanOptions) -> _Marks:
        path, is_file = F.col("path"), F.col("kind") == "file"
        scanned = is_file & ~under_any_dir(path, sorted({*options.ignored_dirs, ".git"}))
        if not options.include_hidden:
            scanned = scanned & ~is_hidden(path)
        return _Marks(
            scanned=scanned,
            is_code=scanned & is_code_candidate(options.prose_extensions),
            searched=scanned & ~F.col("is_binary") & ~F.col("unreadable"),
            is_manifest=is_file & path.isin(*dependencies.PARSERS),
            is_readme=is_file & path.isin(*K.README_NAMES),
            has_readme=exists_at(K.README_NAMES),
            copied=scanned & is_duplicate_candidate(options.duplicate_max_bytes),
        )

    def context(self) -> list[Column]:
        """All but content that the features depend on."""
        named = F.when(self.is_manifest | self.is_readme, F.col("path")).otherwise(F.lit(""))
        return [F.col("extension"), self.is_code, self.searched, self.copied, self.has_readme, _broken(), named]


# Columns of file_features that follow from content.
CONTENT_FEATURES = [*code.LINE_COUNTS, "digest", "hits", "manifest", "readme_facts", "facts"]


def file_features(files: DataFrame, options: ScanOptions = ScanOptions(), *, carried: Sequence[str] = ()) -> DataFrame:
    """One pass over the corpus: all that needs content, without the content.

    Rows outside the scan keep their metadata, as presence checks want them.
    """
    path, content = F.col("path"), F.col("content")
    marks = _Marks.of(options)
    unread_pyproject = (path == "pyproject.toml") & F.col("text").isNull()

    marked = files.withColumns({
        "scanned": marks.scanned,
        "is_code": marks.is_code,
        "text": F.when(marks.searched | marks.is_manifest | marks.is_readme, decode_text(content)),
    })
    text = F.col("text")

    def capped(limit: int | None):
        return text if limit is None else decode_text(content, limit)

    texts = marked.withColumns({
        "code_text": F.when(F.col("is_code"), capped(options.code_max_bytes)),
        "secret_text": F.when(marks.searched, capped(options.secret_max_bytes)),
    })
    counted = code.with_line_counts(texts, "code_text")

    hits = secrets.secret_hits(F.col("secret_text"), options.rules, min_stars=options.min_stars)
    if not options.enable_secrets:
        hits = F.slice(hits, 1, 0)
    manifest = F.struct(*[c.alias(n) for n, c in dependencies.manifest_facts(path, text).items()])
    # a directory or what stands below it also shows that there is a README, of no length
    readme = F.struct(*docs.readme_facts(F.when(marks.is_readme, text)))
    narrow = counted.select(
        *[c for c in FILES.fieldNames() if c != "content"],
        *carried,
        "scanned",
        "is_code",
        *code.LINE_COUNTS,
        F.when(marks.copied, content_sha256(content)).alias("digest"),
        hits.alias("hits"),
        F.when(marks.is_manifest & ~_broken() & ~unread_pyproject, manifest).alias("manifest"),
        F.when(marks.has_readme, readme).alias("readme_facts"),
        F.when(F.col("extension") == ".py", F.col("code_text")).alias("py_text"),
    )
    # The generator fences the projection above: without it the optimizer computes
    # the features after the parser, whose row queue would then hold all content.
    fenced = narrow.withColumn("py_text", F.explode_outer(F.array("py_text")))
    return fenced.withColumn("facts", python_code.metrics_of(F.col("py_text"))).drop("py_text")


def options_key(options: ScanOptions) -> str:
    """Names the options that decide how content is examined."""
    return options_id(
        tuple(options.rules), options.enable_secrets, options.min_stars, options.code_max_bytes, options.secret_max_bytes
    )


def features_of(files: DataFrame, options: ScanOptions = ScanOptions(), store: FeatureStore | None = None) -> DataFrame:
    """file_features, with content that the store knows looked up instead of examined."""
    if store is None:
        return file_features(files, options)
    marks = _Marks.of(options)
    key = content_key(F.col("content"), marks.context())
    metadata = files.select(
        *[c for c in FILES.fieldNames() if c != "content"],
        marks.scanned.alias("scanned"), marks.is_code.alias("is_code"), key.alias(KEY),
    )
    return features_once(
        files, metadata, key, lambda rows: file_features(rows, options, carried=[KEY]), CONTENT_FEATURES, store,
        options_key(options),
    )


def _broken():
    return F.coalesce(F.col("error") == K.BROKEN_SYMLINK, F.lit(False))


@dataclass(frozen=True)
class _Views:
    """Operator inputs, read from the feature table."""

    scanned: DataFrame
    file_stats: DataFrame
    python: DataFrame
    matches: DataFrame
    digests: DataFrame


def _views(features: DataFrame, options: ScanOptions) -> _Views:
    scanned = features.filter("scanned")
    parsed = features.filter(F.col("facts.functions").isNotNull())
    return _Views(
        scanned=scanned,
        file_stats=features.filter("is_code").select("repo_id", "path", "extension", "size", *code.LINE_COUNTS),
        python=parsed.select("repo_id", "path", "facts.*"),
        matches=secrets.explode_hits(features.filter(F.size("hits") > 0), options.rules),
        digests=features.filter(F.col("digest").isNotNull()).select("repo_id", "path", "size", "digest"),
    )


def _repos(files: DataFrame, repos: DataFrame | None) -> DataFrame:
    return files.select("repo_id").distinct() if repos is None else repos.select("repo_id")


def scan(
    files: DataFrame,
    repos: DataFrame | None = None,
    options: ScanOptions = ScanOptions(),
    *,
    feature_store: FeatureStore | None = None,
) -> ScanTables:
    """Audit every repository of a corpus (schema FILES, unfiltered).

    repos names repositories that may hold no file at all; by default the
    repositories are those of the files. With a feature store, only content that
    no earlier file had is examined; the results are the same.
    """
    features = features_of(files, options, feature_store)
    if options.store:
        features = stored(features, "features")
    repos = _repos(features, repos)
    views = _views(features, options)

    manifests = dependencies.manifest_summary(
        features.filter(F.col("manifest").isNotNull()).select(
            "repo_id", "manifest.ecosystem", F.col("path").alias("manifest_file"),
            "manifest.entries",
        ),
        dependencies.lockfiles(features),
    )
    candidates = features.filter(F.col("readme_facts").isNotNull()).select(
        "repo_id", F.substring_index("path", "/", 1).alias("readme"), "readme_facts.*"
    )
    doc_scores = docs.readme_scores(candidates, repos)
    groups = hygiene.duplicate_groups(views.digests)
    duplicates = hygiene.duplicate_members(views.digests, groups, carried=["first_path"])

    checks = [
        code.long_line_findings(views.file_stats),
        python_code.syntax_findings(views.python),
        python_code.nesting_findings(views.python),
        hygiene.hygiene_findings(features, repos, ignored_dirs=options.ignored_dirs),
        hygiene.duplicate_findings(views.digests, groups),
        docs.readme_findings(doc_scores),
    ]
    if options.enable_dependencies:
        checks.append(dependencies.dependency_findings(manifests))
    if options.enable_secrets:
        checks.append(secrets.secret_findings(views.matches, rules=options.rules))
        checks.append(secrets.env_file_findings(views.scanned))
    found = findings.all_findings(checks)
    if options.store:
        found = stored(found, "findings")

    rated = scoring.scores(found, repos, doc_scores, weights=options.weights)
    stats = code.code_stats(views.file_stats, repos, views.python)
    return ScanTables(
        repos=repos,
        features=features,
        findings=found,
        scores=rated,
        doc_scores=doc_scores,
        code_stats=stats,
        summary=reports.summary(repos, reports.file_counts(views.scanned), stats, found, rated),
        duplicates=duplicates,
        technologies=technologies.technologies(features, repos, ignored_dirs=options.ignored_dirs),
        manifests=manifests if options.enable_dependencies else manifests.limit(0),
        extensions=code.extension_distribution(views.file_stats),
        largest=code.largest_files(views.file_stats),
        recommendations=findings.recommendations(found, repos),
        errors=read_errors(features),
    )


COMPACT = ScanOptions(
    ignored_dirs=K.IGNORED_DIRS_COMPACT,
    enable_dependencies=False,
    min_stars=0,
    prose_extensions=K.PROSE_EXTENSIONS_COMPACT,
    duplicate_max_bytes=None,
    weights=K.WEIGHTS_COMPACT,
)


def scan_compact(
    files: DataFrame,
    repos: DataFrame | None = None,
    *,
    max_file_size_mb: float = K.MAX_FILE_SIZE_MB,
    options: ScanOptions = COMPACT,
    feature_store: FeatureStore | None = None,
) -> ScanTables:
    """The small audit: secrets, Python facts, four presence checks, three scores."""
    flagged = file_records(
        files,
        max_file_size_mb=max_file_size_mb,
        source_extensions=K.SOURCE_EXTENSIONS_COMPACT,
        binary_extensions=K.BINARY_EXTENSIONS_COMPACT,
    )
    repos = _repos(files, repos)
    # presence sees everything, the scan only what is small enough and readable
    within = F.col("size") <= int(max_file_size_mb * K.MEGABYTE)
    features = features_of(flagged, options, feature_store).withColumn(
        "scanned", F.col("scanned") & within & ~F.col("unreadable")
    )
    if options.store:
        features = stored(features, "features")
    views = _views(features, options)
    groups = hygiene.duplicate_groups(views.digests)
    duplicates = hygiene.duplicate_members(views.digests, groups, carried=["first_path"])
    facts = hygiene.presence(
        features, repos, ignored_dirs=options.ignored_dirs,
        license_names=K.LICENSE_NAMES_COMPACT, counts_as_test=F.col("scanned"),
    )
    found = findings.all_findings([
        secrets.secret_findings(views.matches, rules=options.rules),
        secrets.env_file_findings(views.scanned),
        python_code.syntax_findings(views.python),
        hygiene.presence_findings(facts, checks=hygiene.PRESENCE_CHECKS_COMPACT),
    ])
    if options.store:
        found = stored(found, "findings")
    rated = scoring.scores(found, repos, weights=options.weights)
    stats = code.code_stats(views.file_stats, repos, views.python)
    return ScanTables(
        repos=repos, features=features, findings=found, scores=rated, doc_scores=None,
        code_stats=stats, duplicates=duplicates,
        summary=reports.summary(repos, reports.file_counts(views.scanned), stats, found, rated),
    )


def import_audit(
    files: DataFrame,
    repos: DataFrame | None = None,
    *,
    first_party: Sequence[str] = (),
    excluded_dirs: Sequence[str] = K.IGNORED_DIRS_IMPORTS,
) -> DataFrame:
    """Per repository: Python files read, modules by class, verdict."""
    repos = _repos(files, repos)
    python = python_audit_files(files, excluded_dirs=excluded_dirs)
    texts = python.select("repo_id", "path", decode_text(F.col("content")).alias("text"))
    parsed = texts.withColumn("facts", python_code.metrics_of(F.col("text"))).select("repo_id", "path", "facts.*")
    used = python_code.python_imports(parsed)
    modules = imports.module_classes(files.sparkSession, first_party)
    census = imports.import_census(imports.import_classes(used, modules), repos)
    read = python.groupBy("repo_id").agg(F.count(F.lit(1)).alias("python_files"))
    return census.join(read, "repo_id", "left").withColumn(
        "python_files", F.coalesce("python_files", F.lit(0))
    )


@contextmanager
def other_schedule(spark: SparkSession) -> Iterator[None]:
    """Tasks cut otherwise while this is open: other splits of files, another number of shuffle partitions."""
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings = {
        "spark.sql.shuffle.partitions": str(2 * shuffles + 1),
        "spark.sql.files.maxPartitionBytes": "16m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "777",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _two_scans(files: DataFrame, repos: DataFrame | None, options: ScanOptions, reorder: bool) -> tuple[DataFrame, DataFrame]:
    if not options.store:
        raise ValueError("a scan that stores nothing runs later, under the schedule of that time")
    first = scan(files, repos, options).findings
    with other_schedule(files.sparkSession):
        again = files.repartition(F.reverse("path")).sortWithinPartitions(F.desc("path")) if reorder else files
        return first, scan(again, repos, options).findings


def verify_repeatable(
    files: DataFrame, repos: DataFrame | None = None, options: ScanOptions = ScanOptions(), *, reorder: bool = False
) -> DataFrame:
    """Scan twice, the second time under another schedule; per repository, whether both found the same.

    reorder also deals the files anew for the second scan, which shuffles the content once.
    """
    return diff.repeatable(*_two_scans(files, repos, options, reorder))


def repeat_differences(
    files: DataFrame, repos: DataFrame | None = None, options: ScanOptions = ScanOptions(), *, reorder: bool = False
) -> DataFrame:
    """The findings that a second scan under another schedule has more or less often than the first."""
    spark = files.sparkSession
    kept = [diff.KeptRun.write(run, new_folder(spark, "run")) for run in _two_scans(files, repos, options, reorder)]
    return diff.differing_rows(*kept)
