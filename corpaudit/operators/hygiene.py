"""Presence checks, risky, large and broken files, duplicate content."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import content_sha256, digest_id, hashed_id, human_size, under_any_dir
from corpaudit.operators.files import duplicate_candidates, scanned_files
from corpaudit.operators.findings import all_findings, explode_reports, finding_rows, report_if
from corpaudit.operators.folds import joined_sha256
from corpaudit.operators.skew import numbered

# Paths in one page of a group's list.
PAGE_ROWS = 1000


def exists_at(names: Sequence[str]) -> Column:
    """A file or directory stands at one of the repo-relative paths.

    Directories show as their own rows or as prefixes of other paths.
    """
    path = F.col("path")
    broken = F.coalesce(F.col("error") == K.BROKEN_SYMLINK, F.lit(False))
    below = reduce(or_, [F.startswith(path, F.lit(f"{n}/")) for n in names])
    return (path.isin(*names) & ~broken) | below


def _is_dir(names: Sequence[str]) -> Column:
    path = F.col("path")
    below = reduce(or_, [F.startswith(path, F.lit(f"{n}/")) for n in names])
    return below | (path.isin(*names) & (F.col("kind") == "dir"))


def presence(
    files: DataFrame,
    repos: DataFrame,
    *,
    ignored_dirs: Sequence[str] = K.IGNORED_DIRS,
    license_names: Sequence[str] = K.LICENSE_NAMES,
    counts_as_test: Column | None = None,
) -> DataFrame:
    """What every repository has, in one partial aggregation over metadata.

    files: everything, before ignored directories are dropped. A test-like path
    only counts outside ignored directories and where counts_as_test holds, by
    default for source files.
    """
    testlike = F.contains(F.lower("path"), F.lit("test")) & (F.col("kind") == "file")
    scanned = ~under_any_dir(F.col("path"), sorted({*ignored_dirs, ".git"}))
    test_file = testlike & scanned & (F.col("is_source") if counts_as_test is None else counts_as_test)
    facts = {
        "has_readme": exists_at(K.README_NAMES),
        "has_license": exists_at(license_names),
        "has_gitignore": exists_at(K.GITIGNORE_NAMES),
        "has_ci": exists_at(K.CI_PATHS),
        "has_tests": _is_dir(K.TEST_DIRS) | test_file,
        "has_git": exists_at((".git",)),
    }
    found = files.groupBy("repo_id").agg(*[F.bool_or(c).alias(n) for n, c in facts.items()])
    known = [F.coalesce(F.col(n), F.lit(False)).alias(n) for n in facts]
    return repos.select("repo_id").join(found, "repo_id", "left").select("repo_id", *known)


# flag -> id, severity, title, explanation, recommendation
_MISSING = {
    "has_readme": (
        "HYG-001", "MEDIUM", "No README", "The root holds no README.",
        "Write a README: what it is, how to install and use it, its license.",
    ),
    "has_license": (
        "HYG-002", "LOW", "No license", "The root holds no license file.",
        "State the license in a file of its own.",
    ),
    "has_gitignore": (
        "HYG-003", "LOW", "No .gitignore", "Nothing keeps build output or secrets out of commits.",
        "Add a .gitignore that suits the project.",
    ),
    "has_ci": (
        "HYG-004", "LOW", "No continuous integration", "No known pipeline definition was found.",
        "Run the tests on every change.",
    ),
    "has_tests": (
        "HYG-005", "MEDIUM", "No tests", "Neither a test directory nor a test source was found.",
        "Add automated tests.",
    ),
    "has_git": (
        "HYG-GIT-000", "LOW", "Not under version control", "The root holds no .git.",
        "Put the project under version control.",
    ),
}
PRESENCE_CHECKS = tuple(_MISSING)
PRESENCE_CHECKS_COMPACT = ("has_readme", "has_license", "has_gitignore", "has_tests")


def presence_findings(facts: DataFrame, *, checks: Sequence[str] = PRESENCE_CHECKS) -> DataFrame:
    """One pass over the facts; each missing thing becomes a row."""
    names = ("id", "severity", "title", "explanation", "recommendation")
    reports = [
        report_if(~F.col(flag), path="", **dict(zip(names, _MISSING[flag]))) for flag in checks
    ]
    return explode_reports(facts, reports, "Hygiene")


def risky_extensions(spark) -> DataFrame:
    rows = [(e, severity, title) for e, (severity, title) in K.RISKY_EXTENSIONS.items()]
    return spark.createDataFrame(rows, "extension string, severity string, risk string")


def risky_findings(files: DataFrame) -> DataFrame:
    """files: scanned files. The twelve-row dimension is broadcast."""
    risky = files.join(F.broadcast(risky_extensions(files.sparkSession)), "extension")
    return finding_rows(
        risky,
        id=hashed_id("HYG-RISK-", F.col("path")),
        severity=F.col("severity"),
        category="Hygiene",
        title=F.col("risk"),
        path=F.col("path"),
        explanation=F.concat(F.lit("Extension "), F.col("extension"), F.lit(" suggests it.")),
        recommendation="Make sure the file belongs here and holds nothing sensitive.",
    )


def large_findings(files: DataFrame) -> DataFrame:
    large = files.filter(F.col("size") > K.LARGE_FILE_BYTES)
    return finding_rows(
        large,
        id=hashed_id("HYG-LARGE-", F.col("path")),
        severity="LOW",
        category="Hygiene",
        title="Large file in the tree",
        path=F.col("path"),
        explanation=F.concat(human_size(F.col("size")), F.lit(" is much for version control.")),
        recommendation="Store large files outside the repository.",
    )


def symlink_findings(files: DataFrame) -> DataFrame:
    broken = files.filter(F.col("unreadable") & F.contains(F.col("error"), F.lit(K.BROKEN_SYMLINK)))
    return finding_rows(
        broken,
        id=hashed_id("HYG-SYMLINK-", F.col("path")),
        severity="INFO",
        category="Hygiene",
        title="Dangling symlink",
        path=F.col("path"),
        explanation="The link leads to nothing.",
        recommendation="Point the link to something or remove it.",
    )


def hygiene_findings(files: DataFrame, repos: DataFrame, *, ignored_dirs: Sequence[str] = K.IGNORED_DIRS) -> DataFrame:
    """All hygiene checks that need no content. files: everything."""
    scanned = scanned_files(files, ignored_dirs=ignored_dirs)
    return all_findings([
        presence_findings(presence(files, repos, ignored_dirs=ignored_dirs)),
        risky_findings(scanned),
        large_findings(scanned),
        symlink_findings(scanned),
    ])


# --- duplicates ---------------------------------------------------------------

def with_digest(files: DataFrame, *, max_bytes: int | None = K.DUPLICATE_MAX_BYTES) -> DataFrame:
    """(repo_id, path, size, digest) of the files that can be copies.

    Content ends here: only digests go through the shuffles below.
    """
    return duplicate_candidates(files, max_bytes=max_bytes).select(
        "repo_id", "path", "size", content_sha256(F.col("content")).alias("digest")
    ).filter(F.col("digest").isNotNull())


def _scope(scope: str) -> list[str]:
    return {"repo": ["repo_id", "digest"], "corpus": ["digest"]}[scope]


def _member(scope: str) -> Column:
    path = F.col("path")
    return path if scope == "repo" else F.concat(F.col("repo_id"), F.lit("/"), path)


def duplicate_groups(digests: DataFrame, *, scope: str = "repo") -> DataFrame:
    """Groups of equal files: count, first path, bytes that copies take.

    Counts, minima and sizes combine before the shuffle, so a group that holds
    a third of the corpus sends a few rows per task.
    """
    keys = _scope(scope)
    return (
        digests.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(_member(scope)).alias("first_path"),
            F.first("size").alias("size"),
        )
        .filter(F.col("copies") > 1)
        .withColumn("reclaimable_bytes", F.col("size") * (F.col("copies") - 1))
        .drop("size")
    )


def duplicate_members(
    digests: DataFrame, groups: DataFrame, *, scope: str = "repo", carried: Sequence[str] = ()
) -> DataFrame:
    """Every file of every group, one row each, with the carried columns of the group."""
    keys = _scope(scope)
    rows = digests.select(*keys, _member(scope).alias("member"))
    return rows.join(groups.select(*keys, *carried), keys)


def duplicate_lists(
    digests: DataFrame, groups: DataFrame, *, scope: str = "repo", page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Groups with their sorted paths, in pages of at most page_rows, numbered from 0.

    Every group has this form, whatever its size; a small one is a single page.
    """
    keys = _scope(scope)
    members = numbered(duplicate_members(digests, groups, scope=scope), keys, [F.col("member")], "__n")
    page = F.floor((F.col("__n") - 1) / page_rows).cast("int").alias("page")
    lists = members.groupBy(*keys, page).agg(F.sort_array(F.collect_list("member")).alias("paths"))
    return groups.join(lists, keys)


def duplicate_findings(digests: DataFrame, groups: DataFrame) -> DataFrame:
    """One finding per group within a repository.

    The id hashes the group's sorted paths, joined by colons, for groups of every size.
    """
    keys = _scope("repo")
    joined = joined_sha256(duplicate_members(digests, groups), keys, "member", ":")
    return finding_rows(
        groups.join(joined, keys),
        id=digest_id("HYG-DUP-", F.col("sha256")),
        severity="LOW",
        category="Hygiene",
        title="Copies of one file",
        path=F.col("first_path"),
        explanation=F.concat(
            F.col("copies").cast("string"), F.lit(" files are equal, the first is "), F.col("first_path"),
            F.lit(". Copies take "), human_size(F.col("reclaimable_bytes")), F.lit("."),
        ),
        recommendation="Keep one copy and refer to it.",
    )
