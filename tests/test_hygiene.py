import hashlib

import pytest
from pyspark.sql import functions as F

from corpaudit.operators import docs, hygiene
from corpaudit.operators import technologies as tech
from corpaudit.operators.files import scanned_files
from corpaudit.operators.folds import joined_sha256
from corpaudit.schemas import RAW_FILES
from corpaudit.sources import file_records
from tests.helpers import column, corpus, raw_rows, repos


def ids(found):
    return sorted(column(found, "id"))


def missing(spark, files):
    rows = corpus(spark, files)
    return ids(hygiene.presence_findings(hygiene.presence(rows, repos(spark))))


def test_empty_repository(spark):
    assert missing(spark, {}) == ["HYG-001", "HYG-002", "HYG-003", "HYG-004", "HYG-005", "HYG-GIT-000"]


def test_complete_repository(spark):
    files = {
        "README.rst": "", "COPYING": "", ".gitignore": "", ".github/workflows/ci.yml": "", "tests": None, ".git": None,
    }
    assert missing(spark, files) == []


@pytest.mark.parametrize("path, content, flag", [
    ("sub/README.md", "", "HYG-001"), ("license", "", "HYG-002"), ("tests", "a file", "HYG-005"),
    ("node_modules/test_x.js", "", "HYG-005"), ("docs/test.md", "", "HYG-005"), (".github/other.yml", "", "HYG-004"),
])
def test_what_does_not_count(spark, path, content, flag):
    assert flag in missing(spark, {path: content})


@pytest.mark.parametrize("path, flag", [
    ("src/my_Tests.py", "HYG-005"), ("test/x", "HYG-005"), ("Jenkinsfile", "HYG-004"), (".git/HEAD", "HYG-GIT-000"),
    (".circleci/config.yml", "HYG-004"),
])
def test_what_counts(spark, path, flag):
    assert flag not in missing(spark, {path: "x"})


def test_broken_symlink_is_reported_and_proves_nothing(spark):
    raw = spark.createDataFrame([("r", "README.md", "file", 0, True, "broken symlink", None)], RAW_FILES)
    found = hygiene.hygiene_findings(file_records(raw), repos(spark))
    assert "HYG-001" in ids(found) and any(i.startswith("HYG-SYMLINK-") for i in ids(found))


def test_risky_and_large(spark):
    rows = corpus(spark, {"a.KEY": "x", "b.sqlite3": "x", "c.py": "x", "dist/d.pem": "x"})
    found = {r.path: r.severity for r in hygiene.risky_findings(scanned_files(rows)).collect()}
    assert found == {"a.KEY": "HIGH", "b.sqlite3": "INFO"}
    raw = spark.createDataFrame([("r", "big.iso", "file", 6 * 1024**2, False, None, None)], RAW_FILES)
    large = hygiene.large_findings(file_records(raw)).first()
    assert large.path == "big.iso" and large.explanation.startswith("6.0MB")


def duplicates(spark, files, **options):
    digests = hygiene.with_digest(corpus(spark, files))
    return hygiene.duplicate_lists(digests, hygiene.duplicate_groups(digests), **options)


def test_duplicates(spark):
    row = duplicates(spark, {"b.py": "same", "a.py": "same", "c.py": "other", "d.py": "", "e.py": ""}).first()
    assert (row.copies, row.first_path, row.paths, row.reclaimable_bytes) == (2, "a.py", ["a.py", "b.py"], 4)
    digests = hygiene.with_digest(corpus(spark, {"b.py": "same", "a.py": "same"}))
    found = hygiene.duplicate_findings(digests, hygiene.duplicate_groups(digests)).first()
    expected = int(hashlib.sha256(b"a.py:b.py").hexdigest()[:8], 16) % 1000
    assert (found.id, found.path, found.severity) == (f"HYG-DUP-{expected:03d}", "a.py", "LOW")


def test_duplicate_scope(spark):
    rows = corpus(spark, {"a": "same", "b": "same"}, "x").unionByName(corpus(spark, {"c": "same"}, "y"))
    digests = hygiene.with_digest(rows)
    assert hygiene.duplicate_groups(digests, scope="corpus").first().copies == 3
    assert hygiene.duplicate_groups(digests).first().copies == 2


@pytest.mark.parametrize("copies", [1001, 5000])
def test_large_groups_are_listed_page_by_page(spark, copies):
    files = {f"h{i:05d}": "hot" for i in range(copies)} | {f"c{i}": "cold" for i in range(3)}
    digests = hygiene.with_digest(corpus(spark, files))
    groups = hygiene.duplicate_groups(digests)
    pages = hygiene.duplicate_lists(digests, groups).orderBy("copies", "page").collect()
    assert pages[0].paths == ["c0", "c1", "c2"]
    listed = [p for row in pages[1:] for p in row.paths]
    assert listed == sorted(f"h{i:05d}" for i in range(copies))
    assert all(len(row.paths) <= hygiene.PAGE_ROWS for row in pages)
    assert hygiene.duplicate_members(digests, groups).count() == copies + 3
    ids = {r.path: r.id for r in hygiene.duplicate_findings(digests, groups).collect()}
    for start, names in (("h00000", [f"h{i:05d}" for i in range(copies)]), ("c0", ["c0", "c1", "c2"])):
        hashed = hashlib.sha256(":".join(names).encode()).hexdigest()
        assert ids[start] == f"HYG-DUP-{int(hashed[:8], 16) % 1000:03d}"


def test_joined_digest_of_a_million_members(spark):
    members = [f"deep/folder/of/f{i:07d}.py" for i in range(1_000_000)]
    rows = spark.range(1_000_000).select(
        F.lit("r").alias("repo_id"), F.format_string("deep/folder/of/f%07d.py", "id").alias("member")
    ).unionByName(spark.createDataFrame([("r2", "b"), ("r2", "a"), ("r2", "a"), ("r3", None), ("r4", "")], "repo_id string, member string"))
    found = {r.repo_id: r.sha256 for r in joined_sha256(rows, ["repo_id"], "member", ":").collect()}
    expected = {"r": ":".join(members), "r2": "a:a:b", "r4": ""}
    assert found == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in expected.items()}


def test_joined_digest_of_nothing(spark):
    rows = spark.createDataFrame([], "repo_id string, member string")
    assert joined_sha256(rows, ["repo_id"], "member", ":").count() == 0


def detected(spark, files):
    return tech.technologies(corpus(spark, files), repos(spark)).first().technologies


@pytest.mark.parametrize("files, expected", [
    ({}, ["Unknown / Generic"]),
    ({"README.md": ""}, ["Unknown / Generic"]),
    ({"go.mod": "", "package.json": "", "setup.py": ""}, ["Python", "Node.js", "Go"]),
    ({"z/Cargo.toml": "", "a/tsconfig.json": "", "m/MAKEFILE": ""}, ["TypeScript", "C/C++", "Rust"]),
    ({"a.js": "", "b.jsx": ""}, ["JavaScript"]),
    ({"a.js": "", "b.js": "", "x/package.json": ""}, ["Node.js"]),
    ({"a.js": "", "b.js": "", "c.ts": "", "d.tsx": ""}, ["TypeScript"]),
    ({"a.c": "", "b.h": "", "c.java": "", "d.java": "", "e.rs": ""}, ["Java", "C/C++"]),
    ({"node_modules/package.json": ""}, ["Unknown / Generic"]),
    ({"a.py": "", "b.py": b"\x00"}, ["Unknown / Generic"]),
])
def test_technologies(spark, files, expected):
    assert detected(spark, files) == expected


def readme(spark, files):
    scores = docs.readme_scores(docs.readme_candidates(corpus(spark, files)), repos(spark))
    return scores.first(), ids(docs.readme_findings(scores))


def test_no_readme(spark):
    row, found = readme(spark, {"docs/README.md": "x"})
    assert (row.readme, row.doc_score, found) == (None, 0, ["DOC-000"])


def test_small_readme(spark):
    row, found = readme(spark, {"README.md": "# Demo\n\nA small demo.\n"})
    assert (row.sections, row.doc_score, found) == (["examples"], 6, ["DOC-001", "DOC-002"])


def test_good_readme_and_preference(spark):
    text = "Install. Usage. License. " + "é" * 3000
    row, found = readme(spark, {"README": "x", "README.txt": "y", "README.md": text})
    assert (row.readme, row.length_chars, row.doc_score, found) == ("README.md", len(text), 50 + 18, [])


def test_raw_helper_keeps_directories(spark):
    assert column(raw_rows(spark, {"d": None}), "kind") == ["dir"]
