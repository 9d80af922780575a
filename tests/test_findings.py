import random

import pytest
from pyspark.sql import functions as F

from corpaudit.operators import diff, findings, imports, scoring, skew
from tests.helpers import column, repos


def table(spark, rows, repo="r"):
    """(id, severity, category, path, line, title, recommendation) rows."""
    frame = spark.createDataFrame(
        [(repo, *r) for r in rows],
        "repo_id string, id string, severity string, category string, path string, line int, title string, advice string",
    )
    return findings.finding_rows(
        frame.withColumnRenamed("advice", "recommendation"),
        id=F.col("id"), severity=F.col("severity"), category="x", title=F.col("title"), path=F.col("path"),
        line=F.col("line"), recommendation=F.col("recommendation"),
    ).drop("category").join(frame.select("id", "category"), "id")


def one(id, severity, category="Security", path="p", line=1, title=None, advice="do"):
    return id, severity, category, path, line, title or id, advice


def test_order(spark):
    rows = [one("c", "LOW"), one("b", "HIGH", path="q"), one("a", "HIGH", line=None), one("d", "CRITICAL"),
            one("e", "HIGH", category="Hygiene", path="z")]
    assert column(findings.sorted_findings(table(spark, rows)), "id") == ["d", "e", "a", "b", "c"]


def test_counts_are_zero_filled(spark):
    rows = {r.repo_id: r for r in findings.finding_counts(table(spark, [one("a", "LOW")]), repos(spark, "r", "s")).collect()}
    assert tuple(rows["r"])[1:] == (0, 0, 0, 1, 0)
    assert tuple(rows["s"])[1:] == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("fail_on, expected", [("high", "FAIL"), ("critical", "PASS"), (None, "FAIL")])
def test_gate(spark, fail_on, expected):
    gates = findings.quality_gate(table(spark, [one("a", "HIGH")]), repos(spark, "r", "clean"), fail_on=fail_on)
    assert {r.repo_id: r.gate for r in gates.collect()} == {"r": expected, "clean": "PASS"}


def test_recommendations(spark):
    rows = [one(f"f{i:02d}", "LOW", title=f"t{i // 2}", advice=f"a{i}") for i in range(30)]
    rows += [one("mute", "CRITICAL", title="silent", advice=""), one("later", "LOW", title="silent", advice="never"),
             one("info", "INFO", advice="nor this")]
    found = findings.recommendations(table(spark, rows), repos(spark, "r", "none")).orderBy("repo_id", "position").collect()
    assert [r.recommendation for r in found] == [findings.ALL_CLEAR] + [f"a{i}" for i in range(0, 16, 2)]


def test_fix_plan(spark):
    plan = findings.fix_plan(table(spark, [one("a", "LOW", path="", line=None, advice=""), one("b", "HIGH")]))
    assert [(r.step, r.id, r.location, r.action) for r in plan.orderBy("step").collect()] == [
        (1, "b", "p:1", "do"), (2, "a", "Repository-wide", findings.DEFAULT_ACTION)]


# --- scores -------------------------------------------------------------------

def score(spark, rows, doc=100, **options):
    docs = spark.createDataFrame([("r", doc)], "repo_id string, doc_score int")
    return scoring.scores(table(spark, rows), repos(spark), docs, **options).first()


@pytest.mark.parametrize("rows, security", [
    ([], 100), ([one("a", "CRITICAL")], 75), ([one(str(i), "CRITICAL") for i in range(10)], 0), ([one("a", "INFO")], 100),
    ([one("a", "LOW", category="Elsewhere")], 100),
])
def test_security_score(spark, rows, security):
    assert score(spark, rows).security == security


def test_documentation_takes_the_lower(spark):
    assert score(spark, [], doc=40).documentation == 40
    assert score(spark, [one("a", "HIGH", category="Documentation")], doc=95).documentation == 88


def test_overall_is_exact_and_rounds_to_even(spark):
    dims = spark.createDataFrame(
        [("a", 97, 89, 98, 0, 57), ("b", 100, 100, 100, 100, 100), ("c", 1, 1, 1, 1, 0)],
        "repo_id string, security int, dependencies int, code_health int, documentation int, hygiene int",
    )
    got = {r.repo_id: r.overall for r in scoring.overall_score(dims).collect()}
    assert got == {"a": 76, "b": 100, "c": 1}  # 75.5, 100, 0.85
    half = scoring.overall_score(dims, weights={"security": "0.5"})
    assert {r.repo_id: r.overall for r in half.collect()} == {"a": 48, "b": 50, "c": 0}  # 48.5, 50, 0.5
    assert half.columns == ["repo_id", "overall", "security"]


def test_reasons(spark):
    docs = spark.createDataFrame([("r", 40)], "repo_id string, doc_score int")
    rows = scoring.score_reasons(table(spark, [one("a", "HIGH", title="T"), one("b", "INFO")]), docs).collect()
    assert sorted((r.dimension, r.reason) for r in rows) == [
        ("documentation", "README score: 40/100"), ("security", "-12 for HIGH finding [a] T")]


# --- numbering ----------------------------------------------------------------

def test_groups_are_numbered_in_order(spark):
    draw = random.Random(7)
    rows = [("hot", draw.randrange(300), i) for i in range(6000)] + [(f"k{i % 50}", i, i) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, a int, b int").repartition(7)
    got = sorted(tuple(r) for r in skew.numbered(frame, ["k"], [F.col("a"), F.col("b")], "n").collect())
    want = []
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        want += [(*r, i + 1) for i, r in enumerate(own)]
    assert got == sorted(want)


def test_a_hot_group_is_spread_over_tasks(spark):
    frame = spark.range(200_000).select(F.lit("hot").alias("k"), "id")
    numbered = skew.numbered(frame, ["k"], [F.col("id")], "n")
    assert numbered.filter("n <> id + 1").count() == 0


# --- runs ---------------------------------------------------------------------

def test_diff_treats_missing_lines_as_equal(spark):
    a = table(spark, [one("a", "LOW", line=None), one("b", "LOW")])
    b = table(spark, [one("a", "LOW", line=None), one("b", "LOW", line=2)])
    rows = sorted((r.only_in, r.id, r.line) for r in diff.scan_diff(a, b).collect())
    assert rows == [("a", "b", 1), ("b", "b", 2)]
    assert diff.run_difference(a, b).count() == 0


def test_checksum_ignores_order_and_sees_changes(spark):
    rows = [one(f"f{i}", "LOW", line=i) for i in range(50)]
    a = table(spark, rows)
    b = table(spark, rows[::-1]).repartition(9)
    assert diff.repeatable(a, b).first().repeatable is True
    assert diff.repeatable(a, table(spark, rows[1:])).first().repeatable is False


def test_score_diff(spark):
    def frame(*rows):
        return spark.createDataFrame(rows, "repo_id string, overall int")

    rows = diff.score_diff(frame(("a", 1), ("b", 2), ("c", 3)), frame(("a", 1), ("b", 5), ("d", 3))).collect()
    assert sorted(r.repo_id for r in rows) == ["b", "c", "d"]


# --- imports ------------------------------------------------------------------

def test_audit_verdicts(spark):
    used = spark.createDataFrame(
        [("ok", "a.py", "os"), ("ok", "b.py", "os"), ("ok", "a.py", "mine"), ("third", "a.py", "typing_extensions"),
         ("odd", "a.py", "requests"), ("odd", "a.py", "typing_extensions")],
        "repo_id string, path string, module string",
    )
    modules = imports.module_classes(spark, ["mine"])
    classes = imports.import_classes(used, modules)
    census = imports.import_census(classes, repos(spark, "ok", "third", "odd", "none"))
    assert {r.repo_id: r.verdict for r in census.collect()} == {
        "ok": "PASS", "third": "FAIL", "odd": "NEEDS REVIEW", "none": "PASS"}
    assert {(r.repo_id, r.module): r.files for r in classes.collect()}["ok", "os"] == 2
    assert sorted(column(imports.unknown_modules(used, modules), "module")) == [
        "requests", "typing_extensions", "typing_extensions"]


@pytest.mark.parametrize("module", ["pyarrow", "duckdb", "xxhash", "hypothesis"])
def test_installed_packages_need_review(spark, module):
    assert module not in imports.stdlib_modules()
    used = spark.createDataFrame([("r", "a.py", module)], "repo_id string, path string, module string")
    found = imports.import_classes(used, imports.module_classes(spark, ["mine"])).first()
    assert getattr(found, "class") == "needs_review"
