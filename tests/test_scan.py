import json
import os

import pytest

from corpaudit.operators import findings, reports
from corpaudit.plans.scan import ScanOptions, import_audit, scan, scan_compact, verify_repeatable
from corpaudit.storage import stored, work_folder
from tests.helpers import corpus, repos

STRIPE = "sk_" + "live_" + "0123456789abcdefghij"
URL = "postgresql:" + "//admin:letmein123@db.example/x"
APP = f'import os\n# TODO tidy\nAPI_KEY = "{STRIPE}"\ndef f():\n    u = "{URL}"\n    return u\nclass A:\n    pass\n'
DEMO = {
    "README.md": "# Demo\n\nA small demo.\n", "requirements.txt": "flask==2\nrequests\nrequests\n",
    "src": None, "src/app.py": APP, "src/copy.py": APP, "src/broken.py": "x = 1\ndef f(:\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    both = corpus(spark, DEMO, "demo").unionByName(corpus(spark, {"node_modules/x.js": "y"}, "bare"))
    return scan(both, repos(spark, "demo", "bare", "empty"))


def test_findings(tables):
    rows = {(r.id.rsplit("-", 1)[0] if r.id[-1].isdigit() else r.id, r.severity, r.path, r.line)
            for r in tables.findings.filter("repo_id = 'demo'").collect()}
    assert rows == {
        ("SEC-STRIPE-KEY", "HIGH", "src/app.py", 3), ("SEC-STRIPE-KEY", "HIGH", "src/copy.py", 3),
        ("SEC-GENERIC-ASSIGN", "MEDIUM", "src/app.py", 3), ("SEC-GENERIC-ASSIGN", "MEDIUM", "src/copy.py", 3),
        ("SEC-DB-CONN", "HIGH", "src/app.py", 5), ("SEC-DB-CONN", "HIGH", "src/copy.py", 5),
        ("CODE-SYNTAX", "MEDIUM", "src/broken.py", 2), ("DEP-DUP-python", "LOW", "requirements.txt", None),
        ("DEP-NOLOCK-python", "INFO", "requirements.txt", None), ("DOC", "MEDIUM", "README.md", None),
        ("DOC", "LOW", "README.md", None), ("HYG", "LOW", "", None), ("HYG", "MEDIUM", "", None),
        ("HYG-GIT", "LOW", "", None), ("HYG-DUP", "LOW", "src/app.py", None),
    }


def test_scores(tables):
    rows = {r.repo_id: r for r in tables.scores.collect()}
    demo = rows["demo"]
    assert (demo.security, demo.dependencies, demo.code_health, demo.documentation, demo.hygiene) == (40, 98, 94, 6, 84)
    assert demo.overall == 64
    # four missing things, tests, git; documentation has no README
    assert rows["empty"].hygiene == 80 and rows["empty"].documentation == 0
    assert rows["bare"] [1:] == rows["empty"][1:]


def test_summary_has_every_repository(tables):
    rows = {r.repo_id: r for r in tables.summary.collect()}
    assert set(rows) == {"demo", "bare", "empty"}
    assert (rows["demo"].files_scanned, rows["demo"].source_files, rows["bare"].files_scanned) == (5, 5, 0)
    for row in rows.values():
        assert all(0 <= row[d] <= 100 for d in ("overall", "security", "hygiene"))
        assert all(row[s] is not None for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))


def test_features_carry_no_content_and_no_value(tables):
    assert "content" not in tables.features.columns
    for row in tables.features.select("hits").collect():
        assert STRIPE not in str(row) and URL not in str(row)


def test_technologies_and_stats(tables):
    found = {r.repo_id: r.technologies for r in tables.technologies.collect()}
    assert found == {"demo": ["Python"], "bare": ["Unknown / Generic"], "empty": ["Unknown / Generic"]}
    stats = {r.repo_id: r for r in tables.code_stats.collect()}["demo"]
    assert (stats.functions, stats.classes, stats.imports, stats.syntax_errors, stats.todo) == (2, 2, 2, 1, 2)


def test_switches(spark):
    found = scan(corpus(spark, DEMO, "demo"), options=ScanOptions(enable_secrets=False, enable_dependencies=False)).findings
    assert not [r.id for r in found.collect() if r.id.startswith(("SEC", "DEP"))]


def test_report_parts_lose_nothing(spark, tables, tmp_path):
    whole = {r.repo_id: r for r in tables.report().collect()}
    assert set(whole) == {"demo", "bare", "empty"}
    reports.write_json(tables.report(part_rows=4), str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    demo = sorted((d for d in lines if d["repo_id"] == "demo"), key=lambda d: d["part"])
    assert len(demo) > 2 and all(len(d["findings"]) <= 4 for d in demo)
    ids = [f["id"] for d in demo for f in d["findings"]]
    assert ids == [f["id"] for f in whole["demo"].findings]
    order = [r.id for r in findings.sorted_findings(tables.findings.filter("repo_id = 'demo'")).collect()]
    assert ids == order
    head = demo[0]
    assert head["project"]["detected_technologies"] == ["Python"]
    assert head["scores"]["overall"] == 64 and head["scores"]["weights"]["security"] == 0.3
    assert [d["path"] for d in head["duplicate_groups"]] == ["src/app.py", "src/copy.py"]
    reasons = [x for d in demo for x in d["scores"]["reasons"]["documentation"]]
    assert len(reasons) == 3 and reasons.count("README score: 6/100") == 1


def test_csv(spark, tables, tmp_path):
    reports.write_csv(tables.findings, tables.summary, str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv" / "findings"))
    assert rows.columns == ["repo_id", "id", "severity", "category", "title", "path", "line", "explanation", "recommendation"]
    assert rows.count() == tables.findings.count()
    values = {(r.repo_id, r.name): r.value for r in reports.csv_summary(tables.summary).collect()}
    assert values["demo", "overall_score"] == 64 and values["empty", "total_lines"] == 0


def test_compact(spark):
    tables = scan_compact(corpus(spark, DEMO, "demo"))
    row = tables.scores.first()
    assert (row.security, row.code_health, row.hygiene, row.overall) == (40, 94, 90, 71)
    starred = [r.evidence for r in tables.findings.filter("id like 'SEC-STRIPE%'").collect()]
    assert all(STRIPE not in e for e in starred)
    assert sorted(r.member for r in tables.duplicates.collect()) == ["src/app.py", "src/copy.py"]


def test_import_audit(spark):
    files = {"a.py": "import os, mine.x\n", "examples/b.py": "import flask\n", "c.py": "import ("}
    row = import_audit(corpus(spark, files), first_party=["mine"]).first()
    assert (row.python_files, row.modules, row.stdlib, row.first_party, row.verdict) == (2, 2, 1, 1, "PASS")


def test_repeatable(spark):
    assert verify_repeatable(corpus(spark, DEMO, "demo")).first().repeatable is True


class _Session:
    """As much of a session as the choice of a folder looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_work_folder_is_the_clusters():
    assert work_folder(_Session("spark://host:7077", "/shared/x")) == "/shared/x"
    assert os.path.isdir(work_folder(_Session("local[2]")))
    with pytest.raises(ValueError):
        work_folder(_Session("spark://host:7077"))


def test_stored_tables_keep_their_schema(spark):
    table = spark.range(3).selectExpr("id", "array(named_struct('a', id)) AS nested")
    assert sorted(stored(table, "t").collect()) == sorted(table.collect())


def test_scan_agrees_with_its_operators(spark):
    from corpaudit.operators import dependencies, docs
    from corpaudit.schemas import RAW_FILES
    from corpaudit.sources import file_records

    twice = '{"dependencies": {"a": "1", "b": "2", "a": "3"}}'
    raw = spark.createDataFrame([
        ("r", "pyproject.toml", "file", 10, True, "denied", None), ("r", "README.md", "dir", 0, False, None, None),
        ("r", "package.json", "file", len(twice), False, None, twice.encode()), ("r", "locked", "dir", 0, True, "denied", None),
    ], RAW_FILES)
    files = file_records(raw)
    tables = scan(files)
    found = {r.id for r in tables.findings.collect()}
    assert "DEP-NOLOCK-python" not in found and "DEP-NOLOCK-node" in found
    assert {"DOC-001", "DOC-002"} <= found and "DOC-000" not in found
    alone = docs.readme_findings(docs.readme_scores(docs.readme_candidates(files), tables.repos))
    assert {r.id for r in alone.collect()} == {i for i in found if i.startswith("DOC-")}
    declared = dependencies.manifest_summary(dependencies.manifests(files), dependencies.lockfiles(files)).collect()
    assert [(r.manifest_file, r.runtime, r.duplicates) for r in declared] == [("package.json", ["a", "b"], [])]
    assert [r.path for r in tables.errors.collect()] == ["locked"]
