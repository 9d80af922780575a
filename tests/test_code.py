from corpaudit.operators import code, python_code
from tests.helpers import column, corpus, repos


def test_line_counts(spark):
    files = corpus(spark, {"a.py": "x = 1\n\n# note\ny = 2\n", "b.md": "# heading\n", "c.bin": "x", "d.log": "x"})
    rows = {r.path: r for r in code.file_line_stats(files).collect()}
    assert set(rows) == {"a.py", "b.md"}
    a = rows["a.py"]
    assert (a.total_lines, a.blank_lines, a.comment_lines, a.code_lines) == (4, 1, 1, 2)
    assert rows["b.md"].comment_lines == 0


def test_markers_once_per_line(spark):
    files = corpus(spark, {"a.py": "# TODO todo\n# FixMe\n# xxxx\n"})
    row = code.file_line_stats(files).first()
    assert (row.todo, row.fixme, row.xxx) == (1, 1, 1)


def test_repository_sums_and_empty_repositories(spark):
    files = corpus(spark, {"a.py": "x\ny", "b.js": "// c", "e.txt": ""})
    stats = code.file_line_stats(files)
    python = python_code.python_metrics(files)
    rows = {r.repo_id: r for r in code.code_stats(stats, repos(spark, "r", "none"), python).collect()}
    assert (rows["r"].source_files, rows["r"].total_lines, rows["r"].comment_lines) == (3, 3, 1)
    assert (rows["none"].source_files, rows["none"].total_lines, rows["none"].functions) == (0, 0, 0)
    kinds = {r.extension: r.files for r in code.extension_distribution(stats).collect()}
    assert kinds == {".py": 1, ".js": 1, ".txt": 1}


def test_largest_files_order(spark):
    files = corpus(spark, {f"f{i:02d}.txt": "x" * (i // 2) for i in range(14)})
    rows = code.largest_files(code.file_line_stats(files)).orderBy("position").collect()
    assert [r.path for r in rows][:4] == ["f12.txt", "f13.txt", "f10.txt", "f11.txt"]
    assert len(rows) == 10


def test_long_lines_need_more_than_twenty(spark):
    line = "x" * 201 + "\n"
    files = corpus(spark, {"ok.txt": line * 20, "bad.txt": line * 21, "edge.txt": ("y" * 200 + "\n") * 30})
    found = code.long_line_findings(code.file_line_stats(files))
    assert column(found, "path") == ["bad.txt"]


def test_python_facts(spark):
    text = "import os.path, sys\nfrom a.b import c\nfrom . import d\nclass K:\n  def f(self): pass\nasync def g(): pass\n"
    row = python_code.python_metrics(corpus(spark, {"a.py": text})).first()
    assert (row.functions, row.classes, row.imports) == (2, 1, 3)
    assert row.modules == ["a", "os", "sys"]
    assert row.syntax_error is None


def test_syntax_error_is_a_row(spark):
    files = corpus(spark, {"bad.py": "ok = 1\ndef f(:\n", "good.py": "x = 1"})
    metrics = python_code.python_metrics(files)
    found = python_code.syntax_findings(metrics).collect()
    assert [(f.path, f.line, f.severity, f.category) for f in found] == [("bad.py", 2, "MEDIUM", "Code Health")]


def test_code_is_not_run(spark, tmp_path):
    marker = tmp_path / "ran"
    files = corpus(spark, {"evil.py": f"open({str(marker)!r}, 'w').write('x')\n"})
    python_code.python_metrics(files).collect()
    assert not marker.exists()


def test_hopeless_code_does_not_fail_the_job(spark):
    deep = "x = " + "(" * 5000 + "1" + ")" * 5000
    files = corpus(spark, {"deep.py": deep, "minus.py": "z = " + "-" * 3000 + "1", "nest.py": "z = " + "-" * 20 + "1"})
    rows = {r.path: r for r in python_code.python_metrics(files).collect()}
    assert rows["deep.py"].syntax_error is not None
    assert rows["nest.py"].max_depth > 14
    assert "nest.py" in column(python_code.nesting_findings(python_code.python_metrics(files)), "path")


def test_a_file_is_parsed_once(spark):
    found = python_code.syntax_findings(python_code.python_metrics(corpus(spark, {"a.py": "x"})))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_partitioning_does_not_matter(spark):
    files = corpus(spark, {f"d{i}/a.py": f"# c\nx = {i}\n" for i in range(20)})
    one = code.file_line_stats(files.repartition(1)).orderBy("path").collect()
    many = code.file_line_stats(files.repartition(16)).orderBy("path").collect()
    assert one == many and len(one) == 20


def test_python_findings_parse_a_file_once(spark, tmp_path):
    from registry.catalog import QUERIES
    import registry.code_queries  # noqa: F401

    orders = spark.range(100).selectExpr("id as o_orderkey", "id as o_custkey")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["python_findings"](spark, str(tmp_path))
    # both checks read the stored facts
    assert "EvalPython" not in found._jdf.queryExecution().toString()
    assert sorted(r.path for r in found.collect()) == ["examples/o0.py", "examples/o40.py", "examples/o50.py", "examples/o80.py"]


def test_narrow_rows_get_tasks_by_their_number(spark, monkeypatch):
    from registry import bindings

    monkeypatch.setattr(bindings, "ROWS_PER_TASK", 10)
    spread = bindings.spread_out(spark.range(100).coalesce(1))
    assert spread.rdd.getNumPartitions() == 11 and spread.count() == 100
