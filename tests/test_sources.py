import os
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.operators import files as ops
from corpaudit.operators.findings import error_limit
from corpaudit.sources import packed, repo_dirs
from corpaudit.sources.repo_dirs import list_repo_dirs
from corpaudit.sources import read_errors, read_files, read_repo_dirs, size_gate_drop, write_files
from registry import bindings
from tests.helpers import column, corpus


def build(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_directory_source(spark, tmp_path):
    a, b = tmp_path / "one", tmp_path / "two"
    build(a, {"a.py": "x", ".env": "k", "src/deep/__init__.py": "", "node_modules/p.js": "n", ".git/HEAD": "h"})
    build(b, {"b.txt": "y"})
    os.symlink("nowhere", a / "dangling")
    os.symlink(a / "src", a / "loop")
    (b / "tests").mkdir()
    rows = {(r.repo_id, r.path): r for r in read_repo_dirs(spark, [str(a), str(b)]).collect()}
    kinds = {k: r.kind for k, r in rows.items()}
    assert kinds == {
        ("one", "a.py"): "file", ("one", ".env"): "file", ("one", "src"): "dir", ("one", "src/deep"): "dir",
        ("one", "src/deep/__init__.py"): "file", ("one", "node_modules"): "dir", ("one", ".git"): "dir",
        ("one", "dangling"): "file", ("one", "loop"): "dir", ("two", "b.txt"): "file", ("two", "tests"): "dir",
    }
    assert bytes(rows["one", "a.py"].content) == b"x"
    assert rows["one", "dangling"].error == "broken symlink"
    assert rows["one", "dangling"].unreadable


def test_directory_source_options(spark, tmp_path):
    build(tmp_path / "r", {"keep.py": "1", ".hidden": "2", "skip/x.py": "3", "big.txt": "z" * 2000})
    raw = read_repo_dirs(
        spark, [str(tmp_path / "r")], ignored_dirs=["skip"], include_hidden=False, max_file_size_mb=0.001
    )
    rows = {r.path: r for r in raw.collect() if r.kind == "file"}
    assert set(rows) == {"keep.py", "big.txt"}
    assert rows["big.txt"].content is None and rows["big.txt"].size == 2000


def test_missing_root_is_an_error_row(spark, tmp_path):
    raw = read_repo_dirs(spark, [str(tmp_path / "absent")])
    assert column(read_errors(corpus_of(raw)), "path") == ["."]


def corpus_of(raw):
    from corpaudit.sources import file_records

    return file_records(raw)


def test_flags(spark):
    files = corpus(spark, {"a.py": "x", "b.PNG": "text", "c.dat": b"\x00\x01", "late.txt": b"a" * 8192 + b"\x00"})
    flags = {r.path: (r.extension, r.is_binary, r.is_source) for r in files.collect()}
    assert flags == {
        "a.py": (".py", False, True), "b.PNG": (".png", True, False), "c.dat": (".dat", True, False),
        "late.txt": (".txt", False, False),
    }


def test_oversized_counts_as_binary_or_is_dropped(spark):
    contents = {"big.py": "x" * 2000, "small.py": "y"}
    files = corpus(spark, contents, max_file_size_mb=0.001)
    assert {r.path: r.is_binary for r in files.collect()} == {"big.py": True, "small.py": False}
    assert column(size_gate_drop(files, max_file_size_mb=0.001), "path") == ["small.py"]


def test_filters(spark):
    files = corpus(spark, {
        "keep.py": "1", "a/build/x.py": "2", "build": "a file", "env/y.py": "3", ".x/z.py": "4", "m/.env": "5",
        "docs": None, "examples/e.py": "6",
    })
    assert set(column(ops.drop_ignored_dirs(ops.only_files(files)), "path")) == {
        "keep.py", "build", ".x/z.py", "m/.env", "examples/e.py"}
    assert set(column(ops.drop_hidden(files), "path")) == {
        "keep.py", "a/build/x.py", "build", "env/y.py", "docs", "examples/e.py"}
    custom = ops.scanned_files(files, ignored_dirs=["a"], include_hidden=False)
    assert set(column(custom, "path")) == {"keep.py", "build", "env/y.py", "examples/e.py"}
    assert "examples/e.py" not in column(ops.python_audit_files(files), "path")


def test_packed_round_trip_prunes_columns(spark, tmp_path):
    files = corpus(spark, {"a.py": "x", "b.md": "y"})
    write_files(files, str(tmp_path / "packed"))
    again = read_files(spark, str(tmp_path / "packed"))
    assert sorted(again.collect()) == sorted(files.collect())
    plan = ops.code_candidates(again).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert "PushedFilters" in plan


def test_error_limit(spark):
    errors = spark.createDataFrame([("r", f"p{i:02d}", "e") for i in range(15)], "repo_id string, path string, error string")
    assert sorted(column(error_limit(errors), "path")) == [f"p{i:02d}" for i in range(10)]


def test_roots_of_equal_name_stay_apart_and_large_manifests_are_read(spark, tmp_path):
    for parent in ("x", "y"):
        (tmp_path / parent / "app").mkdir(parents=True)
        (tmp_path / parent / "app" / "main.py").write_text(parent)
    (tmp_path / "x" / "app" / "go.mod").write_text("module a\n" + "// long\n" * 400)
    roots = [str(tmp_path / p / "app") for p in ("x", "y")]
    found = read_repo_dirs(spark, roots, max_file_size_mb=0.001).filter("kind = 'file'").collect()
    assert {(r.repo_id, r.path): r.content is not None for r in found} == {
        (roots[0], "main.py"): True, (roots[0], "go.mod"): True, (roots[1], "main.py"): True}
    named = read_repo_dirs(spark, {"a": roots[0], "b": roots[1]}).select("repo_id").distinct().collect()
    assert sorted(r.repo_id for r in named) == ["a", "b"]


def test_one_folder_of_one_repository_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repo_dirs, "READ_BYTES", 40_000)
    monkeypatch.setattr(repo_dirs, "FILE_BYTES", 100)
    monkeypatch.setattr(repo_dirs, "LISTED_DIRS", 2)
    files = {f"src/d{i % 7}/e{i % 3}/f{i}.py": "x" * (i * 20) for i in range(120)}
    build(tmp_path / "app", files)
    raw = read_repo_dirs(spark, {"app": str(tmp_path / "app")})
    rows = raw.withColumn("task", F.spark_partition_id()).filter("kind = 'file'").collect()
    assert {r.path: len(r.content) for r in rows} == {p: len(c) for p, c in files.items()}
    read = Counter()
    for r in rows:
        read[r.task] += r.size
    assert len(read) >= 4 and max(read.values()) <= 40_000 + 120 * 20


def test_roots_from_a_table_and_none(spark, tmp_path):
    build(tmp_path / "one", {"a/b/c.txt": "x"})
    roots = spark.createDataFrame([("r", str(tmp_path / "one")), ("gone", str(tmp_path / "two"))], "repo_id string, root string")
    listed = {(r.repo_id, r.path, r.kind) for r in list_repo_dirs(spark, roots).collect()}
    assert listed == {("r", "a", "dir"), ("r", "a/b", "dir"), ("r", "a/b/c.txt", "file"), ("gone", ".", "dir")}
    assert read_repo_dirs(spark, {}).count() == 0
    (tmp_path / "empty").mkdir()
    assert read_repo_dirs(spark, [str(tmp_path / "empty")]).count() == 0


def scanned_rows(frame):
    """Rows that the scan of an executed plan gave."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_few_repositories_read_few_row_groups(spark, tmp_path):
    rows = corpus(spark, {f"f{i}.txt": chr(65 + i) * 3000 for i in range(20)})
    many = reduce(DataFrame.union, [rows.withColumn("repo_id", F.lit(f"r{n:02d}")) for n in range(30)])
    write_files(many, str(tmp_path / "p"), file_bytes=60_000, group_bytes=50_000)
    wanted = spark.createDataFrame([("r07",), ("r21",), ("none",)], "repo_id string")
    some = read_files(spark, str(tmp_path / "p"), wanted)
    assert sorted({r.repo_id for r in some.collect()}) == ["r07", "r21"] and some.count() == 40
    assert read_files(spark, str(tmp_path / "p")).count() == 600
    assert scanned_rows(some.select("repo_id", "path")) <= 200
    assert len(os.listdir(tmp_path / "p")) > 25


def test_more_repositories_than_a_filter_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "FILTERED_REPOS", 1)
    write_files(corpus(spark, {"a": "x"}, "one").union(corpus(spark, {"b": "y"}, "two")), str(tmp_path / "p"))
    names = spark.createDataFrame([("two",), ("three",), ("two",)], "repo_id string")
    assert column(read_files(spark, str(tmp_path / "p"), names), "path") == ["b"]


def test_path_files_are_dealt_to_all_cores(spark, tmp_path):
    # a table of one row group is one split, and all that is made from it would be one task
    rows = spark.range(64).selectExpr("id AS p_partkey", "'blue ring' AS p_name", "cast(id % 50 AS int) AS p_size")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = bindings.path_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files.count() == 64


def test_parts_go_by_content_not_by_recorded_sizes(spark, tmp_path):
    files = corpus(spark, {f"f{i}.py": f"x = {i}" for i in range(8)}).withColumn("size", F.lit(packed.FILE_BYTES))
    write_files(files, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == 1
    assert sorted(column(read_files(spark, str(tmp_path / "packed")), "path")) == [f"f{i}.py" for i in range(8)]
