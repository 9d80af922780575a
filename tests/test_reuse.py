import uuid
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpaudit.plans import reuse
from corpaudit.plans.reuse import KEY, FeatureStore, features_once
from corpaudit.plans.scan import ScanOptions, features_of, file_features, options_key, scan, scan_compact
from corpaudit.storage import work_folder
from tests.helpers import corpus, raw_rows
from tests.test_scan import DEMO

MIXED = {
    **DEMO, "vendor/x.py": "import os\n", "node_modules/y.js": "z", "big.bin": b"\x00\x01", "empty.py": "", "pyproject.toml": "[project]\n",
    "README.rst": "also a readme", "docs/README.md": "# Demo\n\nA small demo.\n", "notes.md": "# Demo\n\nA small demo.\n",
    "lib/requirements.txt": "flask==2\nrequests\nrequests\n", ".env": "X=1", "a.txt": "x = 1\ndef f(:\n",
}


@pytest.fixture
def store(spark):
    return FeatureStore(spark, f"{work_folder(spark)}/{uuid.uuid4().hex}/store")


def rows(frame):
    return sorted(map(repr, frame.collect()))


def size(store, options=ScanOptions()):
    return store.size(options_key(options))


def both(spark):
    return corpus(spark, MIXED, "one").unionByName(corpus(spark, MIXED, "two"))


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_features_are_those_of_a_plain_scan(spark, store, monkeypatch, limit):
    # by a shuffle and by a broadcast of names
    monkeypatch.setattr(reuse, "BROADCAST_BYTES", limit)
    files = both(spark)
    plain = file_features(files)
    for _ in range(2):
        kept = features_of(files, store=store)
        assert kept.columns == plain.columns and rows(kept) == rows(plain)


def test_findings_are_those_of_a_plain_scan(spark, store):
    files = both(spark)
    assert rows(scan(files, feature_store=store).findings) == rows(scan(files).findings)
    assert rows(scan_compact(files, feature_store=store).findings) == rows(scan_compact(files).findings)


def test_equal_content_is_examined_once(spark, store):
    one = corpus(spark, {f"f{i}.py": f"x = {i}" for i in range(10)}, "one")
    features_of(one, store=store).count()
    assert size(store) == 10
    copies = one.withColumn("repo_id", F.lit("two")).withColumn("path", F.concat(F.lit("vendor2/"), "path"))
    new = corpus(spark, {"g.py": "y", "h.py": "y", "f3.py": "x = 3"}, "three")
    assert features_of(one.unionByName(copies).unionByName(new), store=store).count() == 23
    assert size(store) == 11
    # another language, an ignored folder, a manifest: the same bytes with other features
    features_of(corpus(spark, {"f.js": "y", "dist/g.py": "y", "go.mod": "y"}), store=store).count()
    assert size(store) == 14


def test_options_have_features_of_their_own(spark, store):
    files = corpus(spark, DEMO)
    features_of(files, store=store).count()
    other = replace(ScanOptions(), min_stars=0)
    assert size(store) > 0 and size(store, other) == 0
    assert rows(features_of(files, other, store)) == rows(file_features(files, other))


def test_repeated_paths_and_rows_added_twice(spark, store):
    raw = raw_rows(spark, {"a.py": "x"}).unionByName(raw_rows(spark, {"a.py": "y"})).unionByName(raw_rows(spark, {"a.py": "y"}))
    from corpaudit.sources import file_records

    files = file_records(raw)
    assert rows(features_of(files, store=store)) == rows(file_features(files))
    store.add(store.read(options_key(ScanOptions())), options_key(ScanOptions()))
    assert size(store) == 2 and rows(features_of(files, store=store)) == rows(file_features(files))


def test_nothing(spark, store):
    files = corpus(spark, DEMO).filter("false")
    assert features_of(files, store=store).count() == 0
    assert features_of(files, store=store).columns == file_features(files).columns


def test_content_that_is_gone_ends_the_scan(spark, store):
    files = corpus(spark, {"a.py": "x", "b.py": "y"})
    from corpaudit.plans.scan import CONTENT_FEATURES

    key = F.sha2("content", 256)
    with pytest.raises(PySparkException, match="changed while"):
        reuse.features_once(
            files, files.drop("content").withColumn(reuse.KEY, F.lit("other")), key,
            lambda found: file_features(found, carried=[reuse.KEY]), CONTENT_FEATURES, store, "o",
        ).collect()


def test_only_files_to_examine_are_hashed_a_second_time(spark, tmp_path):
    files = spark.range(20).selectExpr("'r' AS repo_id", "'f' || id AS path", "cast('text ' || id % 4 AS binary) AS content")
    hashed = spark.sparkContext.accumulator(0)

    def counted(content):
        hashed.add(1)
        return bytes(content).decode()

    key = F.udf(counted, "string").asNondeterministic()(F.col("content"))
    metadata = files.select("repo_id", "path", F.col("content").cast("string").alias(KEY))
    told = features_once(
        files, metadata, key, lambda rows: rows.withColumn("n", F.length("content")), ["n"],
        FeatureStore(spark, str(tmp_path / "store")), "o",
    )
    assert told.count() == 20 and told.filter("n = 6").count() == 20
    assert hashed.value == 4


def test_lookup_leaves_the_store_alone_on_disk(spark, monkeypatch, tmp_path):
    from corpaudit import storage

    monkeypatch.setattr(storage, "work_folder", lambda _: str(tmp_path / "work"))
    held = FeatureStore(spark, str(tmp_path / "store"))
    assert features_of(both(spark), store=held).count() == both(spark).count()
    assert [f for f in (tmp_path / "work").rglob("*") if f.is_file()] == []
    kept = held.read(options_key(ScanOptions()))
    assert {len(r[KEY]) for r in kept.select(KEY).collect()} == {32}


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_files_that_share_a_number(spark, store, monkeypatch, limit):
    monkeypatch.setattr(reuse, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(reuse, "_number", lambda: F.pmod(F.xxhash64("repo_id", "path"), F.lit(3)))
    files = both(spark)
    assert rows(features_of(files, store=store)) == rows(file_features(files))
    told = size(store)
    assert rows(features_of(files, store=store)) == rows(file_features(files)) and size(store) == told


def test_many_known_contents_are_not_sent_through_the_driver(spark, store, monkeypatch):
    files = both(spark)
    features_of(files, store=store).count()
    monkeypatch.setattr(reuse, "KNOWN_ROWS", 0)
    looked_up = features_of(files, store=store)
    assert looked_up.count() == files.count()
    assert "Broadcast" not in looked_up._jdf.queryExecution().executedPlan().toString()
