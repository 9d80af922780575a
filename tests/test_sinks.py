import uuid

import pytest

from corpaudit.plans import live
from corpaudit.plans.reuse import FeatureStore
from corpaudit.plans.scan import ScanOptions, scan
from corpaudit.sinks import ReportFolder
from corpaudit.sources import write_files
from corpaudit.storage import work_folder
from tests.helpers import corpus
from tests.test_scan import DEMO


@pytest.fixture
def folder(spark):
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


def report(spark, n=40):
    return spark.range(n).selectExpr("concat('r', id % 15) as repo_id", "cast(id div 15 as int) as part", "array(id, id + 1) as findings")


def rows(frame):
    return sorted(map(repr, frame.collect()))


def test_each_document_once_however_often_a_run_ends(spark, folder, monkeypatch):
    sink, docs = ReportFolder(spark, folder, batches=6), report(spark)
    assert sink.read(docs.schema).count() == 0
    write, left = ReportFolder._write, [2]

    def ending(self, part, batch):
        if not left[0]:
            # the documents are there, the commit is not
            part.write.json(self._documents("lost"))
            raise RuntimeError("ended")
        left[0] -= 1
        write(self, part, batch)

    monkeypatch.setattr(ReportFolder, "_write", ending)
    with pytest.raises(RuntimeError):
        sink.write(docs)
    some = sink.read(docs.schema)
    assert sink.commits().count() == 2 and set(rows(some)) <= set(rows(docs))
    monkeypatch.setattr(ReportFolder, "_write", write)
    assert sink.write(docs) == 4
    assert rows(sink.read(docs.schema)) == rows(docs)
    assert sink.write(docs) == 0 and rows(sink.read(docs.schema)) == rows(docs)
    told = sink.commits().selectExpr("sum(repos)", "sum(documents)").first()
    assert tuple(told) == (15, 40)


def test_nothing_to_write(spark, folder):
    sink, docs = ReportFolder(spark, folder, batches=2), report(spark, 0)
    assert sink.write(docs) == 2 and sink.read(docs.schema).count() == 0


def test_batches_equal_one_scan(spark, folder):
    store = FeatureStore(spark, f"{folder}/store")
    changed = {**DEMO, "src/broken.py": "x = 1\n"}
    deliveries = [corpus(spark, DEMO, "a").unionByName(corpus(spark, DEMO, "b")), corpus(spark, {"x.js": "y"}, "c"), corpus(spark, changed, "a")]
    for n, files in enumerate(deliveries):
        write_files(files, f"{folder}/packed/{n}")
        live.follow(spark, f"{folder}/packed", f"{folder}/live", feature_store=store).awaitTermination()
    live.apply_batch(deliveries[0], 0, f"{folder}/live", ScanOptions(), store)
    whole = scan(corpus(spark, changed, "a").unionByName(corpus(spark, DEMO, "b")).unionByName(deliveries[1]))
    for name in ("findings", "scores", "summary", "recommendations"):
        kept, wanted = live.current(spark, f"{folder}/live", name), getattr(whole, name)
        assert rows(kept.select(*wanted.columns)) == rows(wanted), name
