import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpaudit.llm import passages
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose


def brute_force(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in data:
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append(repr((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def corpus():
    rows = [r for r in odd_rows() if r[0] != 9]
    passage, other = prose(1, 200), prose(2, 90)
    rows += [(100 + k, prose(200 + k, 80) + passage[k:900 + k] + prose(300 + k, 30), "en", "s", 1) for k in range(20)]
    rows += [(200 + k, other[:150 + 7 * k] + prose(500 + k, 40), "en", "s", 1) for k in range(20)]
    rows += [(300, passage + " " + passage, "en", "s", 1), (301, "ab" * 700, "en", "s", 1), (302, "é😀" * 200, "en", "s", 1)]
    return rows


@pytest.mark.parametrize("length", [400, 64])
def test_equals_brute_force(spark, length):
    rows = corpus()
    found = passages.without_repeats(documents(spark, rows), length).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute_force(rows, length)


def test_triggers_of_many_phrases_are_compared_by_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(passages, "TOGETHER", 3)
    rows = corpus()
    found = passages.without_repeats(documents(spark, rows), 400).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute_force(rows, 400)


def test_empty_table_and_clashing_columns(spark):
    assert passages.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = documents(spark, [(1, "a" * 900, "en", "s", 1)]).selectExpr("*", "1 as node", "2 as flags", "3 as n_bytes", "4 as idx")
    row = passages.without_repeats(extra).collect()[0]
    assert (row.n_bytes, row.n_removed, row.n_spans) == (900, 900, 1)


def peak_of(run, batch):
    passages._powers.cache_clear()
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def letters(draw, size):
    return draw.integers(97, 123, size).astype(np.uint8).tobytes()


def test_memory_of_a_task_does_not_follow_its_batch(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(passages, "in_arrow", lambda rows, run, schema: runs.append(run))
    passages.occurrences(documents(spark, []), 400)
    draw = np.random.default_rng(1)
    texts = [letters(draw, 2000).decode() for _ in range(4000)]
    rows, peak = peak_of(runs[0], pa.RecordBatch.from_pydict({"node": list(range(4000)), "text": texts}))
    assert rows > 4000 and peak < 200 << 20
    phrases = [letters(draw, 780) + b"a" * 20 for _ in range(6000)]
    phrases[1] = phrases[0]
    columns = {"anchor": [1] * 6000, "node": list(range(6000)), "idx": [0] * 6000, "whole": [False] * 6000, "ahead": [0] * 6000, "bytes": phrases}
    rows, peak = peak_of(passages._common(400), pa.RecordBatch.from_pydict(columns))
    assert rows == 2 and peak < 200 << 20
