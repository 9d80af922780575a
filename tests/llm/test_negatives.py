import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpaudit.llm import negatives
from corpaudit.llm.negatives import mined

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(x):
    return math.floor(x) if abs(x) < 2**63 else int(math.copysign(2**63, x))


def brute(rows, every, factor=256, k_pos=5, k_neg=5, low=80, high=100, den=100):
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, label, [whole(factor * x) for x in vector]))
    dot = lambda a, b: max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a_id, a_label, a in usable:
        if a_id % every:
            continue
        scored = sorted((-dot(a, v), i, label) for i, label, v in usable)
        positives = [(i, -s) for s, i, label in scored if label == a_label and i != a_id][:k_pos]
        for p_id, p in positives:
            window = [(i, -s) for s, i, label in scored if label != a_label and low * p <= -den * s <= high * p][:k_neg]
            out += [(a_id, p_id, r + 1, n_id, p, n) for r, (n_id, n) in enumerate(window)]
    return sorted(out)


def found(spark, rows, every, **options):
    settings = dict(factor=256, positives=5, negatives=5, low=80, high=100, den=100) | options
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in mined(frame, F.col("vec_id") % every == 0, **settings).collect())


def vectors(n, dim, labels, seed=0, steps=None):
    draw = random.Random(seed)
    one = (lambda: draw.randint(0, steps) / steps) if steps else (lambda: abs(draw.gauss(0.3, 0.2)))
    return [(i, [one() for _ in range(dim)], draw.randrange(labels)) for i in range(n)]


def test_equals_brute_force_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_CELLS", 500)
    monkeypatch.setattr(negatives, "ANCHOR_CELLS", 40)
    rows = vectors(300, 6, 4)
    assert found(spark, rows, 20) == brute(rows, 20)


def test_ties_and_equal_limits(spark):
    # few values: many equal scores, windows that share a limit
    rows = vectors(200, 2, 3, steps=2)
    expected = brute(rows, 10)
    assert expected and found(spark, rows, 10) == expected


def test_copies_hold_a_third(spark):
    rows = vectors(120, 4, 3, seed=2)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]
    assert found(spark, rows, 30) == brute(rows, 30)


def test_other_ratios(spark):
    rows = vectors(150, 5, 3, seed=4)
    got = found(spark, rows, 15, positives=3, negatives=2, low=70, high=95, factor=100)
    assert got and got == brute(rows, 15, 100, 3, 2, 70, 95)


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.4, 0.5], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [0.1, 0.2], None),
        (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (None, [0.5, 0.45], 2), (8, [], 2), (9, [0.5], 2),
        (10, [-0.5, -0.5], 1), (10, [-0.4, -0.5], 2), (11, [0.45, 0.45], 2), (11, [0.45, 0.45], 2), (12, [1e300, 1e300], 2),
        (13, [1e16, 0.5], 1), (14, [1e308, 1e308], 2),
    ]
    got = found(spark, rows, 100)
    assert got == brute(rows, 100)
    assert {r[1] for r in got} >= {1}


def test_negative_positives_and_no_anchor(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2), (3, [0.0], 2)]
    assert found(spark, rows, 100) == brute(rows, 100) == []
    assert found(spark, rows[1:], 100) == []
    assert found(spark, [], 100) == []


def test_products_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**14, 1.0], [1.0, 1.0], [2.0**40, 0.0]])
    assert negatives._products(a, b).tolist() == [[2**54 + 3, 2**40 + 3, 2**63 - 1]]


@pytest.mark.parametrize("name", ["anchor_id", "_row", "slot", "limits", "upper"])
def test_clashing_columns(spark, name):
    rows = vectors(60, 3, 2, seed=5)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn(name, F.lit("mine"))
    got = mined(frame, F.col("vec_id") % 20 == 0, 256, 5, 5, 80, 100, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)
