import re

import numpy as np
import pytest

from corpaudit.llm import jaccard
from tests.llm.helpers import SCHEMA, documents, edited, odd_rows, prose


def brute_force(rows, width, num, den):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        grams = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
        sets.append(grams or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and same * den >= num * (len(sets[a]) + len(sets[b]) - same):
                root[find(a)] = find(b)
    names = {}
    for i, row in enumerate(rows):
        if row[0] is not None and sets[i]:
            names[find(i)] = min(names.get(find(i), row[0]), row[0])
    return sorted((repr((row[0], len(sets[i]), names.get(find(i), row[0]) if sets[i] else row[0])) for i, row in enumerate(rows)))


def corpus():
    rows = odd_rows()
    for base in range(12):
        text = prose(100 + base, 30 + 25 * base)
        for k in range(6):
            rows.append((1000 + 10 * base + k, edited(text, k, (0, 0.005, 0.01, 0.02, 0.04, 0.08)[k]), "en", "s", 1))
    shared = prose(5, 60)  # a passage that unrelated texts share
    rows += [(3000 + k, prose(400 + k, 100) + " " + shared, "en", "s", 1) for k in range(30)]
    # a chain: each is near the next, the ends are far apart
    chain = prose(9, 300).split(" ")
    rows += [(4000 + k, " ".join(["q%d" % i if i < 5 * k else w for i, w in enumerate(chain)]), "en", "s", 1) for k in range(9)]
    return rows


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_equals_brute_force(spark, width, num, den):
    rows = corpus()
    found = jaccard.groups(documents(spark, rows), width, num, den).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute_force(rows, width, num, den)


def test_a_large_group_of_near_copies_is_handed_over_in_lists(spark):
    text = prose(77, 150)
    rows = [(i, edited(text, i, 0.008), "en", "s", 1) for i in range(400)]
    found = jaccard.groups(documents(spark, rows).repartition(2), 4, 85, 100).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute_force(rows, 4, 85, 100)


def test_classes_catch_every_pair_that_differs_no_more_than_it_may():
    draw = np.random.default_rng(3)
    for size in [*range(1, 30), 55, 431]:
        for _ in range(4):
            x = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
            # drop and add as many as the threshold bears
            for drop in range(0, len(x) + 1):
                add = 0
                while 100 * (len(x) - drop) >= 85 * (len(x) + add + 1):
                    add += 1
                if 100 * (len(x) - drop) < 85 * (len(x) + add):
                    break
                y = np.unique(np.concatenate([x[drop:], draw.integers(0, 1 << 63, add).astype(np.uint64)]))
                if len(y):
                    owners, keys = jaccard.class_keys([x, y], 85, 100)
                    assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist()), (size, drop, add)


def test_empty_table_and_clashing_columns(spark):
    assert jaccard.groups(spark.createDataFrame([], SCHEMA), 4, 85, 100).count() == 0
    extra = documents(spark, [(1, "a b c d e", "en", "s", 1)]).selectExpr("*", "1 as node", "2 as n_shingles", "3 as root", "4 as least")
    assert jaccard.groups(extra, 4, 85, 100).collect()[0].component_id == 1
