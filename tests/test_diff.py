import random
import uuid
from collections import Counter, defaultdict

import pytest

from corpaudit.operators import diff
from corpaudit.operators.diff import KeptRun, differing_leaves, differing_rows, finding_history
from corpaudit.plans.scan import ScanOptions, repeat_differences, verify_repeatable
from corpaudit.storage import work_folder
from tests.helpers import corpus
from tests.test_scan import DEMO

COLUMNS = ["repo_id", "id", "line"]
SCHEMA = "repo_id string, id string, line int"


def kept(spark, rows):
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}/run"
    return KeptRun.write(spark.createDataFrame(rows, SCHEMA), path, columns=COLUMNS)


def random_rows(n, seed):
    draw = random.Random(seed)
    return [(f"r{draw.randint(0, 9)}", f"F{draw.randint(0, n)}", draw.choice([None, 1, 2])) for _ in range(n)]


@pytest.mark.parametrize("filtered", [0, 100])
def test_differing_rows(spark, monkeypatch, filtered):
    monkeypatch.setattr(diff, "FILTERED_LEAVES", filtered)
    rows = random_rows(3000, 1)
    changed = rows[:-20] + [("r1", "new", None), ("r1", "new", None), rows[5]]
    a, b = kept(spark, rows), kept(spark, changed)
    found = {(r.repo_id, r.id, r.line): (r.in_a, r.in_b) for r in differing_rows(a, b).collect()}
    x, y = Counter(rows), Counter(changed)
    assert found == {k: (x[k], y[k]) for k in x | y if x[k] != y[k]}
    assert 0 < len(differing_leaves(a, b)) <= len(found)


def test_equal_and_empty_runs(spark):
    rows = random_rows(500, 2)
    shuffled = list(rows)
    random.Random(3).shuffle(shuffled)
    a, b, none = kept(spark, rows), kept(spark, shuffled), kept(spark, [])
    assert differing_leaves(a, b) == [] and differing_rows(a, b).count() == 0
    assert differing_leaves(none, kept(spark, [])) == []
    assert differing_rows(a, none).count() == len(set(rows))


def test_the_tree_sums_up(spark):
    rows = random_rows(700, 4)
    tree = kept(spark, rows).tree().collect()
    totals = defaultdict(int)
    for r in tree:
        totals[r.level] += r.rows
    assert totals == {level: 700 for level in range(5)} and sum(r.level == 0 for r in tree) == 1


def test_history(spark):
    draw = random.Random(5)
    runs = [(run, "r", f"F{i}", "p", None if i % 3 else 1) for i in range(60) for run in (1, 2, 4, 7, 9) if draw.random() < 0.6]
    runs += [(9, "r", "F0", "p", 1), (9, "r", "F0", "p", 1)]
    frame = spark.createDataFrame(runs, "run int, repo_id string, id string, path string, line int")
    order = sorted({r[0] for r in runs})
    seen = defaultdict(set)
    for run, *key in runs:
        seen[tuple(key)].add(order.index(run))
    expected = []
    for key, places in seen.items():
        spell = 0
        for at in sorted(places):
            if at - 1 not in places:
                spell, first = spell + 1, at
            if at + 1 not in places:
                expected.append((*key, spell, order[first], order[at], at == len(order) - 1))
    assert sorted(map(repr, (tuple(r) for r in finding_history(frame).collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("reorder", [False, True])
def test_scans_repeat_under_another_schedule(spark, reorder):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    files = corpus(spark, DEMO)
    assert [r.repeatable for r in verify_repeatable(files, reorder=reorder).collect()] == [True]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_change_between_the_scans_is_named(spark, monkeypatch):
    from corpaudit.plans import scan as plans

    results = [DEMO, {**DEMO, "src/broken.py": "x = 1\n"}]
    real = plans.scan
    monkeypatch.setattr(plans, "scan", lambda files, repos, options: real(corpus(spark, results.pop(0)), repos, options))
    rows = repeat_differences(corpus(spark, DEMO)).collect()
    assert [(r.id[:11], r.path, r.in_a, r.in_b) for r in rows] == [("CODE-SYNTAX", "src/broken.py", 1, 0)]


def test_unstored_scans_are_refused(spark):
    with pytest.raises(ValueError):
        verify_repeatable(corpus(spark, DEMO), options=ScanOptions(store=False))
