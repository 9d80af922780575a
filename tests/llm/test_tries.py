import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpaudit.llm import tries
from corpaudit.llm.tries import conversations, trie, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        # a remainder as SQL has it: that of a negative id is not positive
        rebuilt[c] = plain.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in children[node])
    out = []
    for node, convs in members.items():
        ended = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in trie(with_shared_heads(conversations(frame))).collect()), key=repr)


def random_rows(n, seed=0, words=2, longest=6):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(0, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", " ".join(draw.choice("ab") for _ in range(draw.randint(0, words)))))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_equals_brute_force_whatever_the_blocks(spark, monkeypatch, block):
    rows = random_rows(150)
    monkeypatch.setattr(tries, "BLOCK_CONVERSATIONS", block)
    # workers import the module anew, so the walk is also run here
    parts = spark.createDataFrame(rows, SCHEMA)
    convs = with_shared_heads(conversations(parts)).orderBy("conv_id").toArrow().to_batches()
    nodes = [r for batch in tries._walks(iter(convs)) for r in batch.to_pylist()]
    counts = defaultdict(int)
    for r in nodes:
        counts[r["path"]] += r["n_convs"]
    expected = brute(rows)
    assert sorted(counts.values()) == sorted(r[3] for r in expected)
    assert found(spark, rows) == expected


def test_many_blocks_are_merged(spark):
    # 9,000 conversations: several blocks of 4,096, with one very common first turn and many equal ones
    draw = random.Random(3)
    rows = [(c, 0, "user", "hello there") for c in range(9000)]
    rows += [(c, 1, "assistant", f"answer {draw.randint(0, 30)}") for c in range(9000) if c % 3]
    rows += [(c, 2, "user", str(draw.randint(0, 5))) for c in range(9000) if c % 5 == 1]
    assert found(spark, rows) == brute(rows)


def test_a_long_conversation(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(30_000)] + [(21, t, "user", f"turn {t % 7}") for t in range(50)]
    assert found(spark, rows[:400] + rows[30_000:]) == brute(rows[:400] + rows[30_000:])
    convs = conversations(spark.createDataFrame(rows, SCHEMA))
    assert trie(convs).agg(F.max("depth")).first()[0] == 30_000


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first by null"), (0, 0, None, None), (0, 1, "user", "x y"), (None, 0, "user", "lost"),
        (3, 0, "user", "only turn"), (23, 0, "user", "without family"), (40, 0, "", ""), (41, 0, None, None),
        (41, 5, "user", "a\tb c 　d"), (43, 0, "user", "same"), (43, 0, "user", "same"), (-5, 0, "user", "negative id"),
        (60, 0, "user", "word " * 20_000),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_and_clashing(spark):
    assert found(spark, []) == []
    rows = random_rows(30, seed=8)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("turns", "path", "depth", "t", "_family")})
    got = trie(with_shared_heads(conversations(frame)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
