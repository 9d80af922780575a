from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpaudit.llm.sharding import quotas, sharded
from tests.llm.helpers import documents, odd_rows

TEXT_LINK = "if(text is null, null, array(xxhash64(text)))"


def placed(spark, rows, shards, links=TEXT_LINK):
    return sharded(documents(spark, rows), F.expr(links) if isinstance(links, str) else links, shards).collect()


def even_and_gapless(rows, total, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[j]) for j in range(shards)]
    assert len(rows) == total and sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def groups_of(rows):
    shards = defaultdict(Counter)
    for r in rows:
        if r.text is not None:
            shards[r.text][r.shard] += 1
    return shards


def test_groups_that_fit_stay_whole(spark):
    texts = [f"text {i % 60}" for i in range(300)] + [f"alone {i}" for i in range(203)]
    rows = placed(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], 7)
    even_and_gapless(rows, 503, 7)
    assert all(len(shards) == 1 for shards in groups_of(rows).values())


def test_a_group_beyond_a_shard_lies_in_as_few_as_hold_it(spark):
    texts = ["copy"] * 700 + [f"pair {i // 2}" for i in range(200)] + [f"alone {i}" for i in range(1100)]
    rows = placed(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], 10)
    even_and_gapless(rows, 2000, 10)
    shards = groups_of(rows)
    # 200 rows a shard: the best is 4
    assert len(shards["copy"]) <= 5
    assert sum(len(s) > 1 for t, s in shards.items() if t.startswith("pair")) <= 5


def test_without_loners_full_shards_exchange_rows(spark):
    rows = placed(spark, [(i, f"text {i % 100}", "en", "s", 1) for i in range(400)], 4)
    even_and_gapless(rows, 400, 4)
    cut = sum(sum(s.values()) ** 2 - sum(n * n for n in s.values()) for s in groups_of(rows).values()) // 2
    # as dealt, 4 rows of a text lie in 4 shards: 600 pairs are cut
    assert cut <= 150


def test_documents_of_several_links_follow_most_neighbours(spark):
    # rings of hosts and texts: a row is linked by its text and by its host
    rows = [(i, f"text {i % 40}", "en", f"host{i % 8}", 1) for i in range(400)] + [(i, None, "en", None, 1) for i in range(400, 800)]
    links = F.when(F.col("text").isNotNull(), F.array(F.xxhash64("text"), F.xxhash64(F.lit("h"), "source")))
    found = placed(spark, rows, 8, links)
    even_and_gapless(found, 800, 8)
    hosts = defaultdict(Counter)
    for r in found:
        if r.source:
            hosts[r.source][r.shard] += 1
    # 50 rows of a host among 100 places of a shard
    assert sum(max(c.values()) for c in hosts.values()) >= 300


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows(spark, shards):
    rows = placed(spark, odd_rows(), shards)
    even_and_gapless(rows, len(odd_rows()), shards)


def test_empty_and_clashing(spark):
    assert placed(spark, [], 4) == []
    docs = documents(spark, odd_rows()).withColumns({c: F.lit("mine") for c in ("shard", "slot", "_row", "node", "rows", "_node", "a.b")})
    rows = sharded(docs, F.expr(TEXT_LINK), 3)
    assert sorted(rows.columns) == sorted(docs.columns)
    assert {r["node"] for r in rows.collect()} == {"mine"} and {r.shard for r in rows.collect()} == {0, 1, 2}


def test_quotas_keep_capacities():
    demand = {(0, 1): 5, (1, 0): 3, (1, 2): 9, (2, 0): 4, (0, 2): 1}
    room = [0, 2, 1]
    granted = quotas(demand, room)
    change = [0, 0, 0]
    for (i, j), n in granted.items():
        assert 0 <= n <= demand[i, j]
        change[i] -= n
        change[j] += n
    assert all(c <= r for c, r in zip(change, room)) and granted[0, 1] >= 3
    assert quotas({}, [1, 2]) == {}
