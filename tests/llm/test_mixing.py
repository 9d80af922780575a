from collections import defaultdict

from corpaudit.llm import mixing
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose

LEVELS = ("lang", "source")
WEIGHTS = ({"en": 3, "de": 1}, {"s0": 2})


def filled(total, nodes):
    """Water filling in whole tokens: nodes is {name: (supply, weight)}."""
    out, left, weight = {}, total, sum(w for _, w in nodes.values())
    order = sorted(nodes, key=lambda n: (nodes[n][0] / nodes[n][1], n))
    for i, name in enumerate(order):
        supply, own = nodes[name]
        if left * own <= supply * weight:
            for rest in order[i:]:
                out[rest] = min(nodes[rest][0], left * nodes[rest][1] // weight)
            break
        out[name] = supply
        left, weight = left - supply, weight - own
    return out


def corpus():
    return odd_rows() + [
        (100 + i, prose(i, 3 + i % 50), ("en", "de", "fr")[i % 7 % 3], f"s{i % 5 if i % 3 else 0}", 1) for i in range(400)
    ]


def test_budgets_and_prefixes(spark):
    rows = corpus()
    epochs, total = 2, 9_000
    found = mixing.mixed(documents(spark, rows), LEVELS, WEIGHTS, total, epochs, 5).collect()
    tokens = defaultdict(int)
    for doc_id, text, lang, source, _ in rows:
        tokens[(lang or "(none)", source or "(none)")] += len((text or "").replace("\x0b", " ").split())
    langs = defaultdict(int)
    for (lang, _), n in tokens.items():
        langs[lang] += n * epochs
    by_lang = filled(min(total, sum(langs.values())), {k: (n, WEIGHTS[0].get(k, 1)) for k, n in langs.items()})
    taken = defaultdict(int)
    for r in found:
        assert 0 < r.taken <= r.n_tokens
        taken[(r.lang or "(none)", r.source or "(none)")] += r.taken
    for lang, budget in by_lang.items():
        own = {s: (n * epochs, WEIGHTS[1].get(s, 1)) for (x, s), n in tokens.items() if x == lang}
        for source, amount in filled(budget, own).items():
            # rows that repeat the last id may pass the budget
            assert amount <= taken[(lang, source)] <= amount + 1, (lang, source)


def test_same_seed_same_rows_and_empty(spark):
    docs = documents(spark, corpus())
    pick = lambda seed: sorted(map(repr, mixing.mixed(docs, LEVELS, WEIGHTS, 0.3, 1, seed).select("doc_id", "taken").collect()))
    assert pick(1) == pick(1) != pick(2)
    assert mixing.mixed(spark.createDataFrame([], SCHEMA), LEVELS, WEIGHTS, 0.5).count() == 0
    clash = docs.selectExpr("*", "1 as epoch", "2 as taken", "3 as n_tokens", "4 as weight")
    assert mixing.mixed(clash, LEVELS, WEIGHTS, 0.5).count() > 0


def test_everything_is_taken_if_the_total_is_all(spark):
    rows = corpus()
    found = mixing.mixed(documents(spark, rows), LEVELS, WEIGHTS, 1.0, 1, 5).collect()
    assert sum(r.taken for r in found) == sum(len((r[1] or "").replace("\x0b", " ").split()) for r in rows)
