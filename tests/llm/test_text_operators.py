import math
import time
import tracemalloc
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpaudit.llm import brown_lm, crf, fields, langid, pages, pii, quality, queries, vectors
from registry.check import compare, database
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose

FOLDER = "/root/testdata/sf0.001"


# ---- personal data


@pytest.mark.parametrize("text,spans", [
    ("a@b.c@d.e", [("email", 0, 5)]), ("x.y+z@mail-1.example.com.", [("email", 0, 24)]), ("@a.b a@b a@.c", []),
    ("1.2.3.256 1.2.3.255", [("ip", 10, 19)]), ("1.2.3.4.5.6.7.8", [("ip", 0, 7), ("ip", 8, 15)]), ("0001.2.3.4", [("ip", 0, 10)]),
    ("4111 1111-1111 1111", [("card", 0, 19)]), ("4111111111111112", []), ("+1 (212) 555-0147.", [("phone", 0, 17)]), ("+1234567", []),
    ("é😀 a@b.co", [("email", 3, 9)]), ("", []), ("1" * 5000 + ".1.1.1", []),
])
def test_base_spans(text, spans):
    assert pii.base_spans(text) == spans


def test_patterns_equal_plain_ones_on_random_text():
    draw = np.random.default_rng(0)
    alphabet = list("ab.@+-_%12 5()9\n")
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(draw.choice(alphabet, 40))
        found = pii.base_spans(text)
        assert [s[1:] for s in found if s[0] == "email"] == [m.span() for m in email.finditer(text)]
        plain = [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s[1:] for s in found if s[0] == "ip"] == plain


def test_field_adds_spans_and_leaves_clean_text_alone():
    chain = pii.train()
    find = lambda t: [(k, t[a:b]) for k, a, b in pii.added_spans([t], [pii.base_spans(t)], chain)[0]]
    assert find("mail jane.roe (at) uni (dot) example (dot) edu now") == [("email", "jane.roe (at) uni (dot) example (dot) edu")]
    assert find("call 646-555-0188 please") == [("phone", "646-555-0188")]
    for clean in ("in 1999 and 2003 - 2005 , page 12", "version 2.0 of 2021-01-02 at 10:20", "4785380592391139 $$$", "a (b) at c. dot"):
        assert find(clean) == []


@pytest.mark.parametrize("text,found", [
    ("contact " + "j.smith." * 8 + "x [at] example [dot] com for details", "j.smith." * 8 + "x [at] example [dot] com"),
    ("mail me: a_very_long_name_of_many_parts_and_words_indeed (at) post (dot) example (dot) net thanks",
     "a_very_long_name_of_many_parts_and_words_indeed (at) post (dot) example (dot) net"),
])
def test_field_decodes_beyond_what_marks_personal_data(text, found):
    (span,) = pii.added_spans([text], [pii.base_spans(text)], pii.train())[0]
    assert text[span[1]:span[2]] == found


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_field_labels_are_the_best_path_over_all_tokens(block, monkeypatch):
    monkeypatch.setattr(fields, "BLOCK_CHARS", block)
    monkeypatch.setattr(fields, "DECODED_TOKENS", block)
    chain = pii.train()
    field = fields.Field(chain)
    draw = np.random.default_rng(3)
    alphabet = list("ab.@+-_%12 5()9\n[]#xX\u0663\u00bd\u0130")
    lines = [re.sub(r"\[\[\w+:(.*?)\]\](?!\])", r"\1", line) for line in pii.LABELLED]
    texts = ["".join(draw.choice(alphabet, 50)) for _ in range(150)] + [
        "", " ", "\u0663" + "4 4\u06635 1\u06632", "\u00bdab \u00b2x x\u00b2", "\u0130stanbul \u212aim \u0391\u03a3 \u01c5", "1" * 30 + " " + "x" * 30,
        "\u4e2d\u6587 12-34", *lines, prose(5, 300).join(lines),
    ]
    got = [[] for _ in texts]
    for owner, *places in field.labels(texts):
        got[owner] = list(zip(*(p.tolist() for p in places)))
    for text, own in zip(texts, got):
        found = pii._tokens(text)
        tags = chain.decode(chain.scores(pii._features(found)), np.array([len(found)])) if found else []
        assert own == [(i, a, b, t) for i, ((_, a, b), t) in enumerate(zip(found, tags)) if t]


def test_field_takes_memory_in_proportion():
    field = fields.Field(pii.train())
    tracemalloc.start()
    # all one window: tokens by the string took 550 MB
    assert pii.added_spans(["12 34 " * 20_000], [[]], field) == [[]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(1)
    chain = crf.Chain(("a", "b", "c"), {}, np.zeros((0, 3)), draw.normal(size=(3, 3)), draw.normal(size=3))
    lengths = np.array([4, 1, 0, 5, 3])
    scores = draw.normal(size=(lengths.sum(), 3))
    got, at = chain.decode(scores, lengths), 0
    for n in lengths:
        own = scores[at:at + n]
        paths = list(np.ndindex(*[3] * n)) if n else [()]
        value = lambda p: (chain.first[p[0]] if p else 0) + sum(own[i, x] for i, x in enumerate(p)) + sum(chain.transition[p[i], p[i + 1]] for i in range(len(p) - 1))  # noqa: B023, E731
        assert tuple(got[at:at + n]) == max(paths, key=value)
        at += n


def test_find_and_mask(spark):
    rows = odd_rows() + [(50, "write a@b.org or +1 212 555 0147", "en", "s", 1)]
    docs = documents(spark, rows).selectExpr("*", "1 as pii", "2 as spans")
    out = {r.doc_id: r for r in pii.digests(pii.find(docs)).collect()}
    assert len(out) == len({r[0] for r in rows})
    assert (out[50].n_email, out[50].n_phone, out[50].spans) == (1, 1, "email:6:13,phone:17:32")
    assert out[50].base_sha256 == pii.digest([("email", 6, 13), ("phone", 17, 32)])
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert masked[50] == "write <email> or <phone>" and masked[1] is None and masked[2] == ""
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- languages


def test_languages(spark):
    kinds = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éèçstuv"}
    rows = [(i, prose(i, 20, kinds[k]), k, "s", 1) for i, k in enumerate(list(kinds) * 40)]
    filters = langid.train(documents(spark, rows[:90] + [(1, None, "aa", "s", 1), (2, "xyz", None, "s", 1)]))
    assert filters.names == ("aa", "bb", "cc")
    found = langid.identify(documents(spark, rows[90:] + odd_rows()).selectExpr("*", "1 as score"), filters).collect()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[r[0]].lang_pred == r[2] and 0 < by_id[r[0]].score <= 1 for r in rows[90:])
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3))
    none = langid.train(spark.createDataFrame([], SCHEMA))
    assert none is None and {r.lang_pred for r in langid.identify(documents(spark, rows[:3]), none).collect()} == {"und"}


def test_filters_return_every_language_of_an_ngram():
    values, back = langid.distinct(np.array([5, 1 << 50, 5, (1 << 50) + 1], np.uint64))
    assert (values[back] == np.array([5, 1 << 50, 5, (1 << 50) + 1], np.uint64)).all() and len(values) == 3


# ---- pages


def test_pages_keep_the_article():
    chain = pages.train()
    for page in pages.labelled_pages():
        assert pages.main_text(page, chain) == "\n".join(b.text for b in pages.blocks(page) if b.label == "keep")
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><a href='/'>Home</a></nav>"
        "<article><h1>Head</h1><p>One &amp; two <b>three</b>\n four.<script>if(a<b)x()</script><p>Five</article>"
        "<div class='sidebar'><p>Side</p></div><section id=comments><p>Nice words here.</p></section><footer>&copy; x</footer>"
    )
    assert pages.main_text(page, chain) == "Head\nOne & two three four.\nFive"


def test_formulas_stay_in_their_line():
    page = "<article><p>Let <math><mi>x</mi><msup><mn>2</mn><mn>3</mn></msup></math> be it, <svg><g>no</g></svg>and so on for a while.</p></article>"
    assert pages.main_text(page, pages.train()) == "Let x23 be it, and so on for a while."


def test_deep_and_unmatched_markup_takes_time_in_proportion():
    chain, deep = pages.train(), 20_000
    started = time.monotonic()
    found = pages.main_text("<div>x" * deep + "</span2></td>" * deep + "</div>" * deep, chain)
    # paths of all ancestors would be 200 million names
    assert set(found) <= {"x", "\n"} and time.monotonic() - started < 60
    assert pages.main_text("<article><p>Some words of text.</p></article>", chain) == "Some words of text."


def test_path_scores_are_those_of_all_features():
    chain = pages.train()
    for page in pages.labelled_pages()[::3]:
        for block in pages.blocks(page):
            assert np.allclose(pages._path_scores(block.node, chain), chain.scores([pages._path_features(block.node)])[0])


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "</p></p>", "<script>", "a<b", "<p>" * 3000, "&#xD800; &#0;"])
def test_broken_markup_never_fails(page):
    pages.main_text(page, pages.train())


def test_extract(spark):
    rows = [(1, "u", "<article><p>Some words of text.</p></article>"), (2, "u", None), (None, None, ""), (1, "u", "<p>x")]
    found = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 as text")).collect()
    assert sorted((r.text, r.n_chars) for r in found) == [("", 0), ("", 0), ("Some words of text.", 19), ("x", 1)]


# ---- quality


def test_quality_of_odd_rows(spark):
    window = prose(3, 9)
    rows = odd_rows() + [(60, f"{prose(4, 30)} {window} {prose(5, 5)} {window}", "en", "s", 1), (61, "a b\n\na b\n a b\na b", "en", "s", 1)]
    found = quality.rules(documents(spark, rows).selectExpr("*", "1 as n_words", "2 as size", "3 as common")).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert (by_id[1].n_words, by_id[1].base_failed, by_id[1].kept) == (0, True, False)
    assert (by_id[60].n_words, by_id[60].n_repeat_words, by_id[60].base_failed) == (53, 18, True)
    assert (by_id[61].n_dup_lines, by_id[61].word_chars) == (2, 8)
    assert quality.rules(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- class model


def test_base_score_and_probabilities(spark):
    rows = [(1000 + i, prose(i % 7, 30 + i), "en", "s", 1) for i in range(60)] + odd_rows()
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    found = brown_lm.score_by_classes(documents(spark, rows), documents(spark, training)).collect()
    words = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    counts = Counter(w for r in training for w in words(r[1])) + Counter({None: len(training)})
    total = sum(counts.values())
    floor = math.log10(total + 0.1 * (len(counts) + 1))
    want = sorted((len(words(t)) + 1, round(sum(math.log10(counts[w] + 0.1) - floor for w in [*words(t), None]), 6)) for _, t, *_ in rows if "Ü" not in (t or ""))
    got = sorted((r.n_tokens, round(r.base_score, 6)) for r in found if r.doc_id != 6)
    assert got == want and {r.train_tokens for r in found} == {total} and all(r.score <= 0 for r in found)
    empty = brown_lm.score_by_classes(documents(spark, rows[:2]), spark.createDataFrame([], SCHEMA)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in empty)


def test_exchange_finds_classes():
    draw = np.random.default_rng(2)
    groups = np.arange(24) % 3
    pairs = np.zeros((26, 26), np.int64)
    for _ in range(6000):
        a = draw.integers(24)
        b = draw.choice(np.flatnonzero(groups == (groups[a] + 1) % 3))
        pairs[a, b] += 1
    own = brown_lm.exchange(pairs, 3)[:24]
    assert len(set(zip(groups.tolist(), own.tolist()))) == 3


def test_best_class_is_that_of_the_exchange():
    draw = np.random.default_rng(4)
    total, size = brown_lm.TOTAL, 300
    pairs = draw.poisson(0.3, (size + 1, size + 1))
    own = np.append(draw.integers(0, brown_lm.CLASSES, size), brown_lm.END)
    table_of = lambda own: np.array(
        [[pairs[np.ix_(own == a, own == b)].sum() for b in range(total)] for a in range(total)], float)
    likelihood = lambda t: (brown_lm._gain(t).sum() - brown_lm._gain(t.sum(0)).sum() - brown_lm._gain(t.sum(1)).sum())
    lists = []
    for w in range(6):
        entries = np.concatenate([np.bincount(own, pairs[:, w], total), np.bincount(own, pairs[w], total), [pairs[w, w]]]).astype(int)
        lists.append([int(n) * brown_lm.ENTRIES + e for e, n in enumerate(entries) if n])
    found = brown_lm.best_classes(own[:6], pa.array(lists, pa.list_(pa.int64())), table_of(own))
    for w in range(6):
        tries = [likelihood(table_of(np.where(np.arange(size + 1) == w, k, own))) for k in range(brown_lm.CLASSES)]
        assert tries[found[w]] >= max(tries) - 1e-6


@pytest.mark.parametrize("held, seeds, core", [(1 << 18, 1024, 1 << 16), (40, 8, 1 << 16), (0, 0, 1 << 16), (40, 8, 15)])
def test_all_words_have_classes_and_scores_follow_them(spark, monkeypatch, held, seeds, core):
    monkeypatch.setattr(brown_lm, "HELD", held)
    monkeypatch.setattr(brown_lm, "CORE", core)
    monkeypatch.setattr(brown_lm, "TASKS", 2)
    monkeypatch.setattr(brown_lm, "SEEDS", seeds)
    rows = [(1000 + i, prose(i % 9, 30 + i), "en", "s", 1) for i in range(60)] + odd_rows()
    training = documents(spark, rows[:55]).select("text")
    counts = brown_lm.stored(brown_lm.word_counts(training), "counts")
    model = brown_lm.train(counts, training)
    words = [w for t in [r[1] for r in rows[:55]] for w in t.split()]
    names = sorted(set(words))
    hashes = brown_lm.word_hashes(pa.array(names))
    rare = {r["word"]: r["class"] for r in model.rare.collect()}
    place = {h: i for i, h in enumerate(model.held.tolist())}
    of = {w: int(model.held_classes[place[h]]) if h in place else rare[int(np.uint64(h).view(np.int64))] for w, h in zip(names, hashes.tolist())}
    assert len(place) + len(rare) == len(names) and max(of.values()) < brown_lm.CLASSES
    counted, table, end = Counter(words), np.full((brown_lm.TOTAL,) * 2, 0.1), brown_lm.END
    for r in rows[:55]:
        chain = [end, *[of[w] for w in r[1].split()], end]
        for a, b in zip(chain, chain[1:]):
            table[a, b] += 1
    logs, sizes = np.log10(table / table.sum(axis=1, keepdims=True)), Counter(of[w] for w in words)
    for r, text in zip(sorted(brown_lm.score(documents(spark, rows[:60]), model).collect(), key=lambda r: r.doc_id), [r[1] for r in rows[:60]]):
        chain = [end, *[of.get(w, brown_lm.UNSEEN) for w in text.split()], end]
        want = sum(logs[a, b] for a, b in zip(chain, chain[1:])) + sum(math.log10(counted[w] / sizes[of[w]]) for w in text.split() if w in of)
        assert abs(r.score - want) < 1e-6


# ---- vectors


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    draw = np.random.default_rng(5)
    base = draw.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + draw.normal(size=16) * 0.08 * (i % 4)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(500 + i, rows[0][1]) for i in range(40)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] + [1.0] * 15), (603, [None] + [1.0] * 15), (604, []), (605, [1.0, 2.0]), (606, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as label")
    found = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    sound = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _ in rows}
    for i, v in sound:
        for j, w in sound:
            if i < j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    wanted = sum(map(len, links.values()))
    assert 0.99 * wanted <= sum(r.n_links for r in found.values()) <= wanted
    assert all(found[i].n_links <= len(links[i]) for i in links) and found[600].kept and found[604].n_links == 0
    assert all(found[i].kept == (found[i].component_id == i) for i in links)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    result = compare(spark, database(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert result.startswith("equal"), result


def test_pipeline_language_goes_by_the_share_of_known_ngrams(spark):
    import corpus_pipeline

    clean = [(i, prose(i, 60), "en", "s", 1) for i in range(20)] + [(100 + i, prose(i, 60, "mnopqrst"), "de", "s", 1) for i in range(20)]
    gibberish = "ab " + prose(3, 80, "\u0434\u0436\u0437\u0438\u043b")
    rows = clean + [(500, gibberish, None, "s", 1), (501, "1234 5678", None, "s", 1)]
    kept = corpus_pipeline.language(spark, documents(spark, rows), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in clean)


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d = (prose(i, 60) for i in range(4))
    near = a + " one more word"
    rows = [
        (1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, near, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1),
        (None, c, "en", "s", 1), (None, d, "en", "s", 1), (None, d, "en", "s", 1), (None, "", "en", "s", 0), (None, None, "en", "s", 0),
    ]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), FOLDER).collect()]
    assert Counter(kept) == Counter([(1, a), (2, b), (3, c), (None, d), (None, ""), (None, None)])


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
