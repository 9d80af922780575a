import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpaudit.llm import common
from corpaudit.storage import stored
from tests.llm.helpers import documents, edited, prose
from tests.llm.test_jaccard import brute_force
from tests.llm.test_mixing import filled

MAIL = "write to jane.doe@example.org today"


def rows():
    out = []
    for i in range(60):
        lang, letters = ("en", "abcdefgh") if i % 3 else ("de", "mnopqrst")
        out.append((i, prose(i, 40 + 5 * (i % 9), letters), lang, f"src{i % 7}", 1))
    out += [(100 + i, out[i][1], out[i][2], f"src{i % 4}", 1) for i in range(10)]
    out += [(200 + i, edited(out[i + 10][1], i, 0.01), out[i + 10][2], "src1", 1) for i in range(10)]
    out.append((300, prose(300, 50) + " " + MAIL, "en", "src0", 1))
    # no letters, no known letters, nothing
    return out + [(400, "1234 5678", None, "src1", 1), (401, prose(9, 60, "джзил"), None, "src1", 1), (402, "", "en", "src1", 0), (403, None, "en", "src1", 0)]


def words(text):
    return len(text.split())


def expected():
    """doc_id -> text after the first four stages, in plain Python."""
    kept = [r for r in rows() if r[0] < 400]
    member = {}
    for line in brute_force(kept, corpus_pipeline.WIDTH, corpus_pipeline.NUM, corpus_pipeline.DEN):
        doc_id, _, component = eval(line)
        member[doc_id] = component
    kept = [r for r in kept if member[r[0]] == r[0]]
    texts = {r[0]: r[1].replace("jane.doe@example.org", "<email>") for r in kept}
    domain = {0: "web", 1: "books", 2: "forum"}
    place = {r[0]: (domain[int(r[3][3:]) % 3], r[2], r[3]) for r in kept}
    tokens = defaultdict(int)
    for i, leaf in place.items():
        tokens[leaf] += words(texts[i])
    budgets = {(): int(sum(tokens.values()) * corpus_pipeline.SHARE)}
    for level, weights in enumerate(corpus_pipeline.WEIGHTS):
        below = {}
        for parent, total in budgets.items():
            nodes = defaultdict(int)
            for leaf, n in tokens.items():
                if leaf[:level] == parent:
                    nodes[leaf[level]] += n
            for name, n in filled(total, {k: (n, weights.get(k, 1)) for k, n in nodes.items()}).items():
                below[*parent, name] = n
        budgets = below
    out = {}
    for leaf, n in tokens.items():
        whole, rest = divmod(budgets[leaf], n)
        order = sorted(
            (i for i in place if place[i] == leaf),
            key=lambda i: (hashlib.md5(f"{corpus_pipeline.SEED}:{whole}:{i}".encode()).hexdigest(), i),
        )
        before = 0
        for i in order:
            if whole or before < rest:
                out[i] = texts[i]
            before += words(texts[i])
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    documents(spark, rows()).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_equals_plain_python(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {i: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for i, text in expected().items()}
    lengths, places = defaultdict(int), defaultdict(list)
    for r in found:
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert lengths == wanted and 20 < len(wanted) < 71
    for spots in places.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))]
        assert sum(n for _, n in spots) <= corpus_pipeline.CAPACITY
    assert len(places) == -(-sum(wanted.values()) // corpus_pipeline.CAPACITY)


def test_stages_hand_on_columns_of_any_name(spark):
    names = ["pii", "score", "lang_pred", "hit_share", "n_tokens", "domain", "epoch", "taken", "_row", "row", "held", "node", "a.b", "label"]
    docs = documents(spark, [r for r in rows() if r[0] < 60 or r[0] == 300]).withColumns({n: F.lit("mine") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, docs, ""), name)
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.select(*[f"`{n}`" for n in names]).distinct().collect()} == {("mine",) * len(names)}
        docs = kept
    assert "<email>" in "".join(r.text for r in docs.filter("doc_id = 300").collect()) or docs.filter("doc_id = 300").isEmpty()


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_write_no_text_and_tell_rows_of_one_id_apart(spark, monkeypatch):
    written = []
    for module in (corpus_pipeline, corpus_pipeline.jaccard, common):
        monkeypatch.setattr(module, "stored", lambda table, name: written.append(table.columns) or stored(table, name))
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = a + " zz"
    table = [(7, a, "en", "s", 1)] * 3 + [(7, b, "en", "s", 1), (3, near, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "de", "s", 1)]
    table += [(None, b, "en", "s", 1), (None, prose(4, 60), "en", "s", 1)]
    bare = [(7, "", "en", "s", 1), (7, "", "en", "s", 1), (None, None, "en", "s", 1), (None, None, "en", "s", 1), (None, " ", "en", "s", 1)]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, table + bare), "").collect()
    expected = [(3, near), (7, b), (None, c), (None, table[-1][1])] + [r[:2] for r in bare]
    assert sorted(repr((r.doc_id, r.text)) for r in kept) == sorted(map(repr, expected))
    assert written and not [columns for columns in written if "text" in columns]
