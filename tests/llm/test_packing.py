import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpaudit.llm import packing
from tests.llm.helpers import SCHEMA, documents, odd_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_token_ids_equal_the_tokenizer_on_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    draw = random.Random(4)
    pieces = ["a", " ", "  ", "\n", "\t", "don't", "é", "漢字", " ", "　", "12", "!?", "<|endoftext|>", "\u0085", "ß", "\x1c", "x y", ""]
    texts = [None, "", " ", *["".join(draw.choice(pieces) for _ in range(draw.randint(1, 30))) for _ in range(400)]]
    for text, ids in zip(texts, packing.token_ids(pa.array(texts), PATH)):
        assert tokenizer.encode(text or "", add_special_tokens=False).ids == ids.tolist(), repr(text)


@pytest.mark.parametrize("length,expected", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)])])
def test_cut(length, expected):
    assert packing.cut(length, 8) == expected


def used_by(plan, capacity):
    used = Counter()
    for filling, times in plan.fillings:
        assert sum(n * copies for n, copies in filling) <= capacity and times > 0
        for n, copies in filling:
            used[n] += copies * times
    return used


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            at = rooms.index(room)
            place(i + 1, [*rooms[:at], room - items[i], *rooms[at + 1:]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_plan_is_the_best_there_is():
    for seed in range(200):
        draw = random.Random(seed)
        capacity = draw.choice([10, 20, 37, 60])
        items = [draw.randint(1, draw.choice([capacity, capacity // 2])) for _ in range(draw.randint(1, 11))]
        found = packing.plan(Counter(items), capacity)
        assert used_by(found, capacity) == Counter(items)
        assert found.sequences == fewest(items, capacity) >= found.least, (capacity, items)


def test_plan_beats_best_fit_decreasing():
    gained = 0
    for seed in range(6):
        draw = random.Random(seed)
        histogram = Counter(draw.randint(1, 2048) if seed < 3 else draw.randint(200, 900) for _ in range(400))
        found = packing.plan(histogram, 2048)
        plain = sum(times for _, times in packing.best_fit(histogram, 2048))
        assert used_by(found, 2048) == histogram and found.least <= found.sequences <= plain
        assert found.sequences <= found.least + 2
        gained += plain - found.sequences
    assert gained > 0


@pytest.mark.parametrize("histogram,sequences", [
    ({}, 0), ({1: 3_000_000}, 1465), ({1: 1500, 2: 10}, 1), ({2048: 10**9, 1: 10**9, 1024: 7}, 10**9 + 488285), ({1: 0, 5: 1}, 1),
])
def test_plan_takes_equal_lengths_in_one_step(histogram, sequences):
    found = packing.plan(histogram, 2048)
    assert found.sequences == found.least == sequences


def test_without_steps_the_incumbent_stands():
    histogram = Counter(random.Random(3).randint(200, 900) for _ in range(400))
    found = packing.plan(histogram, 2048, steps=0)
    assert used_by(found, 2048) == histogram
    assert found.least <= found.sequences <= sum(times for _, times in packing.best_fit(histogram, 2048))


def test_thousands_of_blank_texts(spark):
    rows = [(i, None if i % 2 else "", "en", "s", 1) for i in range(3000)] + [(5000, "a word", "en", "s", 1)]
    found = packing.packed(documents(spark, rows), PATH, 128).collect()
    places = {(r.sequence_id, r.offset) for r in found}
    assert len(places) == 3001 and len({s for s, _ in places}) == -(-sum(r.length for r in found) // 128)


def test_pack_places_all_rows_without_gaps(spark):
    rows = odd_rows() + [(100 + i, prose(i, 5 + i % 40), "en", "s", 1) for i in range(300)] + [(500, "same text", "en", "s", 1)] * 50
    found = packing.packed(documents(spark, rows).selectExpr("*", "1 as length", "2 as rank", "3 as piece"), PATH, 128).collect()
    tokenizer = Tokenizer.from_file(PATH)
    assert sum(r.length for r in found) == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 128
    assert packing.packed(spark.createDataFrame([], SCHEMA), PATH).count() == 0
