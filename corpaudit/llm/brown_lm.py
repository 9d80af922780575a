"""Class-based language model: exchange-clustered words, class transitions, word emissions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit.llm.common import in_arrow, stored, text_slices, word_hashes, words_of

#: Most frequent words, whose classes by exchange on the driver are the start of the rounds.
SEEDS = 1024
#: Most frequent words, whose classes are exchanged in rounds; all others then choose theirs.
CORE = 1 << 16
#: Word classes besides the class of words not seen in training and that of the end.
CLASSES = 32
UNSEEN, END = CLASSES, CLASSES + 1
TOTAL = CLASSES + 2
#: Most exchange rounds; clustering ends before when no word moves.
ROUNDS = 12
#: Rounds end when the likelihood's gain over single classes rises by less.
LEAST_RISE = 0.01
#: Entries of a word's neighbour counts: class before, TOTAL + class after, itself after itself.
LOOP = 2 * TOTAL
ENTRIES = 2 * TOTAL + 1
#: Neighbour pairs handled at once; words whose counts are one row; tasks whose counts are summed first.
PAIRS, BLOCK, TASKS = 1 << 20, 16, 256
#: Neighbours that are held, and their count; pairs of one stored row.
PAIR, TOGETHER = np.dtype([("a", np.int32), ("b", np.int32), ("n", np.int64)]), 512
#: Least number of partitions of summed counts; beyond, one for so many tokens.
PARTS, TASK_TOKENS = 8, 1 << 22
#: Most frequent words whose counts every task holds; other words' counts are joined.
HELD = 1 << 18
#: Added to every count.
DISCOUNT = 0.1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): 64-bit word hash and its count over all texts; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, codes, words = words_of(batch.column("text"))
            counts = np.bincount(codes, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word_hashes(words).view(np.int64)), pa.array(counts)], ["word", "n"]
            )

    return in_arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of every one of `own` in the sorted `hashes`, -1 where it isn't there."""
    if not len(hashes):
        return np.full(len(own), -1, np.int64)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    return np.where(hashes[at] == own, at, -1)


def _chained(codes: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(previous, own) code of every token; a text starts after an end and ends with one."""
    sizes = np.diff(bounds)
    stops = np.cumsum(sizes + 1) - 1
    own = np.full(len(codes) + len(sizes), end, np.int64)
    inner = np.ones(len(own), bool)
    inner[stops] = False
    own[inner] = codes
    previous = np.full(len(own), end, np.int64)
    previous[1:] = own[:-1]
    return previous, own


def ranks(counts: np.ndarray) -> np.ndarray:
    """Every word's place by its count, the highest first."""
    out = np.empty(len(counts), np.int64)
    out[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return out


_EDGE = ["a", "b", "n", "pairs"]


def neighbours(docs: DataFrame, held: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(a, b, n, pairs): neighbouring words of all texts, counted within slices.

    A held word is named by its rank, the end by the place after the last, all others by their hash.
    Rows with `pairs` hold up to TOGETHER of all the pairs, where the place after the end stands for every
    word that is not held; pairs with such a word are rows (a, b, n) of their own, too.
    """
    end = len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bounds, codes, words = words_of(batch.column("text"))
            names = np.append(word_hashes(words).view(np.int64), len(held))
            place = _numbers(names[:-1].view(np.uint64), held)
            inside = np.flatnonzero(place >= 0)
            names[inside] = rank[place[inside]]
            previous, own = _chained(codes, bounds, len(words))
            pairs, n = np.unique(previous * len(names) + own, return_counts=True)
            first, second = np.divmod(pairs, len(names))
            a, b, n = names[first], names[second], n.astype(np.int64)
            records = np.empty(len(n), PAIR)
            records["a"], records["b"], records["n"] = _places(a, end), _places(b, end), n
            together = [records[i:i + TOGETHER].tobytes() for i in range(0, len(records), TOGETHER)]
            nothing = pa.nulls(len(together), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array(together, pa.binary())], _EDGE)
            far = np.flatnonzero((records["a"] > end) | (records["b"] > end))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[far]), pa.array(b[far]), pa.array(n[far]), pa.nulls(len(far), pa.binary())], _EDGE
            )

    return in_arrow(docs.select("text"), run, "a long, b long, n long, pairs binary")


def _places(names: np.ndarray, end: int) -> np.ndarray:
    """Places of held words and the end; the place after it for all other words."""
    return np.minimum(names.view(np.uint64), np.uint64(end + 1)).astype(np.int64)


def _packed(edges: DataFrame) -> DataFrame:
    """All pairs, many in a row."""
    return edges.filter("pairs is not null").select("pairs")


def _far(edges: DataFrame) -> DataFrame:
    """(a, b, n) of the pairs with a word that is not held."""
    return edges.filter("pairs is null").select("a", "b", "n")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns (a, b, n) of packed pairs in blocks of at most PAIRS."""
    for whole in batches:
        for start in range(0, whole.num_rows, PAIRS // TOGETHER):
            column = whole.column("pairs").slice(start, PAIRS // TOGETHER)
            pairs = np.frombuffer(b"".join(column.to_pylist()), PAIR)
            yield tuple(np.ascontiguousarray(pairs[c]) for c in ("a", "b", "n"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns (a, b, n) in blocks of about PAIRS rows."""
    some, rows = [], 0
    for batch in batches:
        some.append([batch.column(c).to_numpy() for c in ("a", "b", "n")])
        rows += batch.num_rows
        if rows >= PAIRS:
            yield tuple(map(np.concatenate, zip(*some)))
            some, rows = [], 0
    if rows:
        yield tuple(map(np.concatenate, zip(*some)))


def seed_pairs(edges: DataFrame, seeds: int, end: int) -> np.ndarray:
    """Counts of neighbours among the `seeds` first ranks, other words and text ends.

    At most (seeds + 2)^2 sums reach the driver; they only give the rounds their start.
    """
    size = seeds + 2

    def number(names: np.ndarray) -> np.ndarray:
        return np.where(names == end, size - 1, np.minimum(names, seeds)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for a, b, n in _records(batches):
            np.add.at(total, number(a) * size + number(b), n)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], ["pair", "n"])

    sums = in_arrow(_packed(edges), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[sums["pair"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def _gain(counts: np.ndarray) -> np.ndarray:
    return counts * np.log(np.maximum(counts, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every word by the exchange algorithm; the last two items keep classes of their own.

    Words start in classes by their rank in turn. In each round every word, the most frequent first,
    moves to the class in which the class bigrams' likelihood of all of `pairs` is highest.
    """
    size = len(pairs)
    words = size - 2
    own = np.concatenate([np.arange(words) % classes, [classes, classes + 1]])
    total = classes + 2
    table = np.zeros((total, total))
    np.add.at(table, (own[:, None], own[None, :]), pairs)
    outgoing, incoming = pairs.sum(axis=1).astype(float), pairs.sum(axis=0).astype(float)
    order = np.argsort(-(outgoing + incoming)[:words], kind="stable")
    every = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for word in order:
            here = own[word]
            after = np.bincount(own, pairs[word], minlength=total)  # word -> class
            before = np.bincount(own, pairs[:, word], minlength=total)  # class -> word
            loop = float(pairs[word, word])
            after[here] -= loop
            before[here] -= loop
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= loop
            row, column = table.sum(axis=1), table.sum(axis=0)
            # change of sum n log n over the bigrams of class k when the word joins it
            change = (_gain(table[every] + after) - _gain(table[every])).sum(axis=1)
            change += (_gain(table[:, every] + before[:, None]) - _gain(table[:, every])).sum(axis=0)
            corner = table[every, every]
            change += _gain(corner + after[every] + before[every] + loop) + _gain(corner)
            change -= _gain(corner + after[every]) + _gain(corner + before[every])
            change -= _gain(row[every] + outgoing[word]) - _gain(row[every])
            change -= _gain(column[every] + incoming[word]) - _gain(column[every])
            best = int(change.argmax())
            if change[best] <= change[here] + 1e-9:
                best = here
            own[word] = best
            moved += best != here
            table[best] += after
            table[:, best] += before
            table[best, best] += loop
        if not moved:
            break
    return own


def _classes_of(names: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes of held words and the end; all other words are UNSEEN here."""
    return np.append(classes, UNSEEN)[_places(names, len(classes) - 1)]


def _totals(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """The counts of rows with equal keys summed, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in keys))
            for key, near in zip(names, batch.column("near")):
                counts = np.frombuffer(near.as_buffer(), np.int64)
                if key in sums:
                    sums[key] += counts
                else:
                    sums[key] = counts.copy()
        columns = [pa.array([key[i] for key in sums], pa.int32()) for i in range(len(keys))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in sums.values()], pa.binary())], [*keys, "near"])

    return in_arrow(rows.repartition(parts, *keys), run, ", ".join(f"{k} int" for k in keys) + ", near binary")


def _near(edges: DataFrame, classes: np.ndarray, first: int, last: int, parts: int) -> DataFrame:
    """(block, near): counts of the words of ranks `first` to `last` by the classes of their neighbours, written.

    A row holds the counts of BLOCK words, row -1 those of class after class over all pairs. Every task
    adds up its pairs in one table, so a frequent word sends no more than others; the tables of TASKS
    tasks are summed before those of all.
    """
    blocks = -(-(last - first) // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, table = np.zeros(blocks * BLOCK * ENTRIES, np.int64), np.zeros(TOTAL * TOTAL, np.int64)
        known = np.append(classes, UNSEEN)
        for a, b, n in _records(batches):
            before, after = known[a], known[b]
            np.add.at(table, before * TOTAL + after, n)
            at = np.flatnonzero((b >= first) & (b < last))
            np.add.at(sums, (b[at] - first).astype(np.int64) * ENTRIES + before[at], n[at])
            at = np.flatnonzero((a >= first) & (a < last))
            np.add.at(sums, (a[at] - first).astype(np.int64) * ENTRIES + TOTAL + after[at], n[at])
            at = at[a[at] == b[at]]
            np.add.at(sums, (a[at] - first).astype(np.int64) * ENTRIES + LOOP, n[at])
        group = TaskContext.get().partitionId() // TASKS
        rows = sums.reshape(blocks, BLOCK * ENTRIES)
        some = np.flatnonzero(rows.any(axis=1))
        for start in range(0, len(some), 256):
            part = some[start:start + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([group] * len(part), pa.int32()), pa.array([rows[i].tobytes() for i in part], pa.binary())],
                ["block", "group", "near"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([group], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["block", "group", "near"]
        )

    grouped = _totals(in_arrow(_packed(edges), run, "block int, group int, near binary"), ["block", "group"], parts)
    return stored(_totals(grouped.drop("group"), ["block"], PARTS), "near")


def best_classes(here: np.ndarray, near: pa.ListArray, table: np.ndarray) -> np.ndarray:
    """`best_of` for lists of n * ENTRIES + entry."""
    items = near.flatten().to_numpy()
    word = np.repeat(np.arange(len(here)), np.diff(near.offsets.to_numpy()))
    counts = np.bincount(word * ENTRIES + items % ENTRIES, items // ENTRIES, len(here) * ENTRIES)
    return best_of(here, counts.reshape(len(here), ENTRIES), table)


def best_of(here: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of every word in which the likelihood is highest, all other words staying.

    The change of sum n log n is that of `exchange`, summed over the classes that a word meets.
    """
    size, every = len(here), np.arange(CLASSES)
    before, after, loop = counts[:, :TOTAL].astype(float), counts[:, TOTAL:LOOP].astype(float), counts[:, LOOP]
    incoming, outgoing = before.sum(axis=1), after.sum(axis=1)
    rows = np.arange(size)
    before[rows, here] -= loop
    after[rows, here] -= loop
    is_here = every == here[:, None]
    # the words' classes without them: corners, then rows and columns where the word has counts
    corner = table[every, every] - is_here * (after[rows, here] + before[rows, here] + loop)[:, None]
    change = _gain(corner + after[:, every] + before[:, every] + loop[:, None]) + _gain(corner)
    change -= _gain(corner + after[:, every]) + _gain(corner + before[:, every])
    for own, other, lines in ((after, before, table), (before, after, table.T)):
        at, k = np.nonzero(own)
        n = own[at, k][:, None]
        base = lines[every[None, :], k[:, None]] - is_here[at] * n
        base -= (k == here[at])[:, None] * (other[at][:, every] + is_here[at] * loop[at][:, None])
        gains = _gain(base + n) - _gain(base)
        cuts = np.searchsorted(at, np.arange(size))
        some = np.flatnonzero(np.bincount(at, minlength=size))
        if len(some):
            change[some] += np.add.reduceat(gains, cuts[some], axis=0)
    for total, sums in ((outgoing, table.sum(axis=1)), (incoming, table.sum(axis=0))):
        base = sums[every] - is_here * total[:, None]
        change -= _gain(base + total[:, None]) - _gain(base)
    best = change.argmax(axis=1)
    stays = (here < CLASSES) & (change[rows, best] <= change[rows, np.minimum(here, CLASSES - 1)] + 1e-9)
    return np.where(stays, here, best)


def _class_table(near: DataFrame) -> np.ndarray:
    """Counts of class after class."""
    rows = near.filter("block = -1").collect()
    return np.frombuffer(rows[0]["near"], np.int64).reshape(TOTAL, TOTAL).astype(float) if rows else np.zeros((TOTAL, TOTAL))


def _moved(near: DataFrame, classes: np.ndarray, first: int, last: int, table: np.ndarray) -> np.ndarray:
    """`classes` with the best class against `table` of every word of ranks `first` to `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048 // BLOCK):
                batch = whole.slice(start, 2048 // BLOCK)
                counts = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.int64).reshape(-1, ENTRIES)
                words = first + (batch.column("block").to_numpy()[:, None].astype(np.int64) * BLOCK + np.arange(BLOCK)).ravel()
                some = np.flatnonzero(counts.any(axis=1) & (words < last))
                best = best_of(classes[words[some]], counts[some], table)
                yield pa.RecordBatch.from_arrays([pa.array(words[some]), pa.array(best.astype(np.int32))], ["word", "class"])

    chosen = in_arrow(near.filter("block >= 0"), run, "word long, class int").toPandas()
    out = classes.copy()
    out[chosen["word"].to_numpy(np.int64)] = chosen["class"].to_numpy(np.int64)
    return out


def _rare_classes(edges: DataFrame, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, n, class, near) of every word that is not held, by its best class against `table`, written.

    `near` counts its neighbours by class, where all that are not held are UNSEEN.
    """
    end = len(classes) - 1

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n in _blocks(batches):
            left, right = (a < 0) | (a > end), (b < 0) | (b > end)
            loop = left & (a == b)
            entries = [_classes_of(a, classes)[right], TOTAL + _classes_of(b, classes)[left], np.full(loop.sum(), LOOP, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([b[right], a[left], a[loop]])),
                    pa.array(np.concatenate(entries).astype(np.int32)), pa.array(np.concatenate([n[right], n[left], n[loop]])),
                ],
                ["word", "entry", "n"],
            )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                own = best_classes(np.full(batch.num_rows, UNSEEN), batch.column("near"), table).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], ["word", "n", "near", "class"])

    sums = in_arrow(_far(edges), sides, "word long, entry int, n long").groupBy("word", "entry").agg(F.sum("n").alias("n"))
    # each time the word occurs it has one neighbour before it
    words = sums.groupBy("word").agg(
        F.sum(F.when(F.col("entry") < TOTAL, F.col("n")).otherwise(0)).alias("n"),
        F.collect_list(F.col("n") * ENTRIES + F.col("entry")).alias("near"),
    )
    return stored(in_arrow(words, best, "word long, n long, near array<long>, class int"), "rare")


def _with_rare(table: np.ndarray, edges: DataFrame, rare: DataFrame, end: int) -> np.ndarray:
    """`table` with the pairs of words that are not held in the classes of these words, no longer in UNSEEN."""
    out = table.copy()
    out[UNSEEN], out[:, UNSEEN] = 0, 0
    entry, n = F.pmod("e", F.lit(ENTRIES)).alias("entry"), F.floor(F.col("e") / ENTRIES).alias("n")
    near = rare.select("class", F.explode("near").alias("e")).select("class", entry, n).groupBy("class", "entry")
    for row in near.agg(F.sum("n").alias("n")).collect():
        side, other = divmod(row["entry"], TOTAL)
        if side < 2 and other != UNSEEN:
            out[(other, row["class"]) if side == 0 else (row["class"], other)] += row["n"]
    both = _far(edges).filter(~F.col("a").between(0, end) & ~F.col("b").between(0, end))
    of = lambda side: rare.select(F.col("word").alias(side), F.col("class").alias(f"class_{side}"))
    pairs = both.join(of("a"), "a").join(of("b"), "b").groupBy("class_a", "class_b").agg(F.sum("n").alias("n"))
    for row in pairs.collect():
        out[row["class_a"], row["class_b"]] += row["n"]
    return out


def cluster(edges: DataFrame, start: np.ndarray, parts: int) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """(classes of the held words and the end, all other words, class table) by the exchange algorithm.

    In a round every word of the core chooses its best class against the table before the round; the
    round with the highest likelihood stays. Then all other words, which were one class until then,
    choose theirs against that table: the held ones CORE at a time, the rest by one join.
    """
    classes, end = start, len(start) - 1
    core = min(CORE, end)
    best, most = None, 0.0
    for turn in range(ROUNDS + 1):
        near = _near(edges, classes, 0, core, parts)
        table = _class_table(near)
        gain = float(_gain(table).sum() - _gain(table.sum(axis=0)).sum() - _gain(table.sum(axis=1)).sum() + _gain(table.sum()))
        rises = turn < 2 or gain > most + LEAST_RISE * abs(most)
        if turn < 2 or gain > most:  # the start leaves most words without a class of their own
            best, most = (classes, table), gain
        if not rises or not core:
            break
        classes = _moved(near, classes, 0, core, table)
    of_core, table = best
    classes = of_core.copy()
    for first in range(core, end, CORE):
        last = min(first + CORE, end)
        near = _near(edges, of_core, first, last, parts)
        classes[first:last] = _moved(near, of_core, first, last, table)[first:last]
    table = _class_table(_near(edges, classes, 0, 0, parts))
    rare = _rare_classes(edges, classes, table)
    return classes, rare, _with_rare(table, edges, rare, end)


@dataclass(frozen=True)
class ClassModel:
    tokens: int  # of training, ends included
    distinct: int  # of those tokens
    ends: int
    held: np.ndarray  # sorted hashes of the most frequent words
    held_counts: np.ndarray
    held_classes: np.ndarray  # of those words; of the end
    rare: DataFrame  # (word, n, class) of all other words
    log_transition: np.ndarray
    log_class: np.ndarray  # of the tokens of every class


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the most frequent words, at most `most`.

    Words are grouped by the size of their count, sixteen groups for each doubling, and the groups
    of the largest counts that fit are taken whole; so no task or driver sorts more.
    """
    size = F.floor(F.log2("n") * 16).cast("int")
    groups = counts.groupBy(size.alias("size")).count().collect()
    least, total = None, 0
    for row in sorted(groups, key=lambda r: -r["size"]):
        total += row["count"]
        if total > most:
            break
        least = row["size"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    top = counts.filter(size >= least).toPandas()
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(words)
    return words[order], n[order]


def train(counts: DataFrame, docs: DataFrame) -> ClassModel:
    """The model of all texts of `docs`, whose `word_counts` are `counts`."""
    ends = docs.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    held, held_counts = most_frequent(counts, HELD)
    end, rank = len(held), ranks(held_counts)
    edges = stored(neighbours(docs, held, rank), "edges")
    seeds = min(SEEDS, CORE, end)
    start = np.full(end + 1, UNSEEN, np.int64)
    start[:seeds], start[end] = exchange(seed_pairs(edges, seeds, end), CLASSES)[:-2], END
    classes, rare, table = cluster(edges, start, max(PARTS, (int(sums["n"]) + ends) // TASK_TOKENS))
    tokens = table.sum(axis=0)
    table = table + DISCOUNT
    return ClassModel(
        tokens=int(sums["n"]) + ends, distinct=int(sums["v"]) + (ends > 0), ends=ends, held=held,
        held_counts=held_counts, held_classes=np.append(classes[rank], END), rare=rare.select("word", "n", "class"),
        log_transition=np.log10(table / table.sum(axis=1, keepdims=True)), log_class=np.log10(np.maximum(tokens, 1)),
    )


_PARTS = (
    "row long, doc_id long, n_tokens long, known long, held_base double, model double, "
    "rare array<struct<word: long, times: int, near: array<int>>>, pairs array<struct<a: long, b: long>>"
)


def _looked_up(values: np.ndarray, place: Column) -> Column:
    """values[place]; the values are one constant of the query."""
    constant = F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>")
    return F.get(constant, place)


def _grouped(items: np.ndarray, size: int) -> pa.Array:
    """Offsets of the lists 0 to size - 1, whose sorted places are `items`."""
    return pa.array(np.searchsorted(items, np.arange(size + 1)).astype(np.int32))


def score(docs: DataFrame, model: ClassModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every text (null: empty).

    Tasks hold counts and classes of the most frequent words; those of all others come by a join, after
    which each text needs one more sum. Row numbers are written before they are joined, so a lost
    task can't change them. A word not seen in training is the only one of its class.
    """
    floor = np.log10(model.tokens + DISCOUNT * (model.distinct + 1)) if model.tokens else 0.0
    held_logs = np.log10(model.held_counts + DISCOUNT)
    held_emits = np.log10(np.maximum(model.held_counts, 1)) - model.log_class[model.held_classes[:-1]]
    end_log = float(np.log10(model.ends + DISCOUNT))
    held, held_classes, log_transition, has_ends = model.held, model.held_classes, model.log_transition, model.ends > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches):
            bounds, codes, words = words_of(batch.column("text"))
            n = len(bounds) - 1
            hashes = word_hashes(words).view(np.int64)
            place = _numbers(hashes.view(np.uint64), held)
            is_held = place >= 0
            at = np.maximum(place, 0)
            of_held = lambda values: np.where(is_held, values[at], 0.0) if len(held) else np.zeros(len(words))
            classes = np.where(is_held, held_classes[at], -1)
            previous, own = _chained(classes[codes], bounds, END)
            steps = np.where((previous >= 0) & (own >= 0), log_transition[previous, own], 0.0)
            summed = lambda values: np.concatenate([[0.0], np.cumsum(values)])
            running, emits = summed(of_held(held_logs)[codes]), summed(of_held(held_emits)[codes])
            known = np.concatenate([[0], np.cumsum(is_held[codes])])
            chain = summed(steps)
            ends = bounds + np.arange(n + 1)
            part = lambda sums, at: sums[at[1:]] - sums[at[:-1]]
            owner = np.repeat(np.arange(n), np.diff(bounds))
            # words that are not held: their classes before and after where these are held
            far = np.flatnonzero(~is_held[codes])
            key, item, times = np.unique(
                owner[far] * np.int64(max(1, len(words))) + codes[far], return_inverse=True, return_counts=True
            )
            owners, word = np.divmod(key, max(1, len(words)))
            spot = far + owner[far]  # among the steps, where every text has one more
            left, right = previous[spot], own[spot + 1]
            items = np.concatenate([item[left >= 0], item[right >= 0]])
            near = np.concatenate([left[left >= 0], TOTAL + right[right >= 0]])
            order = np.argsort(items, kind="stable")
            near_lists = pa.ListArray.from_arrays(_grouped(items[order], len(key)), pa.array(near[order].astype(np.int32)))
            rare = pa.ListArray.from_arrays(
                _grouped(owners, n),
                pa.StructArray.from_arrays(
                    [pa.array(hashes[word]), pa.array(times.astype(np.int32)), near_lists], ["word", "times", "near"]
                ),
            )
            second = far[left < 0]
            pairs = pa.ListArray.from_arrays(
                _grouped(owner[second], n),
                pa.StructArray.from_arrays(
                    [pa.array(hashes[codes[second - 1]]), pa.array(hashes[codes[second]])], ["a", "b"]
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)), batch.column("doc_id"), pa.array(np.diff(bounds) + 1),
                    pa.array(part(known, bounds) + has_ends), pa.array(part(running, bounds) + end_log),
                    pa.array(part(chain, ends) + part(emits, bounds)), rare, pairs,
                ],
                ["row", "doc_id", "n_tokens", "known", "held_base", "model", "rare", "pairs"],
            )
            row += n

    parts = stored(in_arrow(docs.select("doc_id", "text"), run, _PARTS), "parts")
    found = parts.select("row", F.inline("rare")).join(model.rare, "word", "left")
    own = F.coalesce("class", F.lit(UNSEEN))
    log: Column = F.log10(F.coalesce("n", F.lit(0)) + F.lit(DISCOUNT)) * F.col("times")
    emits = F.when(F.col("n").isNotNull(), (F.log10("n") - _looked_up(model.log_class, own)) * F.col("times")).otherwise(0.0)
    around = np.hstack([model.log_transition.T, model.log_transition])  # of a class: before it, after it
    steps = F.aggregate("near", F.lit(0.0), lambda done, e: done + _looked_up(around, own * LOOP + e))
    sums = found.groupBy("row").agg(
        F.sum(log).alias("far"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("far_known"),
        F.sum(emits + steps).alias("far_model"),
    )
    first = model.rare.select(F.col("word").alias("a"), F.col("class").alias("class_a"))
    other = model.rare.select(F.col("word").alias("b"), F.col("class").alias("class_b"))
    pairs = parts.select("row", F.inline("pairs")).join(first, "a", "left").join(other, "b", "left")
    place = F.coalesce("class_a", F.lit(UNSEEN)) * TOTAL + F.coalesce("class_b", F.lit(UNSEEN))
    chains = pairs.groupBy("row").agg(F.sum(_looked_up(model.log_transition, place)).alias("chained"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return parts.drop("rare", "pairs").join(sums, "row", "left").join(chains, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        (F.col("held_base") + zero("far") - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"),
        (F.col("model") + zero("far_model") + zero("chained")).alias("score"),
    )


def score_by_classes(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Scores of all rows of `docs` by the class model of `training` (both doc_id, text); also
    train_tokens. An empty training table leaves only the discounts; repeated rows are scored each;
    texts of any length are whole; other columns are not read.
    """
    texts = training.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(texts), "counts")
    model = train(counts, texts)
    return score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
