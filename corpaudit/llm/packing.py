"""Best-fit packing of tokenized documents into fixed sequences by bin completion."""

from __future__ import annotations

import json
import logging
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.llm.common import in_arrow, numbered, stored, text_slices

#: Steps of the search for a packing with fewer sequences than the incumbent; below MIN_STEPS it is not begun anew.
SEARCH_STEPS, MIN_STEPS = 400_000, 1_000
#: Steps for one filling of the first descent, and completions among which the best comes first.
DIVE_STEPS, WIDTH = 2_000, 24
#: Fixed value: how byte-level tokenizers of this kind split text.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Text tokenized at once; larger slices repeat more words.
TOKEN_SLICE_BYTES = 3 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLAIN_CHUNK = r"^ ([!-~\x{a1}-\x{24f}]|[!-~\x{a1}-\x{24f}][\t-\r!-~\x{a1}-\x{24f}]*[!-~\x{a1}-\x{24f}])$"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, and a faster encoder over its vocabulary for text up to Latin Extended-B.

    The encoder is there only if the file is a byte-level BPE whose merges stand in id order, for
    which merging by rank is the same; else it is None.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    kind, model = parts.get("pre_tokenizer") or {}, parts["model"]
    if parts.get("normalizer") or model.get("type") != "BPE" or kind.get("type") != "ByteLevel":
        return tokenizer, None, None
    if kind.get("add_prefix_space") or not kind.get("use_regex", True):
        return tokenizer, None, None
    printable = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and not 0x7F <= b <= 0xA0 and b != 0xAD]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in parts.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(set(t) - byte_of.keys() for t in vocabulary) or merged != sorted(merged):
        return tokenizer, None, None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
    encoder = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tokenizer, encoder, sizes


def _chunk_ids(path: str, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the chunks in a row, and the number of ids of each chunk.

    Chunks that start with at most one space and hold no other white space at their ends are encoded
    joined: the tokenizer splits between them, so the ids fall apart again at their byte borders.
    """
    tokenizer, encoder, token_bytes = _tokenizer(path)
    plain = np.zeros(len(chunks), bool)
    if encoder is not None and len(chunks):
        plain = pc.match_substring_regex(chunks, _PLAIN_CHUNK).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(chunks), np.int64)
    found: dict[int, np.ndarray] = {}
    joined = np.empty(0, np.uint32)
    if plain.any():
        some = chunks.filter(pa.array(plain))
        joined = encoder.encode_to_numpy(_characters(some).tobytes().decode(), allowed_special=set(), disallowed_special=())
        ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64))
        place = np.searchsorted(np.cumsum(token_bytes[joined]), ends, side="right")
        counts[plain] = np.diff(place, prepend=0)
    rest = np.flatnonzero(~plain)
    for i, e in zip(rest.tolist(), tokenizer.encode_batch_fast(chunks.take(pa.array(rest)).to_pylist(), add_special_tokens=False)):
        found[i] = np.array(e.ids, np.uint32)
        counts[i] = len(found[i])
    if not found:
        return joined, counts
    flat = np.empty(int(counts.sum()), np.uint32)
    of_plain = np.repeat(plain, counts)
    flat[of_plain] = joined
    flat[~of_plain] = np.concatenate([found[i] for i in rest.tolist()])
    return flat, counts


def _characters(texts: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of all texts in a row."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)


def _uneven(texts: pa.Array) -> np.ndarray:
    """Which texts have a space beside other white space, or white space beyond ASCII (none is null)."""
    data = _characters(texts)
    if len(data) < 2:
        return np.zeros(len(texts), bool)
    space = data == 0x20
    white = space | ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    odd = (space[:-1] & white[1:]) | (white[:-1] & space[1:])
    # lead bytes of U+0085 and U+00A0, of U+1680, and of U+2000-U+3000
    wide = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)) | (data[:-1] >= 0xE1) & (data[:-1] <= 0xE3)
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, np.flatnonzero(odd | wide), side="right")] = True
    return out


def token_ids(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of every text (null: none), as the tokenizer gives them for the whole text.

    A byte-level tokenizer never joins characters across a single space between two other
    characters, so texts are cut there and every distinct piece is encoded once. Texts with a space
    beside other white space are encoded whole.
    """
    texts = pc.fill_null(texts, "")
    uneven = _uneven(texts)
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    rows = np.flatnonzero(uneven)
    if len(rows):
        tokenizer = _tokenizer(path)[0]
        for row, e in zip(rows, tokenizer.encode_batch_fast([texts[int(r)].as_py() for r in rows], add_special_tokens=False)):
            out[row] = np.array(e.ids, np.uint32)
    rows = np.flatnonzero(~uneven)
    if not len(rows):
        return out
    split = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(len(codes), bool)
    first[offsets[:-1]] = True  # every text has a first chunk, without a space before it
    words = coded.dictionary
    later = np.flatnonzero(np.bincount(codes[~first], minlength=len(words)))
    heads = np.flatnonzero(np.bincount(codes[first], minlength=len(words)))
    spaced = pc.binary_join_element_wise(pa.scalar(""), words.take(pa.array(later)), " ")
    flat, sizes = _chunk_ids(path, spaced)
    flat_heads, sizes_heads = _chunk_ids(path, words.take(pa.array(heads)))
    place, place_first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    place[later], place_first[heads] = np.arange(len(later)), len(later) + np.arange(len(heads))
    slot = np.where(first, place_first[codes], place[codes])
    flat, sizes = np.concatenate([flat, flat_heads]), np.concatenate([sizes, sizes_heads])
    begins = np.cumsum(sizes) - sizes
    counts = sizes[slot]
    ends = np.cumsum(counts)
    ids = flat[np.repeat(begins[slot] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
    borders = np.concatenate([[0], ends])[offsets]
    for i, row in enumerate(rows):
        out[row] = ids[borders[i]:borders[i + 1]]
    return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, head if head and s == 0 else capacity) for s in starts]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of every document: its token ids and `end_id`, cut when longer than `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=TOKEN_SLICE_BYTES):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_ids(batch.column("text"), tokenizer_path)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return in_arrow(docs.select("doc_id", "text"), run, PIECES)


#: Lengths of one sequence, largest first, as (length, copies).
Filling = tuple[tuple[int, int], ...]


class Plan(NamedTuple):
    """Fillings with the number of sequences that have them; no packing has fewer than `least` sequences."""

    fillings: list[tuple[Filling, int]]
    least: int

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.fillings)


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound: the summed lengths, and for every threshold the long ones with what must stand beside them."""
    sizes = sorted(histogram)
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    half = [n for n in sizes if 2 * n > capacity]
    for k in [0, *(n for n in sizes if 2 * n <= capacity)]:
        alone = sum(histogram[n] for n in half if n > capacity - k)
        shared = [n for n in half if n <= capacity - k]
        room = sum((capacity - n) * histogram[n] for n in shared)
        small = sum(n * histogram[n] for n in sizes if k <= n and 2 * n <= capacity)
        least = max(least, alone + sum(histogram[n] for n in shared) + max(0, -(-(small - room) // capacity)))
    return least


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: each length, largest first, goes where least space is left."""
    groups: dict[int, dict[Filling, int]] = {}
    for length in sorted(histogram, reverse=True):
        waiting = histogram[length]
        for space in sorted(s for s in groups if s >= length):
            for filling, bins in list(groups[space].items()):
                copies = space // length
                full = min(bins, waiting // copies)
                rest = waiting - full * copies if full < bins else 0
                for times, taken in ((full, copies), (1 if rest else 0, rest)):
                    if times:
                        after = groups.setdefault(space - taken * length, {})
                        longer = (*filling, (length, taken))
                        after[longer] = after.get(longer, 0) + times
                        waiting -= times * taken
                        groups[space][filling] -= times
                if not groups[space][filling]:
                    del groups[space][filling]
                if not waiting:
                    break
            if not waiting:
                break
        copies = capacity // length
        for times, taken in ((waiting // copies, copies), (1 if waiting % copies else 0, waiting % copies)):
            if times:
                new = groups.setdefault(capacity - taken * length, {})
                new[((length, taken),)] = new.get(((length, taken),), 0) + times
    return [(filling, times) for found in groups.values() for filling, times in found.items()]


class _Search:
    """Branch and bound over sequences: the largest length left opens one, its completions are the branches."""

    def __init__(self, histogram: dict[int, int], capacity: int, steps: int):
        self.counts = dict(histogram)
        self.capacity = capacity
        self.steps = steps
        self.lengths = sorted(histogram)
        self.total = sum(n * c for n, c in histogram.items())

    def take(self, filling: Filling, times: int) -> None:
        for length, n in filling:
            self.counts[length] -= n * times
            if not self.counts[length]:
                del self.lengths[bisect_left(self.lengths, length)]

    def give_back(self, filling: Filling, times: int) -> None:
        for length, n in filling:
            if not self.counts[length]:
                insort(self.lengths, length)
            self.counts[length] += n * times

    def _dominated(self, filling: Filling, waste: int) -> bool:
        """Whether a length that is left could replace one or two of the filling that sum up to no more."""
        sizes = [length for length, n in filling for _ in range(min(n, 2))]
        sums = {x for x, _ in filling} | {x + y for i, x in enumerate(sizes) for y in sizes[i + 1:]}
        pairs = {x + y for i, x in enumerate(sizes) for y in sizes[i + 1:]}
        used = dict(filling)
        for s in sums:
            # one length is replaced by a larger one only, two of them also by one as long
            at = bisect_left(self.lengths, s if s in pairs else s + 1)
            while at < len(self.lengths) and self.lengths[at] <= s + waste:
                if self.counts[self.lengths[at]] > used.get(self.lengths[at], 0):
                    return True
                at += 1
        return False

    def completions(self, largest: int, waste: int) -> Iterator[tuple[int, Filling]]:
        """Undominated fillings around the largest length that waste no more than told, large lengths first."""
        mass = [0]
        for length in self.lengths:
            mass.append(mass[-1] + length * (self.counts[length] - (length == largest)))

        def walk(space: int, upto: int) -> Iterator[tuple[int, Filling]]:
            self.steps -= 1
            fits = bisect_right(self.lengths, space, 0, upto)
            if fits == 0 or self.steps <= 0:
                if space <= waste:
                    yield space, ()
                return
            for at in range(fits - 1, -1, -1):
                if space - mass[at + 1] > waste:
                    break  # all that is left below cannot fill the space
                length = self.lengths[at]
                copies = min(self.counts[length] - (length == largest), space // length)
                for n in range(copies, 0, -1):
                    for left, tail in walk(space - n * length, at):
                        yield left, ((length, n), *tail)
                        if self.steps <= 0:
                            return
                    if n * length == space:
                        return  # an exact fit dominates every split of the space
            if space <= waste:
                yield space, ()

        for left, rest in walk(self.capacity - largest, len(self.lengths)):
            joined = dict(rest)
            joined[largest] = joined.get(largest, 0) + 1
            filling = tuple(sorted(joined.items(), reverse=True))
            if not left or not self._dominated(filling, left):
                yield left, filling

    def branches(self, largest: int, waste: int, barred: frozenset) -> Iterator[tuple[int, Filling]]:
        """Completions, the best of the first WIDTH ones first."""
        found = self.completions(largest, waste)
        some = []
        for left, filling in found:
            if filling not in barred:
                some.append((left, filling))
                if not left or len(some) == WIDTH:
                    break
        yield from sorted(some, key=lambda f: f[0])
        yield from ((left, filling) for left, filling in found if filling not in barred)

    def most(self, filling: Filling) -> int:
        return min(self.counts[length] // n for length, n in filling)

    def dive(self) -> list[tuple[Filling, int]]:
        """The first descent: every sequence gets its best filling among the first ones, as often as it can."""
        out = []
        while self.lengths:
            budget, self.steps = self.steps, DIVE_STEPS
            best = min(islice(self.completions(self.lengths[-1], self.capacity), WIDTH), key=lambda f: f[0], default=None)
            self.steps = budget
            filling = best[1] if best else ((self.lengths[-1], 1),)
            times = self.most(filling)
            self.take(filling, times)
            out.append((filling, times))
        for filling, times in out:
            self.give_back(filling, times)
        return out

    def within(self, sequences: int) -> list[tuple[Filling, int]] | None:
        """A packing into at most so many sequences; None if there is none or the steps are used up."""
        waste = sequences * self.capacity - self.total
        path: list[tuple[Filling, int, int]] = []
        tried: list[set[Filling]] = [set()]

        def options(barred: frozenset) -> Iterator[tuple[Filling, int, int]]:
            for left, filling in self.branches(self.lengths[-1], waste, barred):
                tried[-1].add(filling)
                most = self.most(filling)
                if left:
                    most = min(most, waste // left)
                for times in range(most, 0, -1):
                    yield filling, times, left * times

        levels = [options(frozenset())]
        while levels:
            if self.steps <= 0:
                return None
            step = next(levels[-1], None)
            if step is None:
                levels.pop()
                tried.pop()
                if path:
                    filling, times, lost = path.pop()
                    self.give_back(filling, times)
                    waste += lost
                continue
            filling, times, lost = step
            self.take(filling, times)
            waste -= lost
            path.append(step)
            if not self.lengths:
                return [(f, t) for f, t, _ in path]
            # the same largest length again: fillings looked at above would come in another order only
            same = self.lengths[-1] == filling[0][0]
            barred = frozenset(tried[-1]) if same else frozenset()
            tried.append(set(barred))
            levels.append(options(barred))
        return None


def plan(histogram: dict[int, int], capacity: int, steps: int = SEARCH_STEPS) -> Plan:
    """Fillings that use up the histogram {length: count}, in as few sequences as the search finds.

    Best-fit decreasing and a first descent through the completions are the incumbents. While the better
    one has more sequences than the lower bound, bin completion looks for a packing with fewer: the
    largest length left opens a sequence, undominated completions are its branches, and a branch ends
    when its waste exceeds what the number of sequences allows. The search takes `steps` at most, after
    which the incumbent stands; Plan.least then tells how far it can be from the best. Equal lengths are
    taken in one step, so the work depends on the number of distinct lengths, at most `capacity`.
    """
    known = {length: n for length, n in histogram.items() if n > 0}
    if not known:
        return Plan([], 0)
    least = least_sequences(known, capacity)
    best = best_fit(known, capacity)
    search = _Search(known, capacity, steps)
    if sum(t for _, t in best) > least:
        best = min(search.dive(), best, key=lambda f: sum(t for _, t in f))
    wanted = least
    while wanted < sum(t for _, t in best) and search.steps > 0:
        # a share of the steps for each number of sequences, the rest for the last one
        spare, search.steps = search.steps // 2, search.steps - search.steps // 2
        fresh = _Search(known, capacity, search.steps)
        found = fresh.within(wanted)
        if found is not None:
            best = found
            break
        search.steps = fresh.steps + spare
        if fresh.steps > 0:
            least = wanted + 1  # the whole tree was seen
        wanted += 1
        if spare < MIN_STEPS:
            break
    return Plan(best, min(least, sum(t for _, t in best)))


def pack(pieces: DataFrame, capacity: int, steps: int = SEARCH_STEPS) -> DataFrame:
    """`pieces` with sequence_id and offset.

    Only the histogram of lengths (at most `capacity` rows) reaches the driver. Every piece is
    numbered within its length, without holding a frequent length in one task, and takes the slot
    of that number. Equal pieces are interchangeable. An empty table stays empty.
    """
    rows = pieces.groupBy("length").count().collect()
    filled = plan({r["length"]: r["count"] for r in rows}, capacity, steps)
    logging.getLogger(__name__).info("%d sequences, at least %d are needed", filled.sequences, filled.least)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for filling, times in filled.fillings:
        offset = 0
        for length, copies in filling:
            slots.setdefault(length, []).append((times, copies, base, offset))
            offset += length * copies
        base += times
    starts = {}
    for length, entries in slots.items():
        times, copies, bases, offsets = (np.array(x, np.int64) for x in zip(*entries))
        starts[length] = (np.cumsum(times * copies) - times * copies, copies, bases, offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                begin, copies, bases, offsets = starts[int(length)]
                entry = np.searchsorted(begin, ranks[at], side="right") - 1
                place = ranks[at] - begin[entry]
                sequence[at] = bases[entry] + place // copies[entry]
                offset[at] = offsets[entry] + place % copies[entry] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = numbered(pieces, ["length"], order, F.struct(*order), sum(r["count"] for r in rows))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return in_arrow(ranked, run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of every document: ids tokenized once, packed by `pack`.

    A null or empty text is the end token alone; a document of any length is cut whole; repeated
    rows are packed each; null ids stay null; other columns are not read.
    """
    return pack(stored(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
