"""A chain over shapes and words of tokens (`pii`), scored over whole texts by tables instead of strings.

The features are those of `pii._features`: a token's score is a sum of rows that its shape, its word and those
of its neighbours pick. So every token of every text is scored, and the best labels of a text are those of a
Viterbi pass over all of it; the pass is run only where the label O is not already proven, see `Field.labels`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from corpaudit.llm.crf import Chain

#: Characters made into tokens at once (to the next white space), and tokens scored at once.
BLOCK_CHARS, BLOCK_TOKENS = 1 << 20, 1 << 14
#: Characters of the texts, and tokens of these that are decoded at once; a longer one is decoded alone.
GROUP_CHARS, DECODED_TOKENS = 4 << 20, 1 << 19
#: Neighbours that a token's features look at, on either side; longest word that is told apart.
REACH, WORD_CHARS = 3, 11
#: Rounds of proofs; any number gives the same labels.
PROOFS = 4
#: What a proof of a label must have above a tie, for sums that are rounded.
SURE = 1e-6
LETTER, DIGIT, OTHER_DIGIT, MARK = 1, 2, 3, 4
LOWER, UPPER, TITLE = 1, 2, 4
_POWERS = np.random.default_rng(1).integers(1, 1 << 63, WORD_CHARS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, ...]:
    """By code point: its part in a token, its case, its lower case, and what a token that starts with it is."""
    every = "".join(map(chr, range(0x110000)))
    kind, case, start = (np.zeros(len(every), np.uint8) for _ in range(3))
    for code, pattern in ((LETTER, r"[^\W\d_]+"), (DIGIT, "[0-9]+"), (OTHER_DIGIT, r"[^\D0-9]+"), (MARK, r"[^\w\s]+|_")):
        for found in re.finditer(pattern, every):
            kind[found.start():found.end()] = code
    lower = np.where(kind > 0, np.arange(len(every)), 0).astype(np.uint64)
    for i in np.flatnonzero((kind > 0) & (kind < MARK)).tolist():
        c = every[i]
        case[i] = LOWER if c.islower() else UPPER if c.isupper() else TITLE if c.istitle() else 0
        start[i] = DIGIT if c.isdigit() else LETTER if c.isalpha() else 0
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    return kind, case, lower, start


def _hashed(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What a character adds to the hash of its word; what stands beyond WORD_CHARS is never compared."""
    return codes * _POWERS[np.minimum(offsets, WORD_CHARS)]


def tokens(text: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Starts, lengths, first characters, cases and hashes of the tokens of a text, piece by piece.

    The tokens are those of `pii._TOKEN`: runs of letters, runs of digits, single marks.
    """
    kinds, cases, lowers, _ = _characters()
    space, begin = re.compile(r"\s"), 0
    while begin < len(text):
        found = space.search(text, begin + BLOCK_CHARS)
        end = found.start() if found else len(text)
        codes = np.frombuffer(text[begin:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, place = kinds[codes], np.arange(len(codes), dtype=np.int64)
        before = np.concatenate([[np.uint8(0)], kind[:-1]])
        starts = (kind > 0) & (kind != before) | (kind == MARK)
        if (kind == OTHER_DIGIT).any():
            # after the first digit that is not 0 to 9, any digit goes on with the run
            digit = (kind == DIGIT) | (kind == OTHER_DIGIT)
            first = digit & (before != DIGIT) & (before != OTHER_DIGIT)
            run = np.maximum.accumulate(np.where(first, place, 0))
            last = np.maximum.accumulate(np.where(kind == OTHER_DIGIT, place, -1))
            starts &= ~(digit & ~first & (np.concatenate([[-1], last[:-1]]) >= run))
        at = np.flatnonzero(starts)
        if len(at):
            offsets = place - np.maximum.accumulate(np.where(starts, place, 0))
            yield (
                at + begin, np.add.reduceat((kind > 0).astype(np.int64), at), codes[at],
                np.bitwise_or.reduceat(cases[codes], at), np.add.reduceat(_hashed(lowers[codes], offsets), at),
            )
        begin = end


class Field:
    """Tables of a chain: what a shape, a word and those of the neighbours add to a token's scores."""

    def __init__(self, chain: Chain):
        self.chain, known = chain, chain.features
        nothing = np.zeros(len(chain.labels))

        def row(name: str) -> np.ndarray:
            return chain.emission[known[name]] if name in known else nothing

        shapes = [n[2:] for n in known if n.startswith("s=") and not re.search(r",(True|False),(True|False)$", n)]
        # the shape beyond a text's ends is a known one; the last of each list stands for all unknown ones
        self.shapes = [*dict.fromkeys([*shapes, "#"]), None]
        words = [n[2:] for n in known if n.startswith("w=")]
        place = {s: i for i, s in enumerate(self.shapes)}
        self.edge, self.unknown = place["#"], len(self.shapes) - 1
        glue = (False, True)
        self.own = np.array([
            row(f"s={s}") + row(f"l={a}") + row(f"r={b}") + row(f"s={s},{a},{b}") for s in self.shapes for a in glue for b in glue
        ])
        self.near = {
            d: np.array([row(f"s{d}={n}") + row(f"s{d}={n},s={s}") for n in self.shapes for s in self.shapes])
            for d in range(-REACH, REACH + 1) if d
        }
        self.words = {d: np.array([row(f"w{d}={w}" if d else f"w={w}") for w in words] + [nothing]) for d in range(-2, 3)}
        self.no_word, self.long_word = len(words), words.index("") if "" in words else len(words)
        # shapes of runs by case and of numbers by length, of single marks by code point
        self.letters = np.full((8, 2), self.unknown)
        for flags in range(8):
            case = "x" if flags == LOWER else "X" if flags == UPPER else "Xx"
            self.letters[flags] = [place.get(case, self.unknown), place.get(case + "1", self.unknown)]
        self.numbers = np.array([place.get(f"9*{n}", self.unknown) for n in range(10)])
        self.marks = np.full(0x110000, self.unknown, np.int16)
        for shape, i in place.items():
            if shape is not None and len(shape) == 1:
                self.marks[ord(shape)] = i
        by_hash = {}
        for i, word in enumerate(words):
            if word:
                codes = np.array([ord(c) for c in word], np.uint64)
                by_hash[int(_hashed(codes, np.arange(len(codes))).sum(dtype=np.uint64))] = i
        self.hashes = np.array(sorted(by_hash), np.uint64)
        self.hashed = np.array([by_hash[h] for h in sorted(by_hash)], np.int64)
        # the most that a label may gain on O by the label before and by that after it
        steps, first = chain.transition, chain.first
        o = self.o = chain.labels.index("O")
        self.bits = 1 << np.arange(len(first))
        sets = (np.arange(1 << len(first))[:, None] >> np.arange(len(first)) & 1).astype(bool)
        after, ahead = steps - steps[:, [o]], (steps - steps[o]).T
        # by the set of labels that the neighbour may have, as bits; the empty set is an end of the text
        self.after, self.ahead = (np.where(sets[:, :, None], g, -np.inf).max(axis=1) for g in (after, ahead))
        self.after[0], self.ahead[0] = first - first[o], 0
        self.gain = self.after[[0, -1]].max(axis=0) + self.ahead[[0, -1]].max(axis=0) + SURE

    def _coded(self, lengths: np.ndarray, firsts: np.ndarray, cases: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens' shapes and words."""
        start = _characters()[3][firsts]
        shape = np.where(lengths == 1, self.marks[firsts], self.unknown)
        shape = np.where(start == LETTER, self.letters[cases, (lengths == 1).astype(np.int64)], shape)
        shape = np.where(start == DIGIT, self.numbers[np.minimum(lengths, 9)], shape)
        if not len(self.hashes):
            word = np.full(len(lengths), self.no_word)
        else:
            found = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            word = np.where(self.hashes[found] == hashes, self.hashed[found], self.no_word)
        return shape.astype(np.int16), np.where(lengths > WORD_CHARS, self.long_word, word).astype(np.int16)

    def labels(self, texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, numbers, starts, ends, labels) of the tokens that are not O; texts without any are left out.

        The labels are those of the best path over all tokens of the text. Where O beats a label by more than
        that label can gain by any two neighbours (or at an end of the text), no best path has the label; the
        labels that are left make the next such proof stronger. A token with O alone parts the path, and what
        is between such tokens is decoded.
        """
        group, size = [], 0
        for i, text in enumerate(texts):
            if group and size + len(text) > GROUP_CHARS:
                yield from self._labels(group)
                group, size = [], 0
            group.append((i, text))
            size += len(text) + 1
        if group:
            yield from self._labels(group)

    def _labels(self, group: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        bounds = np.cumsum([0, *[len(t) + 1 for _, t in group]])
        pieces = []
        for starts, lengths, *rest in tokens("\n".join(t for _, t in group)):
            pieces.append((starts, lengths, *self._coded(lengths, *rest)))
        if not pieces:
            return
        starts, lengths, shape, word = (np.concatenate(p) for p in zip(*pieces))
        owner = np.searchsorted(bounds, starts, "right") - 1
        # tokens with REACH places beyond both ends of every text, so that neighbours are a shift
        to = np.arange(len(starts)) + REACH * (owner + 1)
        size = len(starts) + REACH * (len(group) + 1)
        shapes, words, real = np.full(size, self.edge, np.int64), np.full(size, self.no_word, np.int16), np.zeros(size, bool)
        shapes[to], words[to], real[to] = shape, word, True
        glued = np.zeros(size + 1, np.int64)
        glued[to[1:]] = starts[1:] == starts[:-1] + lengths[:-1]
        left = np.zeros(size, np.int16)
        left[to] = 1 << self.o
        unsure = to
        for round_ in range(PROOFS):
            kept = []
            for at in _blocks(unsure):
                block = self._scores(shapes, words, glued, at)
                gain = self.after[left[at - 1]] + self.ahead[left[at + 1]] + SURE if round_ else self.gain
                possible = block - block[:, [self.o]] + gain > 0
                possible[:, self.o] = True
                kept.append(possible @ self.bits)
            left[unsure] = np.concatenate(kept)
            unsure = unsure[left[unsure] != 1 << self.o]
            if not len(unsure):
                return
        # with each token that may be other than O go its neighbours, between which its labels are the best
        taken = np.zeros(size, bool)
        for d in (-1, 0, 1):
            taken[unsure + d] = True
        chosen = np.flatnonzero(taken[to])
        cuts = np.flatnonzero(np.diff(to[chosen]) > 1) + 1
        lengths_of_runs = np.diff(np.concatenate([[0], cuts, [len(chosen)]]))
        tags = np.full(len(to), self.o, np.int16)
        ends = np.cumsum(lengths_of_runs)
        low = 0
        while low < len(ends):
            begin = ends[low] - lengths_of_runs[low]
            high = max(low + 1, int(np.searchsorted(ends, begin + DECODED_TOKENS, "right")))
            at = chosen[begin:ends[high - 1]]
            scores = np.concatenate([self._scores(shapes, words, glued, part) for part in _blocks(to[at])])
            scores[left[to[at]][:, None] & self.bits == 0] = -np.inf
            tags[at] = self.chain.decode(scores, lengths_of_runs[low:high])
            low = high
        for number in np.unique(owner[tags != self.o]).tolist():
            a, b = np.searchsorted(owner, [number, number + 1])
            told = np.flatnonzero(tags[a:b] != self.o) + a
            begins = starts[told] - bounds[number]
            yield group[number][0], told - a, begins, begins + lengths[told], tags[told]

    def _scores(self, shapes: np.ndarray, words: np.ndarray, glued: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(token, label) scores at some places."""
        own = shapes[at]
        out = self.own.take(own * 4 + glued[at] * 2 + glued[at + 1], axis=0)
        for d, table in self.near.items():
            out += table.take(shapes[at + d] * len(self.shapes) + own, axis=0)
        for d, table in self.words.items():
            near = words[at + d]
            known = np.flatnonzero(near != self.no_word)
            out[known] += table.take(near[known], axis=0)
        return out


def _blocks(places: np.ndarray) -> Iterator[np.ndarray]:
    for low in range(0, len(places), BLOCK_TOKENS):
        yield places[low:low + BLOCK_TOKENS]
