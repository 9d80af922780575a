"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.llm.common import in_arrow, mix, text_slices, words_of

UNKNOWN = "und"
#: Lengths of the character n-grams; a word's borders count as one character each.
LENGTHS = (2, 3, 4)
#: An n-gram enters a language's filter if it makes up this share of the language's n-grams. So at
#: most 1 / LEAST_SHARE n-grams of a language can enter, whatever the corpus holds.
LEAST_SHARE = 2e-5
#: ... and if its share is at least this part of its share in any other language.
LEAST_PART = 0.5
#: Bits of every language's filter for each n-gram in the fullest one; and hash functions.
BITS_PER_GRAM, HASHES = 12, 4
#: Text whose n-grams a task holds at once, and cells of its table of distinct ones.
SLICE_BYTES, CELL_BITS = 1 << 19, 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word index, 64-bit hash) of every n-gram of the words' letter runs, lower-cased."""
    text = "\n".join(words.to_pylist()).lower() if len(words) else ""
    # Lower-casing keeps the line breaks, and no word holds one.
    points = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), np.uint32)
    word = np.cumsum(points == 10) - 1
    letter = _letters()[points]
    code = np.where(letter, points, 0).astype(np.uint64)
    hashes, owners = [], []
    for n in LENGTHS:
        if len(points) < n:
            break
        rolled = np.full(len(points) - n + 1, n, np.uint64)
        inside = np.ones(len(rolled), bool)
        some = np.zeros(len(rolled), bool)
        for k in range(n):
            rolled = rolled * np.uint64(0x100000001B3) + code[k:k + len(rolled)]
            some |= letter[k:k + len(rolled)]
            if 0 < k < n - 1 or n == 1:
                inside &= letter[k:k + len(rolled)]
        at = np.flatnonzero(inside & some)
        hashes.append(mix(rolled[at]))
        # the word of the first letter: a leading border may be the line break of the word before
        owners.append(word[at + (~letter[at])])
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and, for every hash, its place among them.

    A table by the leading bits gives nearly all of them; the rest, where two share a cell, is sorted.
    """
    cell = (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    table = np.zeros(1 << CELL_BITS, np.uint64)
    table[cell] = hashes
    used = np.flatnonzero(table)
    place = np.zeros(1 << CELL_BITS, np.int64)
    place[used] = np.arange(len(used))
    back, values = place[cell], table[used]
    lost = np.flatnonzero(table[cell] != hashes)
    if len(lost):
        more, at = np.unique(hashes[lost], return_inverse=True)
        back[lost] = len(values) + at
        values = np.concatenate([values, more])
    return values, back


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of all texts by their language. Each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE_BYTES):
            bounds, codes, words = words_of(batch.column("text"))
            owners, hashes = grams(words)
            langs = batch.column("lang").to_pylist()
            rows = np.repeat(np.arange(len(langs)), np.diff(bounds))
            names = {name: i for i, name in enumerate(sorted({x for x in langs if x is not None}))}
            number = np.array([names.get(x, -1) for x in langs], np.int64)
            unique, back = distinct(hashes)
            for name, i in names.items():
                times = np.bincount(codes[number[rows] == i], minlength=len(words)).astype(np.int64)
                sums = np.bincount(back, times[owners], minlength=len(unique)).astype(np.int64)
                kept = sums > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * int(kept.sum())), pa.array(unique[kept].view(np.int64)), pa.array(sums[kept])],
                    ["lang", "gram", "n"],
                )

    counted = docs.select("text", "lang").filter("lang is not null and text is not null")
    return in_arrow(counted, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageFilters:
    """One Bloom filter per language, laid out so that one row of bits holds all languages."""

    names: tuple[str, ...]
    bits: np.ndarray  # (size, words of 64 languages)
    false_rates: np.ndarray  # per language, how often an absent n-gram passes

    def contained(self, hashes: np.ndarray) -> np.ndarray:
        """(n-gram, language) -> whether the language's filter holds it: the AND of HASHES rows."""
        found = None
        for k in range(HASHES):
            rows = self.bits[_slot(hashes, k, len(self.bits))]
            found = rows if found is None else found & rows
        bytes_ = np.ascontiguousarray(found).view(np.uint8).reshape(len(hashes), -1)
        return np.unpackbits(bytes_, axis=1, bitorder="little")[:, :len(self.names)]


def _slot(hashes: np.ndarray, k: int, size: int) -> np.ndarray:
    step = np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (mix(hashes + step) % np.uint64(size)).astype(np.int64)


def train(docs: DataFrame) -> LanguageFilters | None:
    """Filters from all rows of `docs` (text, lang) with a language; None if there are none.

    The n-grams that reach the driver are at most 1 / LEAST_SHARE per language.
    """
    counts = gram_counts(docs).cache()
    try:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        shares = counts.join(F.broadcast(totals), "lang").select(
            "lang", "gram", (F.col("n") / F.col("total")).alias("share")
        )
        top = shares.groupBy("gram").agg(F.max("share").alias("top")).filter(F.col("top") >= LEAST_SHARE)
        chosen = (
            shares.filter(F.col("share") >= LEAST_SHARE).join(top, "gram")
            .filter(F.col("share") >= LEAST_PART * F.col("top"))
            .groupBy("gram").agg(F.collect_set("lang").alias("langs"))
        )
        table = chosen.toPandas()
        names = tuple(sorted(r["lang"] for r in totals.collect()))
    finally:
        counts.unpersist()
    if not names:
        return None
    number = {name: i for i, name in enumerate(names)}
    sizes = np.zeros(len(names), np.int64)
    gram_of, lang_of = [], []
    for gram, langs in zip(table["gram"], table["langs"]):
        for lang in langs:
            gram_of.append(gram)
            lang_of.append(number[lang])
            sizes[number[lang]] += 1
    size = max(1024, int(sizes.max(initial=0)) * BITS_PER_GRAM)
    bits = np.zeros((size, (len(names) + 63) // 64), np.uint64)
    hashes, lang = np.array(gram_of, np.int64).view(np.uint64), np.array(lang_of, np.int64)
    for k in range(HASHES):
        np.bitwise_or.at(bits, (_slot(hashes, k, size), lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.unpackbits(bits.view(np.uint8).reshape(size, -1), axis=1, bitorder="little")[:, :len(names)].mean(axis=0)
    return LanguageFilters(names, bits, fill ** HASHES)


def identify(docs: DataFrame, filters: LanguageFilters | None) -> DataFrame:
    """`docs` with lang_pred, score and hit_share, from the text alone.

    Every n-gram of a text asks all filters at once. A language's count of hits, less the hits that
    its false positives explain, is compared with the others': the most hits win (ties: the first
    name), and the score is the winner's share of all languages' hits; hit_share is the share of the
    text's n-grams that the winner's filter holds, whatever the other languages have. Null texts and texts without
    letters give `und`, score and share 0; so does everything if no language was learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE_BYTES):
            bounds, codes, words = words_of(batch.column("text"))
            owners, hashes = grams(words)
            names = filters.names if filters else ()
            votes = np.zeros((len(words), len(names) + 1), np.int64)
            if filters:
                unique, back = distinct(hashes)
                hits = filters.contained(unique)
                for i in range(len(names)):
                    votes[:, i] = np.bincount(owners, hits[:, i][back], minlength=len(words))
            votes[:, -1] = np.bincount(owners, minlength=len(words))
            running = np.zeros((len(codes) + 1, votes.shape[1]), np.int64)
            np.cumsum(votes[codes], axis=0, out=running[1:])
            sums = running[bounds[1:]] - running[bounds[:-1]]
            asked = sums[:, -1]
            predicted, score, held = np.full(len(sums), UNKNOWN, object), np.zeros(len(sums)), np.zeros(len(sums))
            if names:
                rate = filters.false_rates
                corrected = np.maximum((sums[:, :-1] - asked[:, None] * rate) / (1 - np.minimum(rate, 0.999)), 0)
                best = corrected.argmax(axis=1)
                total = corrected.sum(axis=1)
                lettered = asked > 0
                predicted[lettered] = np.array(names, object)[best[lettered]]
                share = corrected.max(axis=1) / np.where(total > 0, total, 1)
                score = np.where(lettered, np.clip(share, 0, 1), 0.0)
                held = np.clip(corrected.max(axis=1) / np.maximum(asked, 1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(predicted.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(held, pa.float64())],
                [*batch.schema.names, "lang_pred", "score", "hit_share"],
            )

    others = [c for c in docs.columns if c not in ("lang_pred", "score", "hit_share")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    return in_arrow(docs.select(*others), run, f"{schema}, lang_pred string, score double, hit_share double")
