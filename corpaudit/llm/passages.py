"""Exact removal of long repeated passages by prefix-free parsing of the corpus.

Rolling-hash triggers cut every text into phrases: the starts whose `LENGTH`-byte strings share a
trigger form one phrase, so every such string lies in exactly one phrase and equal strings lie at
equal distances from equal triggers. The dictionary of distinct phrases then decides most of it: a
phrase that occurs again repeats as a whole, and one whose trigger is unlike all others' repeats
nowhere. Only what is left, distinct phrases around equal triggers, is compared string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.llm.common import in_arrow, mix, stored, text_slices
from corpaudit.llm.jaccard import node_of

LENGTH = 400
#: Bytes of a trigger.
TRIGGER = 32
#: Distinct phrases around one trigger that a task compares; more are compared by the cluster.
TOGETHER = 20_000
#: Bytes of text that a task hashes at once; its tables take about 130 times as much.
HASHED_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        power = np.full(size, np.uint64(base))
        power[:1] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return out[0], out[1]


class Rolling:
    """Hashes of all substrings of a row of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        size = 1 << max(16, int(len(data)).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each text starts and the last one ends."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    row = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return row, offsets - offsets[0]


def phrases(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text, first start, last start, trigger) of every phrase of the texts in `data`.

    The trigger of a start is the least rolling hash within its string, the first one of equals. The
    phrase reaches from the first start to `length` bytes from the last.
    """
    rolling = Rolling(data)
    wide = length - min(TRIGGER, length) + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return rolling, none, none, none, none
    hashes = rolling.every(length - wide + 1)
    least = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        rest = wide - span
        least = np.minimum(least[:-rest], least[rest:])
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(len(trigger)), side="right") - 1 if len(bounds) < 64 else np.repeat(
        np.arange(len(bounds) - 1), np.diff(bounds))[:len(trigger)]
    starts = np.flatnonzero(np.arange(len(trigger)) + length <= bounds[text + 1])
    if not len(starts):
        return rolling, none, none, none, none
    own, of = trigger[starts], text[starts]
    new = np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(starts) - 1]
    return rolling, of[at], starts[at], starts[last], own[at]


def _numbered_in_text(text: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within every run of equal values."""
    new = np.r_[True, text[1:] != text[:-1]] if len(text) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return np.arange(len(text)) - np.repeat(at, np.diff(np.r_[at, len(text)]))


def _parsed(length: int):
    """(node, idx, anchor, phrase) of every phrase, in the order of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=HASHED_BYTES):
            data, bounds = _bytes_of(batch.column("text"))
            rolling, text, first, last, trigger = phrases(data, bounds, length)
            anchor = rolling.of(trigger, min(TRIGGER, length))
            shape = (last - first).astype(np.uint64) * np.uint64(1 << 20) + (trigger - first).astype(np.uint64)
            phrase = mix(rolling.of(first, last - first + length) + mix(shape))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("node").to_numpy()[text]), pa.array(_numbered_in_text(text).astype(np.int32)),
                    pa.array(anchor.view(np.int64)), pa.array(phrase.view(np.int64)),
                ],
                ["node", "idx", "anchor", "phrase"],
            )

    return run


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(node, idx, anchor, phrase): the parse of every text, phrases and their triggers by hash."""
    texts = docs.select(node_of(F.col("text")).alias("node"), "text")
    return in_arrow(texts, _parsed(length), "node long, idx int, anchor long, phrase long")


def _sent(length: int, strings: bool):
    """Phrases to compare, with their bytes; or their strings' hashes one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=HASHED_BYTES):
            data, bounds = _bytes_of(batch.column("text"))
            rolling, text, first, last, trigger = phrases(data, bounds, length)
            begin = np.searchsorted(text, np.arange(batch.num_rows))
            rows: list[tuple] = []
            for t, flags in enumerate(batch.column("flags").to_pylist()):
                for flag in flags:
                    if flag["sent"] and flag["hot"] == strings:
                        p = begin[t] + flag["idx"]
                        rows.append((t, flag["idx"], flag["whole"], int(p)))
            if not rows:
                continue
            t, idx, whole, p = (np.array(c) for c in zip(*rows))
            node = batch.column("node").to_numpy()[t]
            if not strings:
                cut = [data[a:b + length].tobytes() for a, b in zip(first[p].tolist(), last[p].tolist())]
                anchor = rolling.of(trigger[p], min(TRIGGER, length)).view(np.int64)
                columns = [anchor, node, idx.astype(np.int32), whole, (trigger[p] - first[p]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(cut, pa.binary())], ["anchor", "node", "idx", "whole", "ahead", "bytes"]
                )
                continue
            sizes = last[p] - first[p] + 1
            start = np.repeat(first[p] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            columns = [
                rolling.of(start, length).view(np.int64), np.repeat(node, sizes), np.repeat(idx, sizes).astype(np.int32),
                np.repeat(whole, sizes), (start - np.repeat(first[p], sizes)).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["string", "node", "idx", "whole", "start"])

    return run


def _runs(starts: np.ndarray) -> list[int]:
    """first, last, first, last, ... of the runs of sorted starts."""
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.r_[0, cuts + 1]], starts[np.r_[cuts, len(starts) - 1]]], axis=1).ravel().tolist()


def _strings(phrases_: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of the phrases in a row, and their number by phrase."""
    sizes = np.array([len(p) for p in phrases_], np.int64)
    counts = sizes - length + 1
    part = np.cumsum(sizes) // HASHED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        rolling = Rolling(np.frombuffer(b"".join(phrases_[a:b]), np.uint8))
        base, before = np.cumsum(sizes[a:b]) - sizes[a:b], np.cumsum(counts[a:b]) - counts[a:b]
        out.append(rolling.of(np.arange(counts[a:b].sum()) + np.repeat(base - before, counts[a:b]), length))
    return np.concatenate(out), counts


def _common(length: int):
    """For every phrase that occurs once, the starts of its strings that other phrases share."""

    def group(rows: list[dict]) -> list[tuple]:
        if len(rows) < 2:
            return []
        hashes, counts = _strings([r["bytes"] for r in rows], length)
        # every distance to the trigger once per phrase, so equal strings are of different phrases
        order = np.sort(hashes)
        several = order[1:][order[1:] == order[:-1]]
        if not len(several):
            return []
        out = []
        ends = np.cumsum(counts)
        for i, row in enumerate(rows):
            if not row["whole"]:
                own = hashes[ends[i] - counts[i]:ends[i]]
                found = np.flatnonzero(several[np.minimum(np.searchsorted(several, own), len(several) - 1)] == own)
                if len(found):
                    out.append((row["node"], row["idx"], _runs(found)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["anchor"] != current:
                    out += group(held)
                    current, held = row["anchor"], []
                held.append(row)
            yield _found(out)
        yield _found(group(held))

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    types = [pa.int64(), pa.int32(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "idx", "runs"])


def _cleaned(length: int):
    """(node, n_removed, n_spans, kept_sha256, kept) of texts with repeated phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=HASHED_BYTES):
            data, bounds = _bytes_of(batch.column("text"))
            _, text, first, last, _ = phrases(data, bounds, length)
            begin = np.searchsorted(text, np.arange(batch.num_rows))
            out = []
            columns = (batch.column(c).to_pylist() for c in ("node", "flags", "found"))
            for t, (node, flags, found) in enumerate(zip(*columns)):
                edge = np.zeros(bounds[t + 1] - bounds[t] + 1, np.int32)
                ranges = []
                for flag in flags:
                    if flag["whole"]:
                        p = begin[t] + flag["idx"]
                        ranges.append((first[p], last[p]))
                for part in found or ():
                    p, runs = begin[t] + part["idx"], part["runs"]
                    ranges += [(first[p] + a, first[p] + b) for a, b in zip(runs[::2], runs[1::2])]
                for a, b in ranges:
                    edge[a - bounds[t]] += 1
                    edge[b + length - bounds[t]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                own = data[bounds[t]:bounds[t + 1]][~gone].tobytes()
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((node, int(gone.sum()), spans, hashlib.sha256(own).hexdigest(), own))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            rows = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, types)], ["node", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return run


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(node, n_removed, n_spans, kept_sha256, kept) of every distinct text with a repeated passage."""
    parse = stored(occurrences(docs, length), "parse")
    place = F.struct("node", "idx")
    dictionary = stored(parse.groupBy("anchor", "phrase").agg(F.count("*").alias("times"), F.min(place).alias("where")), "dictionary")
    variants = dictionary.groupBy("anchor").agg(F.count("*").alias("variants")).filter("variants > 1")
    open_ = dictionary.join(variants, "anchor", "left").filter("times > 1 or variants > 1")
    marks = parse.join(open_, ["anchor", "phrase"]).select(
        "node", "idx", (F.col("times") > 1).alias("whole"),
        (F.col("variants").isNotNull() & (place == F.col("where"))).alias("sent"),
        (F.coalesce("variants", F.lit(0)) > TOGETHER).alias("hot"),
    )
    flags = marks.groupBy("node").agg(F.collect_set(F.struct("idx", "whole", "sent", "hot")).alias("flags"))
    rows = docs.select(node_of(F.col("text")).alias("node"), F.col("doc_id").alias("_id"), "text")
    least = rows.groupBy("node").agg(F.min("_id").alias("_least"))
    named = flags.join(least, "node").withColumnRenamed("node", "_node")
    match = (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_least"))
    marked = stored(rows.join(named, match).select("node", "text", "flags"), "marked")
    some = marked.filter("exists(flags, f -> f.sent and not f.hot)")
    sent = in_arrow(some, _sent(length, False), "anchor long, node long, idx int, whole boolean, ahead int, bytes binary")
    met = sent.repartition("anchor").sortWithinPartitions("anchor", "node", "idx")
    found = in_arrow(met, _common(length), "node long, idx int, runs array<int>")
    many = marked.filter("exists(flags, f -> f.sent and f.hot)")
    strings = in_arrow(many, _sent(length, True), "string long, node long, idx int, whole boolean, start int")
    shared = strings.groupBy("string").count().filter("count > 1").select("string")
    single = strings.filter("not whole").join(shared, "string")
    spread = single.groupBy("node", "idx").agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("runs"))
    found = found.union(spread)
    by_text = found.groupBy("node").agg(F.collect_list(F.struct("idx", "runs")).alias("found"))
    joined = marked.join(by_text, "node", "left")
    cleaned = in_arrow(joined, _cleaned(length), "node long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cleaned.filter("n_removed > 0").dropDuplicates(["node"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs` (doc_id, text).

    A byte goes if a string of `length` bytes that covers it starts at another place too, of the same
    text or another one; all strings are those of the input. Null and empty texts and texts shorter
    than `length` lose nothing; of equal texts all lose what repeats; no string reaches from one
    text into another.
    """
    texts = docs.select("doc_id", node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("_bytes"))
    whole = texts.select("doc_id", "node", F.octet_length("_bytes").cast("long").alias("n_bytes"), F.sha2("_bytes", 256).alias("_sha"))
    found = stored(repeated(docs, length).drop("kept"), "repeats")
    return whole.join(found, "node", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
    )
