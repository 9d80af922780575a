"""Prefix trie over conversations by vertical bitmaps.

Conversations lie in blocks by ranges of their ids. A block indexes (position, turn) to the bitset of
its conversations that have this turn there; walking depth first, a parent's bitset is intersected
with the postings of the next position, which gives its children, their counts and the members that
end there. Blocks never see each other: nodes of equal paths are merged by Spark, and sums over
subtrees are prefix sums over a block's walk, in which every node counts where its smallest member is.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit.llm.common import in_arrow, ship, stored

#: A block holds at most so many conversations, and ends with the one that fills it up to so many turns.
BLOCK_CONVERSATIONS = 4096
BLOCK_TURNS = 65_536
#: Conversations share a head with the first of their family of so many ids; heads have under 4 turns.
FAMILY = 20
HEADS = 4
#: Rows of one batch that a walk hands back.
BATCH_ROWS = 16_384

WORD = r"[^\x20\x09-\x0D]+"
_TURNS = "array<struct<key: binary, words: long>>"
_PARTS = (
    "block long, pre int, size int, up int, path binary, parent binary, depth int, words long, "
    "first long, n_convs long, ends array<long>"
)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of (conv_id, turn, role, text): each conversation's turns in order.

    A turn is a 128-bit hash of role and text, and its number of words; null role or text is empty.
    Null turn numbers come first; turns of one number are ordered by hash, repeated rows are turns of
    their own. Rows without conv_id belong to no conversation and go. One conversation's turns (hashes,
    not texts) are held by one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(role, text), F.xxhash64(F.lit(1), text, role))]))
    turn = F.struct(F.col("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    kept = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return kept.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"], t["words"])).alias("turns"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % 20, h = crc32(c) % 4.

    Then come its own turns after the first h. A family's missing first conversation gives no turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("_family"), F.slice("turns", 1, HEADS - 1).alias("_head")
    )
    family = convs.withColumn("_family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "_family", "left")
    head = F.slice(F.coalesce("_head", F.array().cast(_TURNS)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.size("turns") + 1)
    return family.select("conv_id", F.concat(head, own).alias("turns"))


class _Block:
    """The vertical index of a block, and its walk."""

    def __init__(self, ids: list[int], keys: list[list[bytes]], words: list[list[int]]):
        self.ids, self.keys, self.words = ids, keys, words
        self.postings: dict[tuple[int, bytes], list[int] | int] = defaultdict(list)
        self.ended: dict[int, list[int] | int] = defaultdict(list)
        for i, turns in enumerate(keys):
            self.ended[len(turns)].append(i)
            for position, key in enumerate(turns):
                self.postings[position, key].append(i)

    def _bits(self, index: dict, at) -> int:
        """The bitset of an entry, made when it is first asked for."""
        members = index.get(at, 0)
        if isinstance(members, list):
            bits = bytearray((len(self.ids) + 7) // 8)
            for i in members:
                bits[i >> 3] |= 1 << (i & 7)
            members = index[at] = int.from_bytes(bits, "little")
        return members

    def _members(self, bits: int) -> list[int]:
        flags = np.frombuffer(bits.to_bytes((len(self.ids) + 7) // 8, "little"), np.uint8)
        return [self.ids[i] for i in np.flatnonzero(np.unpackbits(flags, bitorder="little")).tolist()]

    def nodes(self) -> Iterator[tuple]:
        """(up, path, parent, depth, words, first, n_convs, ends) in the order of the walk."""
        digest = xxhash.xxh3_128_digest
        place = 0
        waiting = [((1 << len(self.ids)) - 1, 0, -1, b"", b"", 0)]
        while waiting:
            bits, depth, up, path, parent, words = waiting.pop()
            low = (bits & -bits).bit_length() - 1
            if bits == 1 << low:
                # one conversation is left: its turns are a chain
                own, counts, first = self.keys[low], self.words[low], self.ids[low]
                while True:
                    yield up, path, parent, depth, words, first, 1, [first] if depth == len(own) else []
                    up, place = place, place + 1
                    if depth == len(own):
                        break
                    parent, words = path, counts[depth]
                    path = digest(path + own[depth])
                    depth += 1
                continue
            ended = bits & self._bits(self.ended, depth)
            yield up, path, parent, depth, words, self.ids[low], bits.bit_count(), self._members(ended) if ended else []
            rest, children = bits & ~ended, []
            while rest:
                member = (rest & -rest).bit_length() - 1
                key = self.keys[member][depth]
                child = rest & self._bits(self.postings, (depth, key))
                children.append((child, depth + 1, place, digest(path + key), path, self.words[member][depth]))
                rest ^= child
            waiting.extend(reversed(children))
            place += 1


def _parts(ids, keys, words) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("block", pa.int64()), ("pre", pa.int32()), ("size", pa.int32()), ("up", pa.int32()), ("path", pa.binary()),
        ("parent", pa.binary()), ("depth", pa.int32()), ("words", pa.int64()), ("first", pa.int64()),
        ("n_convs", pa.int64()), ("ends", pa.list_(pa.int64())),
    ])
    nodes = list(_Block(ids, keys, words).nodes())
    sizes = [1] * len(nodes)
    for at in range(len(nodes) - 1, 0, -1):
        sizes[nodes[at][0]] += sizes[at]
    for start in range(0, len(nodes), BATCH_ROWS):
        some = nodes[start:start + BATCH_ROWS]
        n = len(some)
        columns = [[ids[0]] * n, range(start, start + n), sizes[start:start + n], *zip(*some)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the conversations of a partition, which come in order of conv_id."""
    ids: list[int] = []
    keys: list[list[bytes]] = []
    words: list[list[int]] = []
    turns = 0
    for batch in batches:
        lists = batch.column("turns")
        bounds = lists.offsets.to_pylist()
        flat = lists.values
        all_keys, all_words = flat.field("key").to_pylist(), flat.field("words").to_pylist()
        for conv, start, end in zip(batch.column("conv_id").to_pylist(), bounds[:-1], bounds[1:]):
            ids.append(conv)
            keys.append(all_keys[start:end])
            words.append(all_words[start:end])
            turns += end - start
            if turns >= BLOCK_TURNS or len(ids) >= BLOCK_CONVERSATIONS:
                yield from _parts(ids, keys, words)
                ids, keys, words, turns = [], [], [], 0
    if ids:
        yield from _parts(ids, keys, words)


def _subtrees(block: pa.Table) -> pa.Table:
    """Sums over subtrees of one block's walk, by prefix sums, and each node's parent's conv_id."""
    block = block.sort_by("pre")
    pre, size, up = (block.column(c).to_numpy() for c in ("pre", "size", "up"))
    conv = block.column("conv_id").to_numpy()

    def over_subtrees(values: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return pa.array(sums[pre + size] - sums[pre])

    return pa.table({
        "path": block.column("path"),
        "parent_conv_id": pa.array(conv[np.maximum(up, 0)], mask=up < 0),
        "n_leaves": over_subtrees(block.column("leaf").to_numpy()),
        "saved_tokens": over_subtrees(block.column("saved").to_numpy()),
    })


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per path over sorted rows: only the state of the hash is kept, whatever ends there."""
    current, state = None, None
    for batch in batches:
        paths, digests = [], []
        texts = pc.binary_join(pc.cast(batch.column("ends"), pa.list_(pa.string())), ",")
        for path, text in zip(batch.column("path").to_pylist(), texts.to_pylist()):
            if path != current:
                if state is not None:
                    paths.append(current)
                    digests.append(state.hexdigest())
                current, state = path, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(digests, pa.string())], names=["path", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], names=["path", "ends_sha256"])


def trie(convs: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations (conv_id, turns), the empty one included.

    conv_id (smallest member) and depth name a node. parent_conv_id is null at the root; n_convs counts
    members, n_children distinct next turns, n_leaves the childless nodes of the subtree, saved_tokens
    sums (n_convs - 1) * words of the last turn over it; ends_sha256 digests the ids of the members that
    end here, in ascending order. No conversations: no rows. Equal turns are equal 128-bit hashes.
    """
    ship(convs.sparkSession)
    placed = stored(convs.select("conv_id", "turns"), "conversations")
    ranged = placed.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    parts = stored(in_arrow(ranged, _walks, _PARTS), "parts")

    merged = parts.groupBy("path").agg(
        F.min("first").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.min("parent").alias("parent"), F.min("depth").alias("depth"),
    )
    children = merged.filter("depth > 0").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    none = F.lit(0).cast("long")
    nodes = stored(
        merged.drop("parent").join(children, "path", "left").withColumn("n_children", F.coalesce("n_children", none)), "nodes"
    )

    here = parts.drop("parent", "depth", "ends").withColumnRenamed("n_convs", "n_here").join(
        nodes.select("path", "conv_id", "n_children"), "path"
    )
    # a node's own tokens and leaf count in the block of its smallest member, once in the table
    owned = (F.col("first") == F.col("conv_id")).cast("long")
    valued = here.select(
        "block", "pre", "size", "up", "path", "conv_id",
        ((F.col("n_here") - owned) * F.col("words")).alias("saved"),
        (owned * (F.col("n_children") == 0).cast("long")).alias("leaf"),
    )
    summed = valued.groupBy("block").applyInArrow(
        _subtrees, "path binary, parent_conv_id long, n_leaves long, saved_tokens long"
    )
    sums = summed.groupBy("path").agg(
        F.min("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    ending = parts.filter(F.size("ends") > 0).select("path", "ends")
    sorted_ends = ending.repartition("path").sortWithinPartitions("path", F.col("ends")[0])
    digests = in_arrow(sorted_ends, _ends, "path binary, ends_sha256 string")
    return nodes.join(sums, "path").join(digests, "path", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
