"""Exact n-gram Jaccard join: regions around pivots, triangle-inequality windows, components.

In Jaccard space almost all texts are at distance 1 from each other, so regions around pivots alone
would copy every text into every region. The first regions are therefore cut by content: the
shingle universe is dealt into so many classes that two linked sets, which differ in few shingles,
must agree on a whole class. Texts that agree on a class share a region. Within a region pivots
take over: every text is measured against its regions' pivots, and around each pivot the texts
that it doesn't link are compared with those in the window that the triangle inequality leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit.llm.common import components, in_arrow, mix, stored, text_slices, word_hashes, words_of

#: Ratio of neighbouring size bands.
BAND = 1.3
#: Keys that a task collects before it hands them over, and keys of one part of the key space.
TASK_KEYS, PART_KEYS, LEAST_PARTS = 1_000_000, 1_000_000, 256
#: Texts with the same key in one task from which on they are handed over as a list.
TOGETHER = 16
#: Nodes in one list; texts measured against one copy of a pivot.
LIST, GROUP = 512, 256
#: Texts that meet one copy of a block.
PART = 4096
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def node_of(text: Column) -> Column:
    """The identity of a text: equal texts are one node."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of every text.

    A text with fewer words than `width` has its whole word sequence as the only shingle, one
    without words has none.
    """
    bounds, codes, words = words_of(texts)
    hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled + hashes[k:k + len(rolled)] * _FACTORS[k % 4] + np.uint64(k))
    out = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= width:
            out.append(np.unique(rolled[start:end - width + 1]))
        elif end > start:
            whole = np.zeros(1, np.uint64)
            for k, h in enumerate(hashes[start:end]):
                whole = mix(whole + h * _FACTORS[k % 4] + np.uint64(1000 + k))
            out.append(mix(whole + np.uint64(end - start)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def members(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, n_shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes = np.array([len(s) for s in shingle_sets(batch.column("text"), width)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(sizes)], ["doc_id", "node", "n_shingles"]
            )

    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, run, f"doc_id {kind}, node long, n_shingles long")


# ---- first regions: classes of the shingle universe ----------------------------------------------


def band_edges(largest: int) -> list[int]:
    """Least sizes of the bands, up to one beyond `largest`."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


def classes_of_band(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """(classes, slack) for pairs whose smaller set has `low` to `high` shingles.

    Linked sets differ in at most (1 - t) / (1 + t) of their summed sizes. With that many classes,
    and one and the slack more, at least slack + 1 classes are equal in both, so one that isn't empty
    if the set has at most `slack` empty classes. The slack is what the smallest set rarely passes.
    """
    differ = (den - num) * (high + high * den // num) // (den + num)
    if differ == 0:
        return 1, 0
    slack = 0
    while True:
        classes = differ + 1 + slack
        empty = classes * (1 - 1 / classes) ** low  # expected in the smallest set
        needed = int(empty + 2 * empty ** 0.5) + 1
        if needed <= slack or classes > 4 * low + 8:
            return classes, max(slack, classes - low)
        slack = needed


def bands_of(size: int, edges: list[int], num: int, den: int) -> list[int]:
    """Bands in which a set meets its partners: its own, and those with smaller partners."""
    own = int(np.searchsorted(edges, size, side="right")) - 1
    out = [own]
    least = -(-num * size // den)
    while out[-1] > 0 and edges[out[-1]] > least:
        out.append(out[-1] - 1)
    return out


def class_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set index, 64-bit key) of every non-empty class of every set in each of its bands.

    A set with more empty classes than the slack is dealt out again with the next seed, until it
    has fewer: of a linked pair that agrees on no full class, both are dealt out again.
    """
    edges = band_edges(max((len(s) for s in sets), default=0))
    of_band: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            for band in bands_of(len(s), edges, num, den):
                of_band.setdefault(band, []).append(i)
    owners, keys = [], []
    for band, indices in of_band.items():
        classes, slack = classes_of_band(edges[band], edges[band + 1] - 1, num, den)
        seed = 0
        while indices:
            sizes = np.array([len(sets[i]) for i in indices])
            tokens = np.concatenate([sets[i] for i in indices])
            row = np.repeat(np.arange(len(indices)), sizes)
            salted = mix(tokens + mix(np.array([seed * 4096 + band], np.uint64)))
            place = row * classes + (salted >> np.uint64(32)).astype(np.int64) % classes
            cells = len(indices) * classes
            content = mix(salted)
            # sums of 32-bit halves are exact in a double
            low = np.bincount(place, (content & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
            high = np.bincount(place, (content >> np.uint64(32)).astype(float), cells).astype(np.uint64)
            full = np.bincount(place, minlength=cells) > 0
            at = np.flatnonzero(full)
            name = (at % classes).astype(np.uint64) * _FACTORS[3] + np.uint64(band * 64 + seed)
            keys.append(mix(mix(low[at] * _FACTORS[0] + high[at]) + name))
            owners.append(np.array(indices, np.int64)[at // classes])
            empty = classes - full.reshape(len(indices), classes).sum(axis=1)
            indices = [i for i, e in zip(indices, empty) if e > slack]
            seed += 1
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys, and the end."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)
    return np.r_[starts, len(sorted_keys)]


def _handed_over(keys: np.ndarray, nodes: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Keys as one row of bytes per part of the key space; keys of many texts as lists of nodes.

    Of those only the least node goes to the key's part, marked; the lists need no further work and
    go anywhere. So a part gets at most TOGETHER nodes of a key from a task.
    """
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])] if len(keys) else np.empty(0, bool)
    keys, nodes = keys[fresh], nodes[fresh]
    bounds = _groups(keys)
    sizes = np.diff(bounds)
    rows: list[tuple] = []
    marked = np.zeros(len(keys), bool)
    alive = np.ones(len(keys), bool)
    for g in np.flatnonzero(sizes > TOGETHER).tolist():
        start, end = int(bounds[g]), int(bounds[g + 1])
        marked[start] = True
        alive[start + 1:end] = False
        for at in range(start, end, LIST):
            rows.append((int(keys[start] + np.uint64(at)) % parts, int(keys[start:start + 1].view(np.int64)[0]), None, nodes[at:min(end, at + LIST)].tobytes(), None))
    keys, nodes, marked = keys[alive], nodes[alive], marked[alive]
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[p]:cuts[p + 1]]
        rows.append((p, None, keys[at].tobytes(), nodes[at].tobytes(), np.packbits(marked[at]).tobytes()))
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 5
    for start in range(0, max(1, len(rows)), 2048):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[start:start + 2048], t) for c, t in zip(columns, types)], ["part", "region", "keys", "nodes", "marks"]
        )


def _regions_of(keys: np.ndarray, nodes: np.ndarray, marks: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Regions of one part: keys of several nodes, each list of nodes once."""
    order = np.lexsort((nodes, keys))
    keys, nodes, marks = keys[order], nodes[order], marks[order]
    bounds = _groups(keys)
    names, lists, seen = [], [], set()
    for g in np.flatnonzero(np.diff(bounds) > 1).tolist():
        start, end = int(bounds[g]), int(bounds[g + 1])
        own = np.unique(nodes[start:end][~marks[start:end]])
        if marks[start:end].any():  # further nodes of this key are in lists of its own
            if not len(own):
                continue
        elif len(own) < 2:
            continue
        else:
            content = own.tobytes()
            if content in seen:
                continue
            seen.add(content)
        for at in range(0, len(own), LIST):
            names.append(int(keys[start:start + 1].view(np.int64)[0]))
            lists.append(own[at:at + LIST])
    return names, lists


def regions(docs: DataFrame, width: int, num: int, den: int, shingles: int) -> DataFrame:
    """(region, nodes): lists of texts that agree on a class; a region may have several lists."""
    parts = max(LEAST_PARTS, shingles // PART_KEYS // 3)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            owner, key = class_keys(sets, num, den)
            keys.append(key)
            nodes.append(batch.column("node").to_numpy()[owner])
            held += len(key)
            if held > TASK_KEYS:
                yield from _handed_over(np.concatenate(keys), np.concatenate(nodes), parts)
                keys, nodes, held = [], [], 0
        if held:
            yield from _handed_over(np.concatenate(keys), np.concatenate(nodes), parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                names, lists = _regions_of(*(np.concatenate(x) for x in zip(*held)))
                yield from _listed(names, lists)
                held.clear()

        for batch in batches:
            for part, region, keys, nodes, marks in zip(*(c.to_pylist() for c in batch.columns)):
                if region is not None:
                    yield from _listed([region], [np.frombuffer(nodes, np.int64)])
                    continue
                if part != current:
                    yield from flush()
                    current = part
                own = np.frombuffer(keys, np.uint64)
                held.append((own, np.frombuffer(nodes, np.int64), np.unpackbits(np.frombuffer(marks, np.uint8), count=len(own)).astype(bool)))
        yield from flush()

    def _listed(names: list[int], lists: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(names), 4096):
            some = lists[start:start + 4096]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some)))
            yield pa.RecordBatch.from_arrays([pa.array(names[start:start + 4096], pa.int64()), column], ["region", "nodes"])

    texts = docs.select(node_of(F.col("text")).alias("node"), "text")
    dealt = in_arrow(texts, deal, "part int, region long, keys binary, nodes binary, marks binary")
    spread = dealt.repartition("part").sortWithinPartitions("part")
    return in_arrow(spread, gather, "region long, nodes array<long>")


# ---- measuring pairs -------------------------------------------------------------------------------


def texts_for(docs: DataFrame, texts_of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes, once each, from a row with the id that `texts_of` names."""
    named = nodes.join(texts_of, "node").select(F.col("node").alias("_node"), "least")
    rows = docs.select(node_of(F.col("text")).alias("node"), F.col("doc_id").alias("_id"), "text")
    match = (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("least"))
    return rows.join(named, match).select("node", "text").dropDuplicates(["node"])


def measured(docs: DataFrame, texts_of: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """`pairs` (a, b) of nodes with the sizes of both sets and of their intersection.

    The b's are pivots: every text travels to its pivots, groups of at most GROUP with a copy of the
    pivot each, and meets it there. `texts_of` names a row of every node.
    """
    texts = texts_for(docs, texts_of, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    groups = pairs.groupBy("b").count().select("b", F.ceil(F.col("count") / GROUP).cast("int").alias("groups"))
    split = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("salt"))
    split = stored(split, "pairs")
    to_pivot = split.select(F.col("a").alias("node"), "b", "salt", F.lit(False).alias("pivot"))
    pivots = split.select(F.col("b").alias("node"), "b", "salt").distinct().withColumn("pivot", F.lit(True))
    sent = to_pivot.union(pivots).join(texts, "node").repartition("b", "salt")
    sent = sent.sortWithinPartitions("b", "salt", F.desc("pivot")).select("node", "b", "salt", "pivot", "text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivot_set = None, None
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            out = []
            for node, b, pivot, own in zip(*(batch.column(c).to_pylist() for c in ("node", "b", "pivot")), sets):
                if pivot:
                    current, pivot_set = b, own
                elif current == b:
                    place = np.minimum(np.searchsorted(pivot_set, own), max(0, len(pivot_set) - 1))
                    same = int((pivot_set[place] == own).sum()) if len(pivot_set) else 0
                    out.append((node, b, len(own), len(pivot_set), same))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "size_a", "size_b", "same"])

    return stored(in_arrow(sent, meet, "a long, b long, size_a long, size_b long, same long").distinct(), "measured")


def _union_size() -> Column:
    return F.col("size_a") + F.col("size_b") - F.col("same")


def linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    return pairs.filter(F.col("same") * den >= _union_size() * num).select("a", "b")


# ---- the join --------------------------------------------------------------------------------------


def pivots(lists: DataFrame) -> DataFrame:
    """(region, b): the text of each region that shares most with all others, ties by node.

    In a family of copies that is the one most copies are near to.
    """
    sizes = lists.groupBy("region").agg(F.sum(F.size("nodes")).alias("size"))
    placed = stored(lists.join(sizes, "region").select("region", F.explode("nodes").alias("node"), "size"), "placed")
    degree = placed.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = placed.select("region", "node").join(degree, "node")
    best = ranked.groupBy("region").agg(F.max(F.struct("degree", "node")).alias("best"))
    return placed.join(best, "region").select(F.col("node").alias("a"), F.col("best.node").alias("b")).filter("a <> b").distinct()


def windows(near: DataFrame, labels: DataFrame, slack: float) -> DataFrame:
    """(b, band, block, part, node, inner): what is still to be compared around each pivot b.

    Texts that are connected with the pivot need no comparison among themselves. Every other one
    (inner) is compared with all texts of the pivot whose distance to it differs by at most the
    threshold: the distances are cut into bands of that width, and texts of the neighbouring bands
    are copied in. Large bands are cut into blocks, and what meets a block into parts.
    """
    far = near.select("a", "b", (1 - F.col("same") / _union_size()).alias("far"))
    own = far.join(labels.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
    own = own.join(labels.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    inner = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    own = own.select("a", "b", F.floor(F.col("far") / slack).cast("int").alias("band"), inner.alias("inner"))
    open_ = own.groupBy("b").agg(F.count("*").alias("texts"), F.max("inner").alias("some")).filter("some and texts > 1")
    own = stored(own.join(open_.select("b", F.ceil(F.col("texts") / PART).cast("int").alias("parts")), "b"), "around")
    sizes = own.filter("inner").groupBy("b", "band").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    inside = own.filter("inner").join(sizes, ["b", "band"]).select(
        "b", "band", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("a").alias("node"), F.lit(True).alias("inner"),
    )
    copied = own.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(sizes, ["b", "band"])
    copied = copied.select(
        "b", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"), F.lit(False).alias("inner"),
    )
    return inside.union(copied)


class _Block:
    """Shingle sets, with the sets that hold each shingle."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]) -> None:
        self.nodes = np.array(nodes, np.int64)
        self.sizes = np.array([len(s) for s in sets])
        shingles = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.shingles, at = np.unique(shingles[order], return_index=True)
        self.owners, self.starts = owners[order], np.r_[at, len(shingles)]

    def common(self, own: np.ndarray) -> np.ndarray:
        """Size of the intersection of `own` with every set."""
        place = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        place = place[self.shingles[place] == own]
        begin, sizes = self.starts[place], self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(sizes)
        at = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.owners[at], minlength=len(self.nodes))


def compared(docs: DataFrame, texts_of: DataFrame, around: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the inner texts of every block and the texts that meet it."""
    keys = ["b", "band", "block", "part"]
    around = stored(around, "windows")
    texts = texts_for(docs, texts_of, around.select("node").distinct())
    sent = around.join(texts, "node").repartition(*keys).sortWithinPartitions(*keys, F.desc("inner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, inner, block = None, [], [], None
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for key, node, is_inner, own in zip(
                zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("node").to_pylist(), batch.column("inner").to_pylist(), sets
            ):
                if key != current:
                    current, nodes, inner, block = key, [], [], None
                if is_inner:
                    nodes.append(node)
                    inner.append(own)
                    continue
                if block is None:
                    block = _Block(nodes, inner)
                same = block.common(own)
                found = np.flatnonzero((same * den >= (block.sizes + len(own) - same) * num) & (block.nodes != node))
                if len(found):
                    left.append(np.full(len(found), node, np.int64))
                    right.append(block.nodes[found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return in_arrow(sent.select(*keys, "node", "inner", "text"), run, "a long, b long")


def links(docs: DataFrame, own: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(links, labels): links (a, b) that connect all linked nodes, and (node, root) of those.

    Texts that are linked to the same pivot are connected, so links between them are not looked for;
    every other link is found.
    """
    sized = own.filter("n_shingles > 0")
    texts_of = stored(sized.groupBy("node").agg(F.min("doc_id").alias("least")), "texts")
    shingles = own.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    lists = stored(regions(docs, width, num, den, shingles), "regions")
    near = measured(docs, texts_of, pivots(lists), width)
    found = linked(near, num, den)
    labels = components(found)
    more = stored(compared(docs, texts_of, windows(near, labels, (den - num) / den + 1e-9), width, num, den), "links")
    if more.isEmpty():
        return found, labels
    found = found.union(more)
    return found, components(found)


def groups(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, named: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    Two texts link if num / den or more of their shingles are common. The component is the least
    doc_id that links lead to. Null and empty texts have no shingles and are alone; equal texts are
    compared once; rows of equal id and different text are texts of their own, and a null id is no
    component's name unless all of its ids are null. If `named`, there are also the identity of the
    text (node) and that of the group (root, null without shingles), which ids that repeat can't tell.
    """
    own = stored(members(docs, width), "members")
    _, labels = links(docs, own, width, num, den)
    more = ["node"] if named else []
    rooted = own.join(labels, "node", "left").select(
        "doc_id", "n_shingles", *more, F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("root")
    )
    rooted = stored(rooted, "rooted")
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    named_by = rooted.join(least, "root", "left")
    return named_by.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), *(["node", "root"] if named else []))
