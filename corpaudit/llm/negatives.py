"""Hard negatives by slots between the positives' limits.

The upper limits of an anchor's positives cut the scores into disjoint slots. Every block of rows keeps
the best few of each slot, which combine like counts do; lists of the slots below a limit, merged from
the lowest slot upwards, then answer the windows of all positives, although these overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.llm.common import ship, stored

#: Components of the rows, and of the anchors, that meet in one task.
ROW_CELLS = 1 << 21
ANCHOR_CELLS = 1 << 17
#: Rows and anchors multiplied at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4096, 512
#: Whole numbers below this are exact in double precision.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def scaled(embedding: Column, factor: int) -> Column:
    """floor(factor * x) of every component, as whole doubles; beyond 64 bits the nearest long."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("double"))


def _usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    bound = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < bound) & (x > -bound)
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits become the largest or smallest long."""
    top = np.abs(anchors).max(initial=0.0)
    large = np.abs(rows).max(axis=1, initial=0.0) * top * max(rows.shape[1], 1) >= EXACT
    if not large.any():
        return (anchors @ rows.T).astype(np.int64)
    out = np.zeros((len(anchors), len(rows)), np.int64)
    out[:, ~large] = (anchors @ rows[~large].T).astype(np.int64)
    whole = [[int(x) for x in a] for a in anchors]
    for j in np.flatnonzero(large):
        row = [int(x) for x in rows[j]]
        out[:, j] = [max(-LARGEST, min(LARGEST, sum(x * y for x, y in zip(a, row)))) for a in whole]
    return out


def _best(anchor, slot, score, vec_id, k: int):
    """The first k of each (anchor, slot): higher scores first, ties by smaller id."""
    order = np.lexsort((vec_id, -score, slot, anchor))
    anchor, slot, score, vec_id = (c[order] for c in (anchor, slot, score, vec_id))
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(anchor)) - np.repeat(starts, np.diff([*starts, len(anchor)]))
    keep = place < k
    return anchor[keep], slot[keep], score[keep], vec_id[keep]


def _meet(k: int, negatives: bool):
    """What the anchors and rows of one task give: the best k of every anchor, or of its slots."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        own, own_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        width = max(
            [int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in (anchors, rows) for c in t.column("vector").chunks],
            default=0,
        )
        left, right = _matrix(anchors.column("vector"), width), _matrix(rows.column("vector"), width)
        found = tuple(np.zeros(0, np.int64) for _ in range(4))
        if negatives:
            limits = anchors.column("limits").to_pylist()
            most = max(map(len, limits), default=0)
            # limits go down; missing ones lie below every score
            upper = np.array([[*u, *[-LARGEST - 1] * (most - len(u))] for u in limits], np.int64).reshape(len(limits), most)
            used = np.array([len(u) for u in limits])
            lowest = anchors.column("lowest").to_numpy()
        for a in range(0, len(left), ANCHORS_AT_ONCE):
            some = slice(a, a + ANCHORS_AT_ONCE)
            for r in range(0, len(right), ROWS_AT_ONCE):
                part = slice(r, r + ROWS_AT_ONCE)
                scores = _products(left[some], right[part])
                equal = own_labels[some, None] == labels[None, part]
                if negatives:
                    above = (upper[some, :, None] >= scores[:, None, :]).sum(axis=1, dtype=np.int64)
                    above = np.minimum(above, used[some, None])
                    wanted = ~equal & (above > 0) & (scores >= lowest[some, None])
                else:
                    above = np.ones_like(scores)
                    wanted = equal & (own[some, None] != ids[None, part])
                i, j = np.nonzero(wanted)
                new = (own[some][i], above[i, j] - 1, scores[i, j], ids[part][j])
                found = _best(*(np.concatenate(c) for c in zip(found, new)), k)
        return pa.table(dict(zip(("anchor_id", "slot", "score", "vec_id"), found)))

    return run


def _met(anchors: DataFrame, rows: DataFrame, tiles: tuple[int, int], k: int, negatives: bool) -> DataFrame:
    """Every block of anchors meets every block of rows in a task of its own."""
    by_anchor, by_row = tiles
    ship(rows.sparkSession)

    def cut(table: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        named = table.withColumn(own, F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int")).drop("_row")
        return named.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = cut(anchors, "_a", by_anchor, "_b", by_row).groupBy("_a", "_b")
    right = cut(rows, "_b", by_row, "_a", by_anchor).groupBy("_a", "_b")
    met = left.cogroup(right).applyInArrow(_meet(k, negatives), "anchor_id long, slot long, score long, vec_id long")
    best = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def mined(
    rows: DataFrame, is_anchor: Column, factor: int, positives: int, negatives: int, low: int, high: int, den: int
) -> DataFrame:
    """Hard negatives of every positive of the anchors, from (vec_id, label, embedding).

    The positives of an anchor are its best rows of the same label, another id. A negative has another
    label and a score with low * positive <= den * score <= high * positive. Scores are inner products
    of floor(factor * x); vectors of different lengths are compared as if the shorter one ended in zeros.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Repeated rows stay rows of their own; of several rows with one anchor's id the
    one with the least label and vector is the anchor. Components (when
    scaled) and scores beyond 64 bits become the nearest long.
    """
    spark = rows.sparkSession
    marked = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.when(_usable(F.col("embedding")), scaled(F.col("embedding"), factor)).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    valid = stored(marked.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    first = F.min(F.struct("label", "vector")).alias("least")
    anchors = stored(
        valid.filter("is_anchor").groupBy("vec_id").agg(first).select(
            "vec_id", "least.label", "least.vector", F.col("vec_id").alias("_row")
        ),
        "anchors",
    )
    valid = valid.drop("is_anchor")
    n, width = valid.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = max(width or 1, 1)
    tiles = tuple(
        max(1, -(-count * width // cells)) for count, cells in ((anchors.count(), ANCHOR_CELLS), (n, ROW_CELLS))
    )

    found = _met(anchors, valid, tiles, positives, negatives=False)
    pairs = stored(
        found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives"
    )
    # den * score <= high * positive, in whole numbers
    whole = F.col("positive_score").cast("decimal(38,0)")
    upper = F.floor(whole * high / den).cast("long")
    lower = F.ceil(whole * low / den).cast("long")
    bounded = pairs.withColumns({"upper": upper, "lower": lower})
    limits = bounded.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.reverse(F.array_sort(F.collect_set("upper"))).alias("limits"), F.min("lower").alias("lowest")
    )
    with_limits = anchors.join(limits, "vec_id")
    slots = _met(with_limits, valid, tiles, negatives, negatives=True)

    # suffix m: the best of slots m and below; a slot's scores all lie above those of the next
    entry = F.struct("place", "score", "vec_id")
    lists = slots.groupBy("anchor_id", "slot").agg(F.array_sort(F.collect_list(entry)).alias("best"))
    best_of = lists.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))
    joined = bounded.join(limits.select(F.col("vec_id").alias("anchor_id"), "limits"), "anchor_id").join(best_of, "anchor_id")
    empty = F.array().cast("array<struct<place: int, score: long, vec_id: long>>")

    def merge(lists: Column, slot: Column) -> Column:
        below = F.coalesce(F.get(lists, 0), empty)
        here = F.coalesce(F.try_element_at("slots", slot), empty)
        return F.concat(F.array(F.slice(F.concat(here, below), 1, negatives)), lists)

    descending = F.reverse(F.sequence(F.lit(0).cast("long"), F.size("limits").cast("long") - 1))
    suffixes = F.aggregate(descending, F.array().cast("array<array<struct<place: int, score: long, vec_id: long>>>"), merge)
    own = F.get(F.col("suffixes"), F.array_position("limits", F.col("upper")).cast("int") - 1)
    answered = joined.withColumn("suffixes", suffixes).withColumn(
        "kept", F.filter(own, lambda e: e["score"] >= F.col("lower"))
    )
    return answered.select("anchor_id", "positive_id", "positive_score", F.posexplode("kept").alias("_at", "negative")).select(
        "anchor_id", "positive_id", (F.col("_at") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        "positive_score", F.col("negative.score").alias("negative_score"),
    )
