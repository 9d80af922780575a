"""Near-duplicate vectors: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.llm.common import components, in_arrow, stored

#: A pair at the threshold is missed by all tables with at most this probability.
MISSED = 1e-3
#: Vectors of one bucket compared at once; larger buckets are compared block by block.
BLOCK = 1024
SEED = 20_240


def tables_for(vectors: int, cosine: float) -> tuple[int, int]:
    """(bits of a table, tables): buckets of about eight, and enough tables for MISSED."""
    bits = min(62, max(6, math.ceil(math.log2(max(2, vectors))) - 3))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(1 - same)))


def _planes(size: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, count))


def _unit(flat: np.ndarray, size: int) -> np.ndarray:
    rows = flat.astype(np.float64).reshape(-1, size)
    scale = np.abs(rows).max(axis=1, keepdims=True)  # so that no square over- or underflows
    rows = rows / np.where(scale > 0, scale, 1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def bucketed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(slot, bucket, node, copies, signs, embedding): every class once per table.

    `signs` holds its buckets in all tables, so that a pair is counted in the first that it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                vectors = part.column("embedding")
                sizes = vectors.value_lengths().to_numpy()
                for size in np.unique(sizes):
                    at = pa.array(np.flatnonzero(sizes == size))
                    own = vectors.take(at)
                    unit = _unit(own.flatten().to_numpy(), int(size))
                    signs = (unit @ _planes(int(size), bits * tables) >= 0).reshape(len(unit), tables, bits)
                    bucket = (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)
                    n = len(unit)
                    again = pa.array(np.tile(np.arange(n), tables))
                    column = lambda c: part.column(c).take(at).take(again)  # noqa: B023, E731
                    packed = pa.array([row.tobytes() for row in bucket], pa.binary()).take(again)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(np.arange(tables, dtype=np.int32), n)), pa.array(bucket.T.ravel()),
                            pa.array(np.full(n * tables, size, np.int32)), column("node"), column("copies"), packed,
                            own.take(again),
                        ],
                        ["slot", "bucket", "size", "node", "copies", "signs", "embedding"],
                    )

    kind = dict(classes.dtypes)["embedding"]
    return in_arrow(
        classes.select("node", "copies", "embedding"), run,
        f"slot int, bucket long, size int, node long, copies long, signs binary, embedding {kind}",
    )


def _linked(group: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of one bucket or of two of its blocks."""
    node, copies, block = group["node"], group["copies"], group["block"]
    unit = _unit(group["vector"], int(group["size"]))
    close = unit @ unit.T >= cosine
    np.fill_diagonal(close, False)
    if len(np.unique(block)) > 1:
        close &= block[:, None] != block[None, :]  # pairs within a block meet in a task of their own
    left, right = np.nonzero(close)
    links, root = np.zeros(len(node), np.int64), node.copy()
    if not len(left):
        return node, links, root
    signs = group["signs"]
    first = np.ones(len(left), bool)
    for start in range(0, len(left), 1 << 16):
        cut = slice(start, start + (1 << 16))
        first[cut] = (signs[left[cut]] == signs[right[cut]]).argmax(axis=1) == group["slot"]
    np.add.at(links, left[first], copies[right[first]])
    place = np.arange(len(node))
    while True:  # least position reachable in the block
        least = place.copy()
        np.minimum.at(least, left, place[right])
        if (least == place).all():
            return node, links, node[place]
        place = least[least]


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None

        def finish(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = [rows.column(c).to_numpy() for c in ("slot", "bucket", "size", "block_a", "block_b")]
            change = np.zeros(len(keys[0]), bool)
            for key in keys:
                change[1:] |= key[1:] != key[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(change)]
            node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
            block = rows.column("block").to_numpy()
            signs = rows.column("signs").combine_chunks()
            vectors = rows.column("embedding").combine_chunks()
            out = []
            for start, end in zip(cuts[:-1], cuts[1:]):
                if end - start > 1:
                    wide = b"".join(signs.slice(start, end - start).to_pylist())
                    out.append(_linked({
                        "slot": keys[0][start], "size": keys[2][start], "node": node[start:end],
                        "copies": copies[start:end], "block": block[start:end],
                        "signs": np.frombuffer(wide, np.int64).reshape(end - start, -1),
                        "vector": vectors.slice(start, end - start).flatten().to_numpy(),
                    }, cosine))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                some = (columns[1] > 0) | (columns[0] != columns[2])
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], ["node", "links", "root"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([carried, rows]) if carried is not None else rows
            keys = [rows.column(c).to_numpy() for c in ("slot", "bucket", "size", "block_a", "block_b")]
            last = np.ones(rows.num_rows, bool)
            for key in keys:
                last &= key == key[-1] if len(key) else last
            cut = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if cut:
                yield from finish(rows.slice(0, cut))
            carried = rows.slice(cut)
        if carried is not None and carried.num_rows:
            yield from finish(carried)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding).

    Equal vectors are one class with a count, so they are never compared with each other. A class
    stands once in each table; the classes of a bucket are compared by exact cosine, in blocks if
    they are many, and a pair is counted in the first table whose bucket it shares. No pair leaves
    a task: only counts, and one edge per vector to a representative.

    Null and zero vectors and those with null or non-finite components link with nothing; vectors
    of different lengths neither. Rows with the same vec_id are rows of their own.
    """
    sound = F.expr(
        "embedding is not null and exists(embedding, x -> x <> 0) and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    good = F.coalesce(sound, F.lit(False))
    rows = vectors.select("vec_id", F.when(good, F.xxhash64("embedding")).alias("node"), F.when(good, F.col("embedding")).alias("embedding"))
    classes = stored(
        rows.filter("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies")),
        "classes",
    )
    bits, tables = tables_for(classes.count(), cosine)
    placed = bucketed(classes, bits, tables)
    counts = placed.groupBy("slot", "bucket", "size").count().filter("count > 1")
    sizes = stored(counts.select("slot", "bucket", "size", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    blocked = placed.join(sizes, ["slot", "bucket", "size"])
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = blocked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("block_a", F.least("block", "_other")).withColumn("block_b", F.greatest("block", "_other"))
    keys = ["slot", "bucket", "size", "block_a", "block_b"]
    spread = pairs.select(*keys, "block", "node", "copies", "signs", "embedding").repartition(*keys)
    found = stored(in_arrow(spread.sortWithinPartitions(*keys), _compare(cosine), "node long, links long, root long"), "links")
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    extra = classes.select("node", "copies").join(links, "node", "left").join(labels, "node", "left")
    extra = extra.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    known = stored(rows.select("vec_id", "node").join(extra, "node", "left"), "rows")
    least = known.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    return known.join(least, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("least", "vec_id"), F.lit(True)).alias("kept"),
    )
