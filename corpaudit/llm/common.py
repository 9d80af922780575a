"""Helpers shared by the operators: stored tables, word arrays, numbering, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.storage import stored

#: Text handled at once by the Python side, so that one Arrow batch of long texts stays small there.
SLICE_BYTES = 4 << 20
#: Rows numbered by one window task; hot keys are cut into slices of about this size.
SLICE_ROWS = 100_000
#: Fewest slices of a key that is numbered.
LEAST_SLICES = 64

__all__ = ["stored", "table", "ship", "in_arrow", "text_slices", "words_of", "word_hashes", "mix", "numbered", "components", "fold_mod"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that they need no installation."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="corpaudit-"), "corpaudit.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("corpaudit", os.path.relpath(full, root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`rows.mapInArrow` with this package on the executors.

    Python workers live on after a task; each gives back the memory that it has freed, or stages with
    different needs would add up in an executor.
    """
    ship(rows.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fold_mod(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text (a longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for start, end in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(start, end - start)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased: row offsets, codes, distinct words.

    A null text has no words.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():
        before = np.concatenate([[0], np.cumsum(~empty)])
        bounds = before[bounds]
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    return bounds, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def numbered(rows: DataFrame, keys: list[str], order: list[Column], spread: Column, total: int) -> DataFrame:
    """Column `rank`, from 0 without gaps within the keys, although no task holds a hot key.

    `spread` decides the slice of a row within its key, `order` the place within the slice. Both
    must depend on the row's values alone. `total` rows size the slices.
    """
    slices = max(LEAST_SLICES, total // SLICE_ROWS)
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)).cast("int"))
    sizes = cut.groupBy(*keys, "_slice").count()
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_slice"]]
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    local = cut.withColumn("_local", F.row_number().over(within) - 1)
    joined = local.alias("l").join(starts.alias("r"), match)
    return joined.select(
        *[F.col(f"l.{c}") for c in rows.columns], (F.col("r._start") + F.col("l._local")).alias("rank")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): connected components by contraction.

    Each round maps a node to its least neighbour and contracts the edges, which at least halves the
    nodes that still have edges; every round is a written table. Hubs are pre-aggregated minima and
    joins that AQE can split.
    """
    maps = []
    current = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not current.isEmpty():
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        step = stored(least.select("node", F.least("node", "_least").alias("next")), "step")
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("next").alias("to_a"))
        right = step.select(F.col("node").alias("b"), F.col("next").alias("to_b"))
        moved = current.join(left, "a").join(right, "b").filter("to_a <> to_b")
        current = stored(
            moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges"
        )
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    labels = maps[0].select("node", F.col("next").alias("root"))
    for step in maps[1:]:
        hop = step.select(F.col("node").alias("root"), F.col("next").alias("_next"))
        labels = labels.join(hop, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return stored(labels, "labels")
