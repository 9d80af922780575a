"""Numbering rows within groups when one group may hold a third of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.storage import stored

# monotonically_increasing_id() puts the partition above these bits
_ROW_BITS = 33


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """row_number() over (keys, order) that never sorts a group in one task.

    The rows are range-partitioned by keys and order, sorted within the partitions and written once
    with a running id. A row's number is its place in its partition plus the group's rows in the
    partitions before, which a small table of counts gives. Every group takes the same path.
    """
    keys = list(keys)
    sort = [*[F.col(k) for k in keys], *order]
    placed = stored(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("__task", F.shiftright("__id", _ROW_BITS))
    counts = placed.groupBy(*keys, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = W.partitionBy(*keys).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__base", F.col("__first") - F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = placed.join(starts.select(*keys, "__task", "__base"), [*keys, "__task"])
    return joined.select(*rows.columns, (F.col("__id") - F.col("__base") + 1).alias(name))
