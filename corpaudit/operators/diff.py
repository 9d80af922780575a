"""Comparing two runs over the same corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.schemas import FINDING_COLUMNS


def scan_diff(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Findings only one run has, by repository, id, path and line."""
    keys = ["repo_id", "id", "path", "line"]

    def only(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        same = F.lit(True)
        for key in keys:
            same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
        return a.join(b, same, "left_anti").select(F.lit(name).alias("only_in"), *keys)

    return only(run_a, run_b, "a").unionByName(only(run_b, run_a, "b"))


def run_difference(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Finding ids only one run has, as sets per repository."""
    a, b = (r.select("repo_id", "id") for r in (run_a, run_b))
    return (
        a.subtract(b).withColumn("only_in", F.lit("a"))
        .unionByName(b.subtract(a).withColumn("only_in", F.lit("b")))
    )


def score_diff(scores_a: DataFrame, scores_b: DataFrame) -> DataFrame:
    """Repositories whose scores differ or that one run lacks."""
    names = [c for c in scores_a.columns if c != "repo_id"]
    a = scores_a.select("repo_id", *[F.col(n).alias(f"a_{n}") for n in names])
    b = scores_b.select("repo_id", *[F.col(n).alias(f"b_{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
    return a.join(b, "repo_id", "full_outer").filter(~same)


def _row_digest(columns: Sequence[str]) -> Column:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *fields), 256)


def run_checksum(rows: DataFrame, *, columns: Sequence[str] = tuple(FINDING_COLUMNS)) -> DataFrame:
    """(repo_id, rows, checksum): equal for equal row sets in any order.

    Row digests are summed, so no repository is collected or sorted anywhere.
    """
    part = F.conv(F.substring(_row_digest(columns), 1, 15), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("total"))
    seal = F.concat_ws(":", F.col("rows").cast("string"), F.col("total").cast("string"))
    return sums.select("repo_id", "rows", F.sha2(seal, 256).alias("checksum"))


def repeatable(run_a: DataFrame, run_b: DataFrame, *, columns: Sequence[str] = tuple(FINDING_COLUMNS)) -> DataFrame:
    """Per repository, whether two runs found the same."""
    a, b = (
        run_checksum(run, columns=columns).select("repo_id", F.col("rows").alias(f"rows_{n}"), F.col("checksum").alias(f"checksum_{n}"))
        for n, run in (("a", run_a), ("b", run_b))
    )
    same = F.col("checksum_a").eqNullSafe(F.col("checksum_b"))
    return a.join(b, "repo_id", "full_outer").withColumn("repeatable", same)


# --- runs kept for comparison -------------------------------------------------

# A tree of checksums over the first 16 bits of the row digests, 16 children a node.
_LEVELS = 4
_FAN = 16
FILTERED_LEAVES = 100


class KeptRun:
    """Rows of one run in a folder, sorted by digest, beside the tree of their checksums."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def write(rows: DataFrame, path: str, *, columns: Sequence[str] = tuple(FINDING_COLUMNS)) -> KeptRun:
        """Keep a run. The rows are clustered, so that those of a few leaves are few row groups."""
        kept = KeptRun(rows.sparkSession, path)
        digest = _row_digest(columns)
        leaf = F.conv(F.substring(digest, 1, _LEVELS), 16, 10).cast("int")
        hashed = rows.select(*columns).withColumns({"_digest": digest, "_leaf": leaf})
        hashed.repartitionByRange("_leaf").sortWithinPartitions("_leaf").write.parquet(f"{kept.path}/rows")
        kept._leaves().write.parquet(f"{kept.path}/tree")
        return kept

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _leaves(self) -> DataFrame:
        part = F.conv(F.substring("_digest", 1, 15), 16, 10).cast("decimal(38,0)")
        return self.rows().groupBy("_leaf").agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("total"))

    def tree(self) -> DataFrame:
        """(level, node, rows, total): the root is level 0, the leaves level 4; at most 69,905 rows."""
        leaves = self.spark.read.parquet(f"{self.path}/tree")
        sums = F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total")
        levels = []
        for level in range(_LEVELS + 1):
            node = F.floor(F.col("_leaf") / _FAN ** (_LEVELS - level)).cast("int")
            levels.append(leaves.groupBy(node.alias("node")).agg(*sums).select(F.lit(level).alias("level"), "node", "rows", "total"))
        return reduce(DataFrame.unionByName, levels)


def differing_leaves(a: KeptRun, b: KeptRun) -> list[int]:
    """Leaves whose checksums differ; below equal nodes nothing is looked at."""
    found = [0]
    trees = a.tree().alias("a"), b.tree().alias("b")
    both = trees[0].join(trees[1], ["level", "node"], "full_outer").filter(
        ~(F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.total").eqNullSafe(F.col("b.total")))
    )
    unequal = {(r.level, r.node) for r in both.select("level", "node").collect()}
    if (0, 0) not in unequal:
        return []
    for level in range(1, _LEVELS + 1):
        below = (n * _FAN + i for n in found for i in range(_FAN))
        found = [n for n in below if (level, n) in unequal]
    return found


def differing_rows(a: KeptRun, b: KeptRun) -> DataFrame:
    """Rows that the runs do not have equally often, with their numbers in_a and in_b.

    Only rows of differing leaves are read: the leaves are a filter on a clustered column.
    """
    leaves = differing_leaves(a, b)
    listed = F.broadcast(a.spark.createDataFrame([(leaf,) for leaf in leaves], "_leaf int"))

    def counted(run: KeptRun, name: str) -> DataFrame:
        rows = run.rows()
        columns = [c for c in rows.columns if c not in ("_digest", "_leaf")]
        # few leaves are a filter on storage, many (65,536 at most) a table
        some = rows.filter(F.col("_leaf").isin(leaves)) if len(leaves) <= FILTERED_LEAVES else rows.join(listed, "_leaf")
        one = F.first(F.struct(*columns)).alias(f"row_{name}")
        return some.groupBy("_digest").agg(F.count(F.lit(1)).alias(f"in_{name}"), one)

    numbers = {n: F.coalesce(n, F.lit(0)) for n in ("in_a", "in_b")}
    both = counted(a, "a").join(counted(b, "b"), "_digest", "full_outer").withColumns(numbers)
    return both.filter("in_a <> in_b").select(F.coalesce("row_a", "row_b").alias("r"), "in_a", "in_b").select("r.*", "in_a", "in_b")


# --- many runs ----------------------------------------------------------------

def finding_history(runs: DataFrame) -> DataFrame:
    """Intervals of every finding's life over numbered runs.

    runs: (run, repo_id, id, path, line, ...), with run ascending. A finding is named by repository, id,
    path and line. One row per interval of successive runs that have it: first_seen, last_seen, spell
    (from 1; a later spell is a finding that was reopened) and open (seen in the last run). A run without
    any finding is known only if another repository has a row of it. Repeated rows count once.
    """
    keys = ["repo_id", "id", "path", "line"]
    numbers = runs.select("run").distinct()
    every = W.orderBy("run")
    in_order = numbers.withColumn("at", F.row_number().over(every)).withColumn("last", F.max("at").over(W.partitionBy()))
    seen = runs.select("run", *keys).distinct().join(F.broadcast(in_order), "run")
    life = W.partitionBy(*keys).orderBy("at")
    # successive runs: place and run number grow alike
    spells = seen.withColumn("_island", F.col("at") - F.row_number().over(life))
    found = spells.groupBy(*keys, "_island").agg(
        F.min("run").alias("first_seen"), F.max("run").alias("last_seen"), F.max("at").alias("_at"),
        F.first("last").alias("_last"),
    )
    spell = F.row_number().over(W.partitionBy(*keys).orderBy("_island"))
    return found.withColumn("spell", spell).select(
        *keys, "spell", "first_seen", "last_seen", (F.col("_at") == F.col("_last")).alias("open")
    )
