"""Report documents on storage, written so that an ended run can be taken up again."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpaudit.storage import stored

BATCHES = 32
_COMMITS = "batch int, attempt string, repos long, documents long"


class ReportFolder:
    """JSON documents of one run, committed by batches of whole repositories.

    A batch's documents are written to a folder of their own; a one-row file that names the folder is
    written last and commits them. What a run leaves that ends before is never read, and the next run
    writes only batches without a commit. So every document is there once, however often a run ends.
    One run at a time may write.
    """

    def __init__(self, spark: SparkSession, path: str, batches: int = BATCHES):
        self.spark, self.path, self.batches = spark, path.rstrip("/"), batches

    def commits(self) -> DataFrame:
        """(batch, attempt, repos, documents) of every committed batch."""
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMITS)

    def _documents(self, attempt: str) -> str:
        return f"{self.path}/documents/{attempt}"

    def _write(self, rows: DataFrame, batch: int) -> None:
        attempt = uuid.uuid4().hex
        rows.write.json(self._documents(attempt))
        counted = rows.agg(F.count_distinct("repo_id").alias("repos"), F.count(F.lit(1)).alias("documents"))
        commit = counted.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), "repos", "documents")
        commit.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def write(self, report: DataFrame) -> int:
        """Write the batches that are not committed yet; returns how many there were.

        report: (repo_id, ...), as json_report gives it, the same one each time.
        """
        done = {r.batch for r in self.commits().select("batch").collect()}
        missing = [b for b in range(self.batches) if b not in done]
        if not missing:
            return 0
        batch = F.pmod(F.xxhash64("repo_id"), F.lit(self.batches)).cast("int").alias("_batch")
        # sorted, so that a batch is a few row groups
        kept = stored(report.select("*", batch).filter(F.col("_batch").isin(missing)).sortWithinPartitions("_batch"), "report")
        for one in missing:
            self._write(kept.filter(F.col("_batch") == one).drop("_batch"), one)
        return len(missing)

    def read(self, schema: T.StructType) -> DataFrame:
        """The committed documents."""
        attempts = [r.attempt for r in self.commits().select("attempt").collect()]
        if not attempts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json([self._documents(a) for a in attempts])
