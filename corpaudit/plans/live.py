"""Results that follow a growing corpus.

Files arrive in a folder of packed files. Each batch of a stream is scanned, and its repositories'
results replace those of earlier batches; content that was seen before is not examined again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpaudit.plans.reuse import FeatureStore
from corpaudit.plans.scan import ScanOptions, scan
from corpaudit.schemas import FILES
from corpaudit.storage import measured_broadcasts

# Tables of a scan that are kept; `repos` is written last and commits a batch.
TABLES = ("findings", "scores", "summary", "duplicates", "technologies", "recommendations", "errors")


def apply_batch(files: DataFrame, batch: int, folder: str, options: ScanOptions, store: FeatureStore | None) -> None:
    """Scan the files of one batch and put its results into the folders of that batch.

    A batch that comes again writes the same folders again, so replays change nothing.
    """
    with measured_broadcasts(files.sparkSession):
        tables = scan(files, None, options, feature_store=store)
        for name in TABLES:
            getattr(tables, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
        tables.repos.write.mode("overwrite").parquet(f"{folder}/repos/batch={batch}")


def follow(
    spark: SparkSession,
    packed: str,
    folder: str,
    *,
    options: ScanOptions = ScanOptions(),
    feature_store: FeatureStore | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start a stream over the packed files below `packed` that ends when all that is there is scanned.

    A repository of a batch has all of its files in it: writers add files of whole repositories, and
    files_per_batch, where it is set, must not cut them apart. Start it again for what came since.
    """
    reader = spark.readStream.schema(FILES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrived = reader.option("recursiveFileLookup", "true").parquet(packed)

    def run(files: DataFrame, batch: int) -> None:
        apply_batch(files, batch, folder, options, feature_store)

    return (
        arrived.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table, each repository's from the last batch that had it."""
    seen = spark.read.parquet(f"{folder}/repos")
    last = seen.groupBy("repo_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows.join(last, ["repo_id", "batch"], "left_semi").drop("batch")
