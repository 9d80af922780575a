"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query go at its end (since 4.1; earlier ones ignore it).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Largest table that a join broadcasts: as estimated from files, and as measured.
LIMIT, ADAPTIVE_LIMIT = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_NAMES = {"cleanup": CLEANUP, "limit": LIMIT, "adaptive_limit": ADAPTIVE_LIMIT}


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a single-process session may do without; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="corpaudit-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the work folder; nothing is there yet."""
    return f"{work_folder(spark).rstrip('/')}/corpaudit-{uuid.uuid4().hex}/{name}"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    named = {_NAMES[k]: v for k, v in values.items()}
    before = {name: spark.conf.get(name, None) for name in named}
    for name, value in named.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession):
    """Queries that run while this is open drop their shuffle files when they end."""
    return _settings(spark, cleanup="true")


def measured_broadcasts(spark: SparkSession):
    """Queries that run while this is open broadcast what has been measured as small, not what is taken for it.

    Ahead of a run Spark goes by the size of compressed files, so that it may send a table of many times its
    limit through the driver; adaptive execution goes by the rows that a shuffle has written.
    """
    limit = spark.conf.get(ADAPTIVE_LIMIT, None) or spark.conf.get(LIMIT)
    return _settings(spark, limit="-1", adaptive_limit=limit)


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: short lineage, column pruning.

    The files outlive the session, as checkpoint files do. What the write has shuffled goes with its
    end: nothing reads it again, and else it stays until the driver happens to collect its garbage,
    so that an operator of many tables would hold the shuffles of all of them.
    """
    spark = table.sparkSession
    path = new_folder(spark, name)
    with shuffles_dropped(spark):
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete the files of a table from `stored` that nothing will read again."""
    spark = table.sparkSession
    for name in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)
