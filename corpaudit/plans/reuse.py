"""Features of content kept between scans, so that equal content is examined once.

A scan hashes every file and looks the hash up; only content that no file of this or an earlier scan
had is decoded, searched and parsed. The features then go to all files of that content.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpaudit.storage import dropped, shuffles_dropped, stored

KEY = "feature_key"
# What the features mean; raise it when the code that computes them changes.
VERSION = 2
# Keys of files to examine that may be broadcast, in bytes; more of them are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
# A key, the number of a file's name, and what a row of a broadcast takes besides.
ROW_BYTES = 32 + 8 + 40
# Known contents whose features Spark may broadcast if it takes them for small. It goes by the size of compressed
# files and of columns on average, and keys do not compress: it takes many times too much for small.
KNOWN_ROWS = 1 << 14


class FeatureStore:
    """A folder of features by content, one subfolder per set of options.

    Each scan appends one batch; readers see a batch as a whole or not at all. Two scans at a time may
    both add the same content, and readers keep one of the rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, options: str) -> str:
        return f"{self.path}/options={options}"

    def read(self, options: str) -> DataFrame | None:
        """Rows of one set of options, one per key; None while there are none."""
        try:
            rows = self.spark.read.parquet(self._folder(options))
        except AnalysisException as failure:
            if failure.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        # the count reads footers only
        few = rows.count() <= KNOWN_ROWS
        known = rows.dropDuplicates([KEY])
        return known if few else known.hint("merge")

    def add(self, rows: DataFrame, options: str) -> None:
        # keys are chance bytes and digests are hexadecimal: of these, only an entropy coder saves half
        with shuffles_dropped(self.spark):
            rows.write.mode("append").option("compression", "zstd").parquet(self._folder(options))

    def size(self, options: str) -> int:
        rows = self.read(options)
        if rows is None:
            return 0
        with shuffles_dropped(self.spark):
            return rows.count()


def options_id(*settings) -> str:
    """Names a set of options; features also depend on the parser, so on the Python version."""
    described = repr((VERSION, sys.version_info[:2], settings))
    return hashlib.sha256(described.encode()).hexdigest()[:16]


def content_key(content: Column, context: list[Column]) -> Column:
    """Hash of the content and of all else that its features depend on."""
    known = [F.coalesce(c.cast("string"), F.lit("")) for c in context]
    return F.unhex(F.sha2(F.concat_ws("\x1f", F.coalesce(F.sha2(content, 256), F.lit("-")), *known), 256))


def _number() -> Column:
    """Stands for a file's name; two files may share one."""
    return F.xxhash64("repo_id", "path")


def features_once(
    files: DataFrame,
    metadata: DataFrame,
    key: Column,
    examine: Callable[[DataFrame], DataFrame],
    columns: list[str],
    store: FeatureStore,
    options: str,
) -> DataFrame:
    """The rows of metadata with the features of their content.

    files: (repo_id, path, ..., content); metadata: the same rows with KEY and without content; examine
    gives rows of files, with KEY, their features. The corpus is read once to hash it, a second time for
    the content that is new, and hashed again when the rows are asked for: keys of all files would take
    more disk than what is known of them. Where few files are new, their keys are broadcast and no content
    is shuffled; otherwise the content that is examined meets its key in a join. Files go by a number made
    from their names: where two share one, the key tells which is meant. Files must not change meanwhile: a
    file whose content is not found again ends the scan with an error.
    """
    firsts = metadata.groupBy(KEY).agg(F.min(_number()).alias("file"))
    known = store.read(options)
    if known is not None:
        firsts = firsts.join(known.select(KEY), KEY, "left_anti")
    wanted = stored(firsts.select("file", F.col(KEY).alias("wanted")), "wanted")
    new = wanted.count()
    if new:
        names = F.broadcast(wanted) if new * ROW_BYTES <= BROADCAST_BYTES else wanted
        # hashed after the join: only what may be examined is hashed a second time
        contents = files.withColumn("file", _number()).join(names, "file").withColumn(KEY, key).filter(F.col(KEY) == F.col("wanted"))
        store.add(examine(contents.drop("file", "wanted")).select(KEY, *columns), options)
        known = store.read(options)
    dropped(wanted)
    if known is None:
        # an empty corpus: the schema of the features, without rows
        known = examine(files.withColumn(KEY, key).filter("false")).select(KEY, *columns)
    joined = metadata.join(known.select(F.col(KEY).alias("found"), *columns), F.col(KEY) == F.col("found"), "left")
    lost = F.raise_error(F.lit("a file changed while the corpus was read"))
    return joined.filter(F.when(F.col("found").isNull(), lost.cast("boolean")).otherwise(True)).drop("found", KEY)
