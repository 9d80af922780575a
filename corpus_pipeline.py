"""A corpus from raw documents to packed sequences, one operator per stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.llm import jaccard, langid, mixing, packing, pii
from corpaudit.llm.common import stored, table

#: Least share of a text's n-grams that its language's filter holds.
LEAST_SCORE = 0.25
#: Near-duplicates: words of a shingle, and least similarity as a ratio.
WIDTH, NUM, DEN = 5, 80, 100
#: The mix: share of all tokens, and weights by node of the levels.
SHARE, EPOCHS, SEED = 0.9, 1, 7
LEVELS = ("domain", "lang", "source")
WEIGHTS = ({"web": 5, "books": 3, "forum": 2}, {"en": 6, "de": 2, "fr": 2}, {"src0": 2})
DOMAIN = "case try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3 when 1 then 'books' when 2 then 'forum' else 'web' end"
CAPACITY = 2048


def _held(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage works on, and all others in one, so that no name of the user's is in its way."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own]
    return docs.select(*own, F.struct(F.lit(0).alias("c"), *others).alias("held"))


def _restored(kept: DataFrame, docs: DataFrame, *own: str, **changed: Column) -> DataFrame:
    """The documents' columns again, those that the stage changed anew."""
    known = {c: F.col(c) for c in own} | changed
    return kept.select(*[known.get(c, F.col(f"held.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or with hardly a hit go."""
    filters = langid.train(docs.select("text", "lang"))
    told = langid.identify(_held(docs, "text"), filters).filter(F.col("lang_pred") != langid.UNKNOWN)
    return _restored(told.filter(F.col("hit_share") >= LEAST_SCORE), docs, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the least doc_id (null last), of equal ids any one.

    Documents without words are groups of their own by row, so all of them stay. A row goes by its
    doc_id and its text, so no copy of the texts is written to number them; of the rows that have
    both in common, all without words stay and one of the others.
    """
    rows = _held(docs, "doc_id", "text").withColumn("name", F.struct("doc_id", jaccard.node_of(F.col("text")).alias("node")))
    groups = jaccard.groups(rows.select("doc_id", "text"), WIDTH, NUM, DEN, named=True)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    first = groups.filter("root is not null").groupBy("root").agg(F.min(order).alias("first"))
    chosen = first.select(F.struct("first.doc_id", "first.node").alias("name"), F.lit(False).alias("all"))
    bare = groups.filter("root is null").select(F.struct("doc_id", "node").alias("name"), F.lit(True).alias("all")).distinct()
    # one row of a name: the join has dealt and sorted the rows by it
    place = F.row_number().over(W.partitionBy("name").orderBy("name"))
    kept = rows.join(chosen.union(bare), "name").withColumn("place", place).filter("all or place = 1")
    return _restored(kept, docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted again."""
    masked = pii.masked(_held(docs, "doc_id", "text"))
    return _restored(masked, docs, "doc_id", "text", n_chars=F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of every leaf's prefix; a document taken in part stays whole."""
    named = _held(docs, "doc_id", "text", "lang", "source").withColumn("domain", F.expr(DOMAIN))
    chosen = mixing.mixed(named, LEVELS, WEIGHTS, SHARE, EPOCHS, SEED)
    return _restored(chosen.filter("taken > 0"), docs, "doc_id", "text", "lang", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.packed(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]
#: The trained field and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
