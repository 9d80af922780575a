"""Quality rules in plain SQL functions: repetition counts and divergence from language references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.llm.common import stored

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
SPACES = r"[\x20\x09-\x0D]"
#: Character classes of the histogram; what is left, small letters and stops, is one more.
CLASSES = {"spaces": SPACES, "symbols": SYMBOLS, "capitals": "[A-Z]", "digits": "[0-9]", "wide": r"[^\x00-\x7F]"}
#: Most frequent words of a language, by whose shares a text is compared.
COMMON = 16
#: A text is compared from this many words on; a reference holds from this many on.
LEAST_WORDS, LEAST_REFERENCE = 50, 1_000
#: Largest Jensen-Shannon distances (0 to 1) of a text that is kept.
FAR_CLASSES, FAR_WORDS = 0.25, 0.42
#: Reference tables up to this many languages are broadcast.
BROADCAST_LANGS = 1_000
NONE = "(none)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(plain, " "), "")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    lines = F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(w: Column) -> Column:
    """Words that stand in an eight-word window found twice or more, the first one included."""
    size = F.size(w)
    starts = F.sequence(F.lit(1), size - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts_of(p: Column) -> Column:
            twice = F.filter(
                F.transform(p, lambda x, k: F.when(
                    (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"]
                )),
                lambda i: i.isNotNull(),
            )
            return F.array_sort(twice)

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n")
        )
        return F.aggregate(let(placed, starts_of), zero, step, lambda a: a["n"])

    none = F.lit(0).cast("long")
    return F.when(size <= WINDOW, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    )


def _class_counts(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(name) for name, p in CLASSES.items()]


def references(docs: DataFrame) -> DataFrame:
    """(lang, ref_words, common, ref_common, ref_classes) from all texts of every language.

    Shares of the most frequent words (ties: by the word) and of the character classes, each with
    the share of the rest last.
    """
    named = docs.select(F.coalesce("lang", F.lit(NONE)).alias("lang"), "text").filter("text is not null")
    counted = named.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    counted = stored(counted, "words")
    totals = counted.groupBy("lang").agg(F.sum("count").alias("ref_words"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= COMMON)
    common = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "count"))).alias("top"))
    chars = named.select("lang", F.length("text").cast("long").alias("size"), *_class_counts(F.col("text")))
    sums = chars.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("size", *CLASSES)])
    joined = totals.join(common, "lang").join(sums, "lang")
    word_counts = F.transform("top", lambda x: x["count"])
    return joined.select(
        "lang", "ref_words", F.transform("top", lambda x: x["word"]).alias("common"),
        shares(word_counts, F.col("ref_words")).alias("ref_common"),
        shares(F.array(*CLASSES), F.col("size")).alias("ref_classes"),
    )


def shares(counts: Column, total: Column) -> Column:
    """Shares of the counts in the total, and of the rest."""
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(counts, F.array(rest)), lambda x: x / F.greatest(total, F.lit(1)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two share arrays of the same length."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    sums = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(sums / 2, F.lit(0.0)))


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    the distances class_distance and word_distance) of every row of `docs` (doc_id, text, lang).

    A text fails when it is short or repeats itself. A longer one is compared with the reference of
    its language, and isn't kept if its histogram of character classes or of common words is too far
    away. Short texts and languages of few words are not compared. A null text has no words and
    fails; a null language is a language of its own; repeated rows are judged each.
    """
    refs = stored(references(docs), "references")
    few = refs.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", "text", F.coalesce("lang", F.lit(NONE)).alias("lang"))
    joined = named.join(F.broadcast(refs) if few else refs, "lang", "left")
    common = F.coalesce("common", F.array().cast("array<string>"))
    measured = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        repeated_words(w).alias("n_repeat_words"),
        F.transform(common, lambda c: (F.size(w) - F.size(F.array_remove(w, c))).cast("long")).alias("hits"),
        F.length(text).cast("long").alias("size"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        F.array(*_class_counts(F.col("text"))).alias("classes"),
    ))
    # the generator keeps the measures from being computed once for each of their uses
    rows = joined.select("doc_id", "ref_words", "ref_common", "ref_classes", F.inline(F.array(measured)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    compared = (F.col("n_words") >= LEAST_WORDS) & (F.coalesce("ref_words", F.lit(0)) >= LEAST_REFERENCE)
    by_class = F.when(compared, divergence(shares(F.col("classes"), F.col("size")), F.col("ref_classes")))
    by_word = F.when(compared, divergence(shares(F.col("hits"), F.col("n_words")), F.col("ref_common")))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= FAR_CLASSES) & (F.coalesce("word_distance", F.lit(0.0)) <= FAR_WORDS)
    judged = rows.select(
        "doc_id", "n_words", (F.col("size") - F.col("classes")[0]).alias("word_chars"),
        F.col("classes")[1].alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), by_class.alias("class_distance"), by_word.alias("word_distance"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & near)
