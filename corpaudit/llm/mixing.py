"""Mix sources to target weights: budgets through a tree, then a seeded token prefix of every leaf."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.llm.common import stored

#: Leaf tables up to this many rows are broadcast to the documents, larger ones are joined.
BROADCAST_LEAVES = 20_000
#: Rows of a slice of a leaf's order.
SLICE_ROWS = 20_000
NONE = "(none)"
WORDS = r"[^\x20\x09-\x0D]+"

Weights = Mapping[str, int]


def token_count(text: Column) -> Column:
    """Words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(level: str, weights: Weights) -> Column:
    """Weight of a node by its own name; 1 unless it is listed."""
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def _big(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def filled(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """`nodes` (supply, weight, and the parent's budget `total`) with `budget`, in whole tokens.

    Siblings share the total by weight; what one can't supply goes to the others by weight, until
    the total or every supply is used up. In order of supply per weight, a node is used up as long
    as the share left for it exceeds its supply; all later ones share by weight what is left.
    """
    order = [F.col("supply").cast("double") / F.col("weight"), F.col(name)]
    siblings = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    before = siblings.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = siblings.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("supply").over(before), F.lit(0))
    weight = F.sum("weight").over(after)
    marked = nodes.withColumn("_left", left).withColumn("_weight", weight)
    shares = _big(F.col("_left")) * _big(F.col("weight")) <= _big(F.col("supply")) * _big(F.col("_weight"))
    first = F.min(F.when(shares, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "_left", "_weight")))
    level = first.over(siblings)
    share = F.expr("cast(cast(_level._left as decimal(19,0)) * cast(weight as decimal(19,0)) div _level._weight as bigint)")
    return (
        marked.withColumn("_level", level)
        .withColumn("budget", F.coalesce(F.least("supply", share), F.col("supply")))
        .drop("_left", "_weight", "_level")
    )


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Weights], total: int) -> DataFrame:
    """`leaves` (levels, supply) with `budget`: filled from the root down.

    A node's supply is that of its leaves, so a shortage is made up among siblings before their
    parent hands it to its own. At most one token per node is left over by rounding down.
    """
    current: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", _weight(level, weights[depth]))
        if current is None:
            nodes = nodes.withColumn("total", F.least(F.lit(int(total)), F.sum("supply").over(W.partitionBy(F.lit(0)))))
        else:
            nodes = nodes.join(current.select(*path[:-1], F.col("budget").alias("total")), path[:-1])
        current = filled(nodes, path[:-1], level).drop("total", "weight")
    assert current is not None
    return current


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def plan(sized: DataFrame, levels: Sequence[str], weights: Sequence[Weights], total: int, epochs: int, seed: int, rows: int) -> DataFrame:
    """One row per leaf: `whole` epochs to take in full, and the last key and its tokens of one more.

    `sized` has doc_id, the levels and n_tokens. Only the slice of a leaf's order in which its
    budget ends is put in order; sums of the other slices say where that is.
    """
    leaves = sized.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    budget = budgets(leaves.withColumn("supply", F.col("tokens") * epochs), levels, weights, total)
    targets = stored(
        leaves.filter("tokens > 0").join(budget.select(*levels, "budget"), list(levels))
        .withColumn("whole", F.expr("cast(budget div tokens as int)"))
        .withColumn("rest", F.expr("budget % tokens")),
        "targets",
    )
    digits = 2
    while rows > SLICE_ROWS * 16 ** digits and digits < 8:
        digits += 1
    keyed = _with_leaves(sized.filter("n_tokens > 0"), targets.filter("rest > 0"), levels)
    keyed = keyed.withColumn("_key", order_key(seed, F.col("whole"), F.col("doc_id")))
    keyed = keyed.withColumn("_slice", F.substring("_key", 1, digits))
    slices = keyed.groupBy(*levels, "rest", "_slice").agg(F.sum("n_tokens").alias("_tokens"))
    running = F.sum("_tokens").over(W.partitionBy(*levels).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    ending = slices.withColumn("_before", F.coalesce(running, F.lit(0))).filter(
        "_before < rest and _before + _tokens >= rest"
    ).select(*levels, "_slice", "_before")
    # one slice per leaf
    edge = _with_leaves(keyed, ending, [*levels, "_slice"])
    place = W.partitionBy(*levels).orderBy("_key", "doc_id", "n_tokens")
    done = F.coalesce(F.sum("n_tokens").over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
    edge = edge.withColumn("_done", done).filter("_done < rest and _done + n_tokens >= rest")
    last = edge.select(*levels, F.col("_key").alias("last_key"), (F.col("rest") - F.col("_done")).alias("last_tokens"))
    last = last.groupBy(*levels).agg(F.max("last_key").alias("last_key"), F.max("last_tokens").alias("last_tokens"))
    return stored(targets.join(last, list(levels), "left"), "plan")


def _with_leaves(rows: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on the keys; the leaves are broadcast only while they are few."""
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, list(keys))


def mixed(
    docs: DataFrame, levels: Sequence[str], weights: Sequence[Weights], total: int | float,
    epochs: int = 1, seed: int = 0,
) -> DataFrame:
    """`docs` rows chosen for the mix, with `epoch`, `n_tokens` and `taken`.

    `levels` are columns from the root down, `weights` by node name for each; a null name is the
    node `(none)`. `total` is a number of tokens, or a share of all tokens if it is a float. A leaf
    repeats its documents for whole epochs, then takes a prefix of one more epoch's seeded order;
    the last document of the prefix may be taken in part. Documents without tokens (null or empty
    text) have nothing to take and leave. Documents with the same id share their place: repeated
    rows behind the last one are taken or left together, so a leaf may pass its budget by them.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels]
    sized = stored(docs.select("doc_id", *names, token_count(F.col("text")).alias("n_tokens")), "sized")
    sums = sized.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    amount = int(sums["tokens"] * total) if isinstance(total, float) else int(total)
    leaves = plan(sized, levels, weights, amount, epochs, seed, sums["rows"])
    parts = leaves.select(*[F.col(c).alias(f"_{c}") for c in levels], "whole", "last_key", "last_tokens")
    rows = docs.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in levels})
    rows = rows.withColumn("n_tokens", token_count(F.col("text"))).filter("n_tokens > 0")
    joined = _with_leaves(rows, parts, [f"_{c}" for c in levels])
    key = order_key(seed, F.col("whole"), F.col("doc_id"))
    last = F.col("last_key")
    part = F.when(key < last, F.col("n_tokens")).when(key == last, F.least("n_tokens", "last_tokens"))
    whole = F.transform(
        F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>")),
        lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("taken")),
    )
    more = F.when(part > 0, F.array(F.struct(F.col("whole").alias("epoch"), part.alias("taken"))))
    empty = F.array().cast("array<struct<epoch:int,taken:bigint>>")
    chosen = joined.withColumn("_chosen", F.concat(whole, F.coalesce(more, empty)))
    kept = [c for c in docs.columns if c not in ("epoch", "taken", "n_tokens")]
    return chosen.select(*kept, "n_tokens", F.inline("_chosen"))
