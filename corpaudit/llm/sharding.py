"""Balanced label propagation: linked documents move to the shards of their neighbours under quotas.

Documents that share a link key are neighbours. Those with the same keys are interchangeable, so a
round moves counts of them between shards: (node, shard, rows) cells, never pairs of documents. Rows
without neighbours may lie anywhere; they fill what the others leave, so that shards end up even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpaudit.llm.common import SLICE_ROWS, numbered, stored

#: Propagation ends when nothing wants to move, when nothing could in some rounds, and after so many.
ROUNDS = 20
PATIENCE = 2
#: A key that holds more than one row in so many, and more than so many rows, is numbered by several tasks.
TASKS, LEAST_ROWS = 512, 500


def _deal(nodes: DataFrame, total: int, shards: int) -> DataFrame:
    """Cells to begin with: the rows of all nodes, one after the other, dealt round over the shards."""
    slices = max(1, total // SLICE_ROWS)
    cut = nodes.withColumn("_slice", F.pmod(F.xxhash64("node"), F.lit(slices)).cast("int"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy("_slice").agg(F.sum("rows").alias("_rows")).select(
        "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )
    earlier = W.partitionBy("_slice").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    placed = cut.withColumn("_start", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).join(starts, "_slice")
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("rows"), F.lit(shards)) - 1))
    dealt = placed.select("node", "rows", (F.col("_base") + F.col("_start")).alias("_at"), turn.alias("_i"))
    share = F.floor(F.col("rows") / shards) + (F.col("_i") < F.col("rows") % shards).cast("long")
    return dealt.select("node", ((F.col("_at") + F.col("_i")) % shards).cast("int").alias("shard"), share.alias("rows"))


def _moves(cells: DataFrame, members: DataFrame, room: list[int], turn: int) -> DataFrame:
    """(node, src, dst, rows, gain): where each node's rows would lie by its neighbours' votes.

    A node fills the shard that can hold all of it and has most neighbours; where none can, it fills
    those with most neighbours one after the other, as far as they have room. Rows that lie elsewhere
    want to move there. Equal votes are ranked by a hash of the node and the round, so that nodes neither
    choose all the same shard nor wait for it for ever. Only shards where neighbours live are asked.
    """
    by_key = cells.join(members, "node").groupBy("key", "shard").agg(F.sum("rows").alias("rows"))
    votes = by_key.join(members, "key").groupBy("node", "shard").agg(F.sum("rows").alias("votes"))
    known = votes.join(cells, ["node", "shard"], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    free = F.get(F.array(*[F.lit(r).cast("long") for r in room]), F.col("shard")) + F.col("rows")
    sized = known.withColumns({"free": free, "total": F.sum("rows").over(W.partitionBy("node"))})
    draw = F.pmod(F.col("shard") - F.xxhash64("node", F.lit(turn)), F.lit(len(room)))
    by_votes = W.partitionBy("node").orderBy(F.col("free") < F.col("total"), F.desc("votes"), draw)
    before = F.coalesce(F.sum("free").over(by_votes.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = sized.withColumns({"before": before, "place": F.row_number().over(by_votes)}).withColumn(
        "more", F.greatest(F.lit(0), F.least("free", F.col("total") - F.col("before"))) - F.col("rows")
    )
    to, off = F.col("more") > 0, F.col("more") < 0
    # rows that leave and rows that come, each laid out in order, meet where their intervals overlap
    in_order = W.partitionBy("node", to).orderBy("place")
    laid = wanted.filter(to | off).withColumn("end", F.sum(F.abs("more")).over(in_order))
    entry = F.struct("shard", "votes", (F.col("end") - F.abs("more")).alias("start"), "end")
    both = laid.groupBy("node").agg(
        F.collect_list(F.when(off, entry)).alias("offs"), F.collect_list(F.when(to, entry)).alias("tos")
    )
    pairs = both.select("node", F.explode("offs").alias("o"), "tos").select("node", "o", F.explode("tos").alias("t"))
    rows = F.least("o.end", "t.end") - F.greatest("o.start", "t.start")
    return pairs.select(
        "node", F.col("o.shard").alias("src"), F.col("t.shard").alias("dst"), rows.alias("rows"),
        (F.col("t.votes") - F.col("o.votes")).alias("gain"),
    ).filter("rows > 0")


def quotas(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may go from shard to shard, so that no shard ends above its capacity.

    Exchanges are free; the rest follows the room, and what leaves a shard makes room there.
    """
    room = list(room)
    granted = {(i, j): min(n, demand.get((j, i), 0)) for (i, j), n in demand.items()}
    largest_first = sorted(demand, key=lambda pair: (-demand[pair], pair))
    going = True
    while going:
        going = False
        for i, j in largest_first:
            n = min(demand[i, j] - granted[i, j], room[j])
            if n > 0:
                granted[i, j] += n
                room[j] -= n
                room[i] += n
                going = True
    return granted


def _admitted(moves: DataFrame, demand: dict, granted: dict, count: int) -> DataFrame:
    """The moves within the quotas, those with the highest gain first; the last one may be cut."""
    spark = moves.sparkSession
    slices = max(1, count // SLICE_ROWS)
    rows = [(i, j, n, granted[i, j]) for (i, j), n in demand.items()]
    quota = spark.createDataFrame(rows, "src int, dst int, demand long, granted long")
    cut = moves.withColumn("_slice", F.pmod(F.xxhash64("node"), F.lit(slices)).cast("int")).join(F.broadcast(quota), ["src", "dst"])
    lane = W.partitionBy("src", "dst", "_slice")
    best = lane.orderBy(F.desc("gain"), "node").rowsBetween(W.unboundedPreceding, -1)
    share = F.floor(F.col("granted").cast("decimal(38,0)") * F.sum("rows").over(lane) / F.col("demand")).cast("long")
    left = share - F.coalesce(F.sum("rows").over(best), F.lit(0))
    return cut.withColumn("rows", F.least(F.col("rows"), left)).filter("rows > 0")


def propagated(nodes: DataFrame, members: DataFrame, linked: int, capacity: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Cells (node, shard, rows) after the rounds, and the rows of every shard.

    nodes: (node, rows), members: (node, key). `linked` is the sum of rows. At most shards squared
    numbers come to the driver in a round. Every other round plans as if an eighth of a full shard were
    free, so that full shards still exchange rows.
    """
    shards = len(capacity)
    cells = stored(_deal(nodes, linked, shards), "cells")
    idle = 0
    loads: list[int] = []
    for turn in range(rounds + 1):
        found = dict(cells.groupBy("shard").agg(F.sum("rows")).collect())
        loads = [found.get(j, 0) for j in range(shards)]
        if turn == rounds or idle >= PATIENCE:
            break
        room = [c - n for c, n in zip(capacity, loads)]
        hoped = room if turn % 2 == 0 else [r + c // 8 for r, c in zip(room, capacity)]
        moves = stored(_moves(cells, members, hoped, turn), "moves")
        asked = moves.groupBy("src", "dst").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n")).collect()
        demand = {(r.src, r.dst): r.rows for r in asked}
        granted = quotas(demand, room)
        if not any(granted.values()):
            # nothing to ask for even with more room than there is: all is in its place
            idle = PATIENCE if turn % 2 and not demand else idle + 1
            continue
        idle = 0
        going = _admitted(moves, demand, granted, sum(r.n for r in asked))
        changes = going.select("node", F.col("src").alias("shard"), (-F.col("rows")).alias("rows")).union(
            going.select("node", F.col("dst").alias("shard"), "rows")
        )
        summed = cells.union(changes).groupBy("node", "shard").agg(F.sum("rows").alias("rows"))
        cells = stored(summed.filter("rows > 0"), "cells")
    return cells, loads


def _ranked(rows: DataFrame, keys: list[str], total: Column, slice_rows: int) -> DataFrame:
    """Column `_rank`, from 0 within the keys; a key of more than `slice_rows` rows is numbered in slices."""
    slices = F.floor((total - 1) / slice_rows) + 1
    cut = rows.withColumn("_slices", slices).withColumn("_slice", F.pmod(F.xxhash64("_row"), F.col("_slices")))
    sizes = cut.filter("_slices > 1").groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_slice", F.sum("_n").over(before).alias("_start"))
    local = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy("_row")) - 1
    joined = cut.withColumn("_local", local).join(starts, [*keys, "_slice"], "left")
    rank = F.coalesce("_start", F.lit(0)) + F.col("_local")
    return joined.withColumn("_rank", rank).drop("_slices", "_slice", "_local", "_start")


def sharded(docs: DataFrame, links: Column, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (from 0 without gaps in its shard).

    links: an array of longs per row; rows that share one are neighbours, rows with none (or null) have
    no neighbours. Rows of all shards differ by one at most. A group that fits a shard is whole after
    the rounds, as far as the quotas allowed; a larger one lies in few shards. Repeated rows, and rows
    without id, count each for itself. Columns of docs called shard or slot are replaced. Places depend
    on the order in which the table is read.
    """
    keys = F.array_sort(F.array_distinct(F.filter(F.coalesce(links, F.array().cast("array<long>")), lambda k: k.isNotNull())))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = stored(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), keys.alias("_keys"))
        .withColumn("_node", F.xxhash64("_keys")).withColumn("_row", F.monotonically_increasing_id()),
        "rows",
    )
    total = rows.count()
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    twins = rows.filter(F.size("_keys") > 0).groupBy(F.col("_node").alias("node")).agg(
        F.count(F.lit(1)).alias("rows"), F.first("_keys").alias("keys")
    )
    twins = stored(twins, "twins")
    held = twins.select("node", "rows", F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.sum("rows").alias("n")).filter("n > 1")
    linked_keys = stored(held.join(shared.select("key"), "key"), "members")
    nodes = linked_keys.groupBy("node").agg(F.first("rows").alias("rows"))
    linked = nodes.agg(F.sum("rows")).first()[0] or 0
    cells, loads = propagated(nodes, linked_keys.select("node", "key"), linked, capacity, rounds)

    ends = F.sum("rows").over(W.partitionBy("node").orderBy("shard"))
    places = cells.withColumn("end", ends).groupBy(F.col("node").alias("_node")).agg(
        F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("_places"), F.sum("rows").alias("_total")
    )
    # rows without neighbours fill the gaps, as one group
    gaps, filled = [], 0
    for j in range(shards):
        filled += capacity[j] - loads[j]
        gaps.append(F.struct(F.lit(filled).cast("long").alias("end"), F.lit(j).alias("shard")))
    named = rows.drop("_keys").join(places, "_node", "left")
    alone = F.col("_places").isNull()
    named = named.withColumns({
        "_alone": alone, "_node": F.when(alone, F.lit(0).cast("long")).otherwise(F.col("_node")),
        "_total": F.coalesce("_total", F.lit(max(filled, 1)).cast("long")),
    })
    ranked = _ranked(named, ["_alone", "_node"], F.col("_total"), min(SLICE_ROWS, max(total // TASKS, LEAST_ROWS)))
    spot = F.filter(F.coalesce("_places", F.array(*gaps)), lambda p: p["end"] > F.col("_rank"))
    put = ranked.select("_doc", "_row", F.get(spot, 0)["shard"].alias("shard"))
    slots = numbered(put, ["shard"], [F.col("_row")], F.col("_row"), total)
    return slots.select("_doc.*", "shard", F.col("rank").alias("slot"))
