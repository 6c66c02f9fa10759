"""Token counts, cost and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.operators.ordered import Ordered, running_sum
from talloom.session import reliable, small_side

TOKEN_CLASSES = ["in_tok", "out_tok", "cache_read", "cache_write"]


def usage_rollup(usage: DataFrame, keys: list[str], how: str = "group") -> DataFrame:
    """Token sums per key; how is group, rollup or cube."""
    grouped = {"group": usage.groupBy, "rollup": usage.rollup, "cube": usage.cube}[how](*keys)
    return grouped.agg(*[F.sum(c).alias(c) for c in TOKEN_CLASSES])


def cost(usage: DataFrame, prices: DataFrame, on: str, digits: int = 6) -> DataFrame:
    """Adds cost: tokens times price per million, exact decimals.

    prices(on, <class>_price decimal) per model; rows of unknown models get null.
    """
    joined = usage.join(small_side(prices), on, "left")
    million = F.lit(1_000_000).cast("decimal(10,0)")
    total = None
    for name in TOKEN_CLASSES:
        part = F.col(name).cast("decimal(18,0)") * F.col(f"{name}_price").cast("decimal(8,4)")
        total = part if total is None else total + part
    amount = (total / million).cast(f"decimal(18,{digits})")
    return joined.withColumn("cost", amount).drop(*[f"{c}_price" for c in TOKEN_CLASSES])


def cache_hit_rate(read: Column, fresh: Column, written: Column) -> Column:
    """Whole percent of input served from cache, 0 if nothing was billed."""
    billed = read + fresh + written
    # floor(x + 1/2) in integers, as halves round up.
    rate = F.floor((F.lit(200) * read + billed) / (F.lit(2) * billed))
    return F.when(billed > 0, rate).otherwise(0).cast("bigint")


def split_cached(prompt: Column, cached: Column) -> Column:
    hit = F.least(F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)), prompt)
    return F.struct((prompt - hit).alias("in_tok"), hit.alias("cache_read"))


def context_gauge(usage: DataFrame, key: str, order: list[str], window: int, reserve: int, percent: int) -> DataFrame:
    """Tokens of the last call against the usable window."""
    size = sum((F.col(c) for c in TOKEN_CLASSES[1:]), F.col(TOKEN_CLASSES[0]))
    usable = window - reserve
    last = usage.groupBy(key).agg(F.max_by(size, F.struct(*order)).alias("context_tokens"))
    return last.select(
        "*",
        (F.col("context_tokens") / usable).alias("utilisation"),
        (F.col("context_tokens") * 100 > usable * percent).alias("full"),
    )


def budget_crossing(
    usage: DataFrame, key: str, order: list[str], amount: Column, turn: Column,
    max_amount, max_turns: int, chunk_rows: int | None = None,
) -> DataFrame:
    """First call of each session at which a limit is reached, with the reason."""
    rows = Ordered(usage.withColumn("_amount", amount), [key], order, chunk_rows).with_running(
        total=running_sum(F.col("_amount")),
        turns=running_sum(F.when(turn, 1).otherwise(0).cast("bigint")),
    )
    over = F.col("total") >= max_amount
    crossed = rows.frame().filter(turn & (over | (F.col("turns") >= max_turns)))
    crossed = crossed.withColumn("reason", F.when(over, "cost").otherwise("turns"))
    names = [*order, "total", "turns", "reason"]
    first = crossed.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_f"))
    return first.select(key, *[F.col(f"_f.{n}").alias(n) for n in names])


def tree_rollup(runs: DataFrame) -> DataFrame:
    """Own input and output tokens plus those of all descendants, and whether the run is on or below a cycle of parents.

    runs(run_id, parent_id, in_tok, out_tok) with unique ids. A parent that is not a run ends the path. Pointers are
    doubled: after round r every run holds the sums of its descendants less than 2**r levels down, and points at its
    ancestor 2**r levels up, so rounds grow with the logarithm of the depth. Only runs whose path goes on are joined with
    their ancestors, so those that are done never meet in one task. A path that ends leaves a run at every depth on its
    way, so once a round ends no path, none that is left ever ends: these runs keep only their own tokens and are marked
    `on_cycle`.
    """
    known = runs.select(F.col("run_id").alias("parent_id"))
    parents = runs.select("run_id", "parent_id").join(known, "parent_id", "left_semi")
    base = runs.select("run_id", "in_tok", "out_tok").join(parents, "run_id", "left")
    nodes = reliable(base.select("run_id", F.col("parent_id").alias("up"), "in_tok", "out_tok"))
    left, before = _on_their_way(nodes), None
    while left and left != before:
        onward = nodes.filter("up IS NOT NULL")
        moved = onward.groupBy(F.col("up").alias("run_id")).agg(F.sum("in_tok").alias("_in"), F.sum("out_tok").alias("_out"))
        summed = nodes.join(moved, "run_id", "left").select(
            "run_id", "up", (F.col("in_tok") + F.coalesce("_in", F.lit(0))).alias("in_tok"),
            (F.col("out_tok") + F.coalesce("_out", F.lit(0))).alias("out_tok"),
        )
        # few ancestors late in the search, which adaptive execution then broadcasts
        further = nodes.select(F.col("run_id").alias("up"), F.col("up").alias("_up")).join(onward.select("up").distinct(), "up", "left_semi")
        stepped = summed.filter("up IS NOT NULL").join(further, "up").select("run_id", F.col("_up").alias("up"), "in_tok", "out_tok")
        nodes = reliable(summed.filter("up IS NULL").unionByName(stepped))
        left, before = _on_their_way(nodes), left
    own = runs.select("run_id", F.col("in_tok").alias("_in"), F.col("out_tok").alias("_out"))
    endless = F.col("up").isNotNull()
    return nodes.join(own, "run_id").select(
        "run_id", F.when(endless, F.col("_in")).otherwise(F.col("in_tok")).alias("in_tok"),
        F.when(endless, F.col("_out")).otherwise(F.col("out_tok")).alias("out_tok"), endless.alias("on_cycle"),
    )


def _on_their_way(nodes: DataFrame) -> int:
    """Runs that still point at an ancestor."""
    return nodes.filter("up IS NOT NULL").select("run_id").distinct().count()
