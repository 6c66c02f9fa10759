"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree: domain, language, source. At each node the children share it by weight; a child that
cannot use its share (all its tokens in all allowed epochs) keeps what it can use, and its shortage is shared out among
its siblings again, until they are full too. Only what a whole family cannot use reaches the level above, because every
node's capacity is known before the budget comes down. Shares have a closed form over the siblings in order of capacity
per weight, so a level is one window over the tree's nodes, never over documents.

A leaf's budget becomes whole epochs and a rest. Every epoch has its own seeded order of the leaf's documents, and the rest
takes the prefix of that order that fits. The prefix ends at an order key, found in two steps (sums of key buckets, then
the keys of one bucket), so no leaf passes through one task, whatever its share of the rows.

Defined cases: null tree columns form leaves of their own; a null text has no tokens and goes wherever its leaf's prefix
reaches; rows equal in id and text stand together in an epoch; an empty table gives no rows; weights missing for a name
count as `default_weight`, and a weight of zero takes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talloom.llm.common import SPACE, prepared, stored

SEED = 17
LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key's bucket: at most 65,536 sums per leaf.
BUCKET_DIGITS = 4
KEY_DIGITS = 15


def token_count(text: str = "text") -> Column:
    """White-space words, the token measure of the budget."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")).cast("long")


def order_key(epoch: Column, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """The seeded place of a document in an epoch, as a whole number of 60 bits."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                               F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")


def _weight(column: str, weights: Mapping[str, float] | None, default: float) -> Column:
    out = F.lit(float(default))
    for name, value in (weights or {}).items():
        out = F.when(F.col(column) == F.lit(name), F.lit(float(value))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`budget` of every node from `given`, the budget of its parent; nodes have `cap` and `weight`."""
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = family.orderBy(F.col("_ratio").asc_nulls_last(), F.col(name))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    live = nodes.withColumn("_ratio", ratio)
    live = live.withColumns({
        "_full": F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(before), F.lit(0)),
        "_left": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = F.when(F.col("_ratio") * F.col("_left") + F.col("_full") > F.col("given"), (F.col("given") - F.col("_full")) / F.col("_left"))
    live = live.withColumn("_level", F.first(level, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    filled = F.least(F.col("cap"), F.floor(F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double"))).cast("long"))
    budget = F.when(F.col("weight") > 0, filled).otherwise(F.lit(0).cast("long"))
    return live.withColumn("budget", budget).drop("_ratio", "_full", "_left", "_level")


def budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: Mapping[str, Mapping[str, float]] | None = None, default_weight: float = 1.0) -> DataFrame:
    """Budget of every leaf. leaves: domain, lang, source, tokens."""
    weights = weights or {}
    family = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    given: DataFrame | None = None
    for depth, name in enumerate(LEVELS, 1):
        path, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = family.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(name, weights.get(name), default_weight))
        if given is None:
            nodes = nodes.withColumn("given", F.lit(int(budget)).cast("long"))
        else:
            up = given.select(*[F.col(p).alias(f"_{p}") for p in parent], F.col("budget").alias("given"))
            match = F.lit(True)
            for p in parent:
                match = match & nodes[p].eqNullSafe(up[f"_{p}"])
            nodes = nodes.join(up, match).drop(*[f"_{p}" for p in parent])
        given = _share(nodes, parent, name)
    return given.select(*LEVELS, "tokens", "weight", "budget")


def mix(
    docs: DataFrame, budget: float = 1.0, max_epochs: int = 4, weights: Mapping[str, Mapping[str, float]] | None = None,
    domain: Column | None = None, default_weight: float = 1.0, seed: int = SEED, text: str = "text", id_col: str = "doc_id",
    epoch: str = "epoch",
) -> DataFrame:
    """Documents with `epoch`, one row per selected copy, in their own columns besides (but for one of that name).

    budget: tokens, or up to 1.0 a part of all tokens. domain: the top level, by default the whole corpus.
    """
    prepared(docs.sparkSession)
    top = (domain if domain is not None else F.lit("all")).cast("string")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), top.alias("domain"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
    )
    counted = packed.withColumn("n", token_count())
    leaves = stored(counted.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    goal = int(budget * total) if 0 <= budget <= 1 else int(budget)
    shares = budgets(leaves, goal, max_epochs, weights, default_weight)
    shares = stored(
        shares.withColumns({
            "whole": F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"),
            "leaf": F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in LEVELS]),
        }).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")),
        "shares",
    )
    leaf = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in LEVELS])
    # keys and sizes only, for the leaves with a rest
    rest = shares.where("rest > 0").select("leaf", "whole", "rest")
    keys = stored(
        counted.select(leaf.alias("leaf"), "doc_id", "text", "n").join(rest, "leaf").select("leaf", "rest", "n", order_key(F.col("whole"), seed=seed).alias("key")),
        "keys",
    )
    bucket = F.shiftright("key", 4 * (KEY_DIGITS - BUCKET_DIGITS))
    sums = keys.groupBy("leaf", "rest", bucket.alias("b")).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("leaf").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(upto))
    last = sums.where(F.col("upto") > F.col("rest")).groupBy("leaf").agg(F.min("b").alias("b"))
    border = sums.join(last, ["leaf", "b"]).select("leaf", "b", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))
    inside = keys.withColumn("b", bucket).join(border, ["leaf", "b"]).groupBy("leaf", "b", "room", "key").agg(F.sum("n").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("leaf").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first_out = inside.where(F.col("upto") > F.col("room")).groupBy("leaf").agg(F.min("key").alias("cut"))
    plan = stored(shares.select("leaf", "whole", "rest").join(first_out, "leaf", "left"), "plan")
    # the whole plan has a row per leaf; adaptive execution picks the join by its measured size
    chosen = counted.select("_row", "doc_id", "text", leaf.alias("leaf")).join(plan, "leaf")
    partial = (F.col("rest") > 0) & (F.col("cut").isNull() | (order_key(F.col("whole"), seed=seed) < F.col("cut")))
    copies = F.col("whole") + F.when(partial, 1).otherwise(0)
    chosen = chosen.select("_row", copies.alias("copies")).where("copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select(
        *[F.col(f"_row.`{c}`") for c in docs.columns if c != epoch], (F.col("_copy") - 1).cast("int").alias(epoch)
    )
