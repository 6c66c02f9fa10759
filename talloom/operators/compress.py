"""Shrinking old results of long sessions in three tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.functions import predicates, text
from talloom.operators.ordered import Ordered, wide_tasks
from talloom.operators.transcript import recent
from talloom.session import small_side

# Markers and limits of the three tiers.
SNIPPED = "[Content snipped - re-read if needed]"
CLEARED = "[Old result cleared]"
BUDGET_FROM, BUDGET_TIGHT = 0.50, 0.70
BUDGET_WIDE_CHARS, BUDGET_TIGHT_CHARS, BUDGET_RESERVE = 30000, 15000, 80
SNIP_FROM, SNIP_HOT_FROM = 0.60, 0.75
IDLE_SECONDS = 300
KEEP_RESULTS = 3


def budget_text(value: Column, utilisation: Column, wide: int = BUDGET_WIDE_CHARS, tight: int = BUDGET_TIGHT_CHARS) -> Column:
    limit = F.when(utilisation > BUDGET_TIGHT, tight).otherwise(wide)
    cut = text.head_tail(value, limit, BUDGET_RESERVE, text.BUDGET_CUT)
    return F.when(utilisation < BUDGET_FROM, value).otherwise(cut)


def budget_tier(
    results: DataFrame, gauge: DataFrame, key: str, value: str = "text",
    wide: int = BUDGET_WIDE_CHARS, tight: int = BUDGET_TIGHT_CHARS,
) -> DataFrame:
    """Cut long results once the session's window fills up. gauge(key, utilisation)."""
    joined = results.join(gauge.select(key, "utilisation"), key, "left")
    used = F.coalesce("utilisation", F.lit(0.0))
    return joined.withColumn(value, budget_text(F.col(value), used, wide, tight)).drop("utilisation")


def snip_tier(
    results: DataFrame, gauge: DataFrame, key: str, order: list[str], value: str = "text",
    keep: int = KEEP_RESULTS, chunk_rows: int | None = None,
) -> DataFrame:
    """Replace re-read and old results by a marker when the session needs room.

    results(key, order, tool, path, value), gauge(key, utilisation,
    idle_seconds). A session whose last call is recent waits for a higher
    utilisation. Rows already snipped do not count.
    """
    joined = results.join(small_side(gauge.select(key, "utilisation", "idle_seconds")), key, "left")
    return _snip(Ordered(joined, [key], order, chunk_rows, wide_tasks(results, value)), value, keep).frame().drop("utilisation", "idle_seconds")


def _snip(rows: Ordered, value: str, keep: int) -> Ordered:
    used = F.coalesce("utilisation", F.lit(0.0))
    hot = F.coalesce(F.col("idle_seconds") < IDLE_SECONDS, F.lit(False))
    gate = (used >= SNIP_FROM) & ~(hot & (used < SNIP_HOT_FROM))
    eligible = F.coalesce(
        F.col("tool").isin(*predicates.SNIPPABLE_TOOLS) & (F.col(value) != SNIPPED), F.lit(False)
    )
    rows = recent(rows, rows.keys, rows.order, eligible, keep, "_old")
    rows = rows.with_later("_again", eligible & (F.col("tool") == "read_file"), "path")
    snip = gate & (F.col("_old_eligible") > keep) & (F.col("_old") | F.col("_again"))
    return rows.with_column(value, F.when(snip, SNIPPED).otherwise(F.col(value))).drop("_old", "_old_eligible", "_again")


def microcompact_tier(
    results: DataFrame, gauge: DataFrame, key: str, order: list[str], value: str = "text",
    keep: int = KEEP_RESULTS, chunk_rows: int | None = None,
) -> DataFrame:
    """Clear all but the last results of idle sessions. gauge(key, idle_seconds)."""
    joined = results.join(small_side(gauge.select(key, "idle_seconds")), key, "left")
    return _clear(Ordered(joined, [key], order, chunk_rows, wide_tasks(results, value)), value, keep).frame().drop("idle_seconds")


def _clear(rows: Ordered, value: str, keep: int) -> Ordered:
    idle = F.coalesce(F.col("idle_seconds") >= IDLE_SECONDS, F.lit(False))
    eligible = F.coalesce(~F.col(value).isin(SNIPPED, CLEARED), F.lit(False))
    rows = recent(rows, rows.keys, rows.order, eligible, keep, "_old")
    cleared = F.when(idle & F.col("_old"), CLEARED).otherwise(F.col(value))
    return rows.with_column(value, cleared).drop("_old", "_old_eligible")


def compress(
    results: DataFrame, gauge: DataFrame, key: str, order: list[str], value: str = "text",
    keep: int = KEEP_RESULTS, wide: int = BUDGET_WIDE_CHARS, tight: int = BUDGET_TIGHT_CHARS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """The three tiers in order, with one join to the gauge and one exchange on the key; large sessions are cut once."""
    rows = results.join(small_side(gauge.select(key, "utilisation", "idle_seconds")), key, "left")
    used = F.coalesce("utilisation", F.lit(0.0))
    rows = rows.withColumn(value, budget_text(F.col(value), used, wide, tight))
    ordered = _clear(_snip(Ordered(rows, [key], order, chunk_rows, wide_tasks(results, value)), value, keep), value, keep)
    return ordered.frame().drop("utilisation", "idle_seconds")
