"""Messages, calls and results of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.operators.ordered import (
    Ordered,
    concat_parts,
    last_before,
    last_upto,
    previous,
    running_count,
    running_sum,
)

# Fixed values.
NON_TEXT = "[tool call / result]"
SUMMARY_HEAD = "[Previous conversation summary]\n"


# -- calls and results ----------------------------------------------------------


def pair_calls(results: DataFrame, calls: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Results with what their call brings; results of unknown calls stay.

    Of calls that repeat a key the first counts, by `order` or else by their other columns, so that a result is never
    multiplied. The calls are grouped by the key of the join, which costs no shuffle more.
    """
    rest = [c for c in calls.columns if c not in keys]
    return results.join(first_calls(calls, keys, order or rest) if rest else calls.distinct(), keys, "left")


def duplicate_calls(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Call keys that are not unique, which pairing would multiply."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls")).filter("calls > 1")


def first_calls(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first call of each key, so that pairing never multiplies a result."""
    rest = [c for c in calls.columns if c not in keys]
    first = calls.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def orphans(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Calls without any result."""
    return calls.join(results.select(*keys), keys, "left_anti")


def repair_orphans(calls: DataFrame, results: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Results plus one synthetic result per orphan."""
    made = orphans(calls, results, keys).select(*keys, F.lit(reason).alias("result"), F.lit(True).alias("synthetic"))
    return results.select(*keys, "result", F.lit(False).alias("synthetic")).unionByName(made)


def flatten_text(blocks: Column) -> Column:
    """Text blocks of one message joined, other blocks ignored."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def drop_block_types(blocks: DataFrame, types: list[str], column: str = "type") -> DataFrame:
    return blocks.filter(~F.col(column).isin(*types))


# -- whole sessions -------------------------------------------------------------


def message_counts(messages: DataFrame, key: str) -> DataFrame:
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("messages"))


def session_catalog(messages: DataFrame, key: str, order: str) -> DataFrame:
    return messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("messages"), F.min(order).alias("first"), F.max(order).alias("last")
    )


def latest_session(sessions: DataFrame, start: str, key: str) -> DataFrame:
    """The session that started last; ties go to the higher id."""
    return sessions.agg(F.max_by(key, F.struct(start, key)).alias(key), F.max(start).alias(start))


def last_text(messages: DataFrame, key: str, order: str, role: str) -> DataFrame:
    return messages.filter(F.col("role") == role).groupBy(key).agg(F.max_by("text", order).alias("text"))


def render_transcript(messages: DataFrame, key: str, order: str, part_bytes: int) -> DataFrame:
    """`role: text` lines; a message without text shows a marker."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(NON_TEXT)))
    return concat_parts(messages, [key], [order], line, "\n", part_bytes, name="transcript")


def tool_sequence(calls: DataFrame, keys: list[str], order: list[str], part_bytes: int) -> DataFrame:
    return concat_parts(calls, keys, order, F.col("tool"), ",", part_bytes, name="tools")


def compare_sequences(calls: DataFrame, expected: DataFrame, key: str, order: str, tool: str = "tool") -> DataFrame:
    """Per session whether its tools in order are the expected ones, and the first place that differs.

    expected(key, place, tool) counts places from 1. Places are compared row by row, so no sequence is collected.
    """
    rows = Ordered(calls.select(key, order, tool), [key], [order]).with_running(place=running_count()).frame()
    got = rows.select(key, "place", F.col(tool).alias("_got"))
    want = expected.select(key, F.col("place").cast("bigint").alias("place"), F.col(tool).alias("_want"))
    both = got.join(want, [key, "place"], "full")
    differs = ~F.col("_got").eqNullSafe(F.col("_want"))
    return both.groupBy(key).agg(F.min(F.when(differs, F.col("place"))).alias("first_difference")).withColumn(
        "matches", F.col("first_difference").isNull()
    )


def compact(
    messages: DataFrame, key: str, order: str, keep: int = 1, minimum: int = 4,
    sums: dict[str, Column] | None = None, render: Column | None = None, chunk_rows: int | None = None,
) -> DataFrame:
    """Replace the older messages of long sessions by one summary row.

    messages(key, order, role, text). `sums` are summed over the older messages
    and `render` makes the summary of them, by default from counts; a caller's
    own summariser is `plugins.summarise_with`. The kept tail loses a last
    message that is not from the user when keep is 1. Sessions below the
    minimum pass unchanged.

    The first message of a long session turns into its summary, so everything
    happens in one pass over the session.
    """
    if minimum <= keep:
        raise ValueError("minimum must exceed keep")
    sums = sums or {"messages": F.lit(1).cast("bigint"), "characters": F.length("text").cast("bigint")}
    if render is None:
        render = F.concat(
            F.col("messages").cast("string"), F.lit(" messages, "), F.col("characters").cast("string"), F.lit(" characters")
        )
    rows = Ordered(messages.select(key, order, "role", "text"), [key], [order], chunk_rows)
    rows = rows.with_running(_rn=running_count()).with_total(_n=F.lit(1).cast("bigint"))
    long_ = F.col("_n") >= minimum
    older = long_ & (F.col("_rn") <= F.col("_n") - keep)
    rows = rows.with_total(**{name: F.when(older, value) for name, value in sums.items()}).frame()
    head = long_ & (F.col("_rn") == 1)
    tail = ~older
    if keep == 1:
        tail = tail & (~long_ | (F.col("role") == "user"))
    return rows.filter(head | tail).select(
        key,
        F.when(head, -1).otherwise(F.col(order)).cast("bigint").alias(order),
        F.when(head, "user").otherwise(F.col("role")).alias("role"),
        F.when(head, F.concat(F.lit(SUMMARY_HEAD), render)).otherwise(F.col("text")).alias("text"),
    )


# -- running state --------------------------------------------------------------


def parallel_batches(
    calls: DataFrame, keys: list[str], order: list[str], safe: Column, chunk_rows: int | None = None
) -> DataFrame:
    """Consecutive safe calls share a batch number; any other call has its own."""
    marked = calls.withColumn("safe", safe)
    rows = Ordered(marked, keys, order, chunk_rows).with_running(_before=previous(F.col("safe")))
    joins = F.col("safe") & F.coalesce("_before", F.lit(False))
    rows = rows.with_column("_starts", F.when(joins, 0).otherwise(1).cast("bigint"))
    return rows.with_running(batch=running_sum(F.col("_starts"))).frame().drop("_before", "_starts")


def recent(
    rows: DataFrame | Ordered, keys: list[str], order: list[str], eligible: Column, n: int, name: str = "old", chunk_rows: int | None = None,
) -> Ordered:
    """`keep_recent` that can be gone on with."""
    one = F.when(eligible, 1).otherwise(0).cast("bigint")
    placed = Ordered.over(rows, keys, order, chunk_rows).with_running(_seen=running_sum(one)).with_total(_all=one)
    flagged = placed.with_column(name, eligible & (F.col("_all") - F.col("_seen") >= n))
    return flagged.with_column(f"{name}_eligible", F.col("_all")).drop("_seen", "_all")


def keep_recent(
    rows: DataFrame, keys: list[str], order: list[str], eligible: Column, n: int,
    name: str = "old", chunk_rows: int | None = None,
) -> DataFrame:
    """Flag eligible rows that are not among the last n eligible rows of their group."""
    return recent(rows, keys, order, eligible, n, name, chunk_rows).frame()


def superseded_reads(
    rows: DataFrame, keys: list[str], path: str, order: list[str], eligible: Column,
    name: str = "superseded", chunk_rows: int | None = None,
) -> DataFrame:
    """Flag reads of a path that the same group reads again later."""
    flagged = keep_recent(rows, [*keys, path], order, eligible & F.col(path).isNotNull(), 1, name, chunk_rows)
    return flagged.drop(f"{name}_eligible")


def streaks(
    decisions: DataFrame, keys: list[str], order: list[str], denied: Column,
    max_run: int, max_total: int, chunk_rows: int | None = None,
) -> DataFrame:
    """Consecutive and total denials so far, flagged once a limit is reached."""
    one = F.when(denied, 1).otherwise(0).cast("bigint")
    rows = Ordered(decisions, keys, order, chunk_rows).with_running(total=running_sum(one))
    rows = rows.with_running(_reset=last_upto(F.when(~denied, F.col("total"))))
    rows = rows.with_column("run", F.when(denied, F.col("total") - F.coalesce("_reset", F.lit(0))).otherwise(0))
    hit = denied & ((F.col("run") >= max_run) | (F.col("total") >= max_total))
    return rows.frame().drop("_reset").withColumn("limit_reached", hit)


def confirm_once(
    calls: DataFrame, keys: list[str], order: list[str], approved: Column, chunk_rows: int | None = None
) -> DataFrame:
    """Whether a question must be asked: not once the same one was approved."""
    one = F.when(approved, 1).otherwise(0).cast("bigint")
    rows = Ordered(calls, keys, order, chunk_rows).with_running(_yes=running_sum(one, inclusive=False))
    return rows.frame().withColumn("ask", F.col("_yes") == 0).drop("_yes")


def epochs(
    events: DataFrame, keys: list[str], order: list[str], clears: Column, zeroes: Column, amount: Column,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Epoch number and the amount used since counters were last set to zero.

    Every `clears` or `zeroes` row starts an epoch; only `zeroes` rows reset
    the usage. The row itself belongs to the new epoch and adds nothing.
    """
    starts = F.when(clears | zeroes, 1).otherwise(0).cast("bigint")
    spent = F.when(clears | zeroes, 0).otherwise(amount).cast("bigint")
    rows = Ordered(events, keys, order, chunk_rows)
    rows = rows.with_running(epoch=running_sum(starts), _run=running_sum(spent))
    rows = rows.with_running(_at=last_upto(F.when(zeroes, F.col("_run"))))
    return rows.frame().withColumn("usage", F.col("_run") - F.coalesce("_at", F.lit(0))).drop("_run", "_at")


def first_user_flag(
    messages: DataFrame, keys: list[str], order: list[str], is_user: Column, clears: Column,
    chunk_rows: int | None = None,
) -> DataFrame:
    """First user message after the start or after a clear."""
    one = F.when(is_user, 1).otherwise(0).cast("bigint")
    rows = Ordered(messages, keys, order, chunk_rows).with_running(_users=running_sum(one))
    rows = rows.with_running(_at=last_upto(F.when(clears, F.col("_users"))))
    flag = is_user & (F.col("_users") - F.coalesce("_at", F.lit(0)) == 1)
    return rows.frame().withColumn("gets_context", flag).drop("_users", "_at")


def mode_as_of(
    events: DataFrame, keys: list[str], order: list[str], enters: Column, leaves: Column,
    target: Column, initial: str, chunk_rows: int | None = None,
) -> DataFrame:
    """Mode at every event. Leaving restores the earlier mode unless it names a target.

    Entering while inside and leaving while outside have no effect.
    """
    switch = F.when(enters, "enter").when(leaves, "leave")
    rows = Ordered(events.withColumn("_switch", switch), keys, order, chunk_rows)
    rows = rows.with_running(_prior=last_before(F.col("_switch")), _now=last_upto(F.col("_switch")))
    really_left = (F.col("_switch") == "leave") & (F.col("_prior") == "enter")
    rows = rows.with_running(_base=last_upto(F.when(really_left, target)))
    base = F.coalesce("_base", F.lit(initial))
    mode = F.when(F.col("_now") == "enter", "plan").otherwise(base)
    return rows.frame().withColumn("mode", mode).drop("_switch", "_prior", "_now", "_base")


def stale_writes(
    events: DataFrame, session: str, path: str, order: list[str], is_write: Column,
    version: str, seen: Column, chunk_rows: int | None = None,
) -> DataFrame:
    """Status of each write: new, unread, changed or ok.

    `version` is the version of the path found at the event (null: no such
    path), `seen` the version the event leaves in the session's read state.
    """
    rows = Ordered(events, [session, path], order, chunk_rows).with_running(_seen=last_before(seen))
    status = (
        F.when(F.col(version).isNull(), "new")
        .when(F.col("_seen").isNull(), "unread")
        .when(F.col("_seen") != F.col(version), "changed")
        .otherwise("ok")
    )
    return rows.frame().withColumn("status", status).filter(is_write).drop("_seen")


def mark_last_block(
    blocks: DataFrame, keys: list[str], order: list[str], unstable: Column, chunk_rows: int | None = None
) -> DataFrame:
    """Flag the last block of each session unless it is of an unstable kind. See mark_static for the fixed part."""
    rows = Ordered(blocks, keys, order, chunk_rows).with_running(_rn=running_count()).with_total(_n=F.lit(1).cast("bigint"))
    return rows.frame().withColumn("mark", (F.col("_rn") == F.col("_n")) & ~unstable).drop("_rn", "_n")


def mark_static(parts: DataFrame, static: Column, order: str, key: str) -> DataFrame:
    """Flag where the fixed part of a prompt ends: its last block, before the first that changes; empty blocks go."""
    kept = parts.filter(F.trim("text") != "")
    rows = Ordered(kept.withColumn("_moving", (~static).cast("bigint")), [key], [order]).with_running(
        _seen=running_sum(F.col("_moving")), _rn=running_count()
    ).frame().withColumn("_fixed", F.when(F.col("_seen") == 0, F.col("_rn")))
    last = Ordered(rows, [key], [order]).with_total(_still=F.when(F.col("_fixed").isNotNull(), F.lit(1).cast("bigint"))).frame()
    return last.withColumn("mark", F.coalesce(F.col("_fixed") == F.col("_still"), F.lit(False))).drop("_moving", "_seen", "_rn", "_fixed", "_still")
