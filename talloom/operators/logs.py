"""Requests, responses, retries and comparisons over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.operators.ordered import Ordered, last_upto, previous, running_sum
from talloom.session import small_side

MAX_RETRIES = 3


def correlate(requests: DataFrame, responses: DataFrame, keys: list[str], within: Column, failed: Column) -> DataFrame:
    """Each request with the response of the same key in time.

    A late response counts as none (timeout); responses without a request are
    dropped by the left join.
    """
    joined = requests.join(responses, [requests[k] == responses[k] for k in keys] + [within], "left")
    for k in keys:
        joined = joined.drop(responses[k])
    status = F.when(failed.isNull(), "timeout").when(failed, "error").otherwise("ok")
    return joined.withColumn("status", status)


def correlate_with_exits(
    requests: DataFrame, responses: DataFrame, exits: DataFrame, keys: list[str], server: str, sent: str, exited: str,
    within: Column, failed: Column,
) -> DataFrame:
    """Like correlate; a request that got no response in time fails with its server's first exit after it was sent.

    exits(server, exited) may list many exits of a server. They meet the unanswered requests only, and the smallest
    one is kept before anything moves.
    """
    paired = correlate(requests, responses, keys, within, failed)
    open_ = paired.filter("status = 'timeout'").select(*keys, server, sent)
    gone = exits.select(F.col(server).alias("_server"), F.col(exited).alias("_exit"))
    ended = open_.join(gone, (F.col(server) == F.col("_server")) & (F.col("_exit") >= F.col(sent)))
    first = ended.groupBy(*keys).agg(F.min("_exit").alias("exit_at"))
    joined = paired.join(first, keys, "left")
    lost = (F.col("status") == "timeout") & F.col("exit_at").isNotNull()
    return joined.withColumn("status", F.when(lost, "server exited").otherwise(F.col("status")))


def absent_report(present: DataFrame, forbidden: DataFrame, key: str) -> DataFrame:
    """For each key that must not exist whether it does."""
    known = present.select(key).distinct().withColumn("exists", F.lit(True))
    return forbidden.select(key).distinct().join(known, key, "left").select(key, F.coalesce("exists", F.lit(False)).alias("exists"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of two runs side by side: same, differs, only_a or only_b."""
    left = a.select(*keys, F.struct(*fields).alias("_a"))
    right = b.select(*keys, F.struct(*fields).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "only_a")
        .when(F.col("_a").isNull(), "only_b")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same")
        .otherwise("differs")
    )
    return left.join(right, keys, "full").select(*keys, status.alias("status"))


def category_counts(log: DataFrame, category: str) -> DataFrame:
    return log.groupBy(category).agg(F.count(F.lit(1)).alias("events"))


def expectation_report(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Counts against expectations. actual(key, events), expected(key, expected)."""
    joined = small_side(expected).join(actual, key, "full")
    got = F.coalesce("events", F.lit(0))
    status = (
        F.when(F.col("expected").isNull(), "unexpected")
        .when(got > F.col("expected"), "exhausted")
        .when(got < F.col("expected"), "short")
        .otherwise("met")
    )
    return joined.select(key, F.col("expected"), got.alias("events"), status.alias("status"))


def track_report(log: DataFrame, counts: DataFrame, texts: DataFrame, present: DataFrame, forbidden: DataFrame) -> DataFrame:
    """What each track of a run was expected to do, row by row: track, test, item, expected, found, met.

    log(track, item, text): what the tracks did. counts(track, item, expected): how often; what was done without being
    expected is a row, too. texts(track, needle) must occur in some text of the track. forbidden(track, path) must not
    be among present(path).
    """
    done = log.groupBy("track", "item").agg(F.count(F.lit(1)).alias("found"))
    wanted = counts.select("track", "item", F.col("expected").cast("bigint").alias("expected"))
    number = done.join(wanted, ["track", "item"], "full").select(
        "track", F.lit("count").alias("test"), "item", F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
    )
    # the needles of a track meet its texts; the rows that hit are counted before anything moves on
    said = small_side(texts.distinct()).join(log.select("track", "text"), "track", "left")
    hit = F.coalesce(F.contains("text", F.col("needle")), F.lit(False)).cast("bigint")
    spoken = said.groupBy("track", "needle").agg(F.max(hit).alias("found"))
    spoken = spoken.select("track", F.lit("text").alias("test"), F.col("needle").alias("item"), F.lit(1).cast("bigint").alias("expected"), "found")
    there = present.select("path").distinct().withColumn("found", F.lit(1).cast("bigint"))
    absent = forbidden.distinct().join(there, "path", "left").select(
        "track", F.lit("absent").alias("test"), F.col("path").alias("item"), F.lit(0).cast("bigint").alias("expected"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found")
    )
    return number.unionByName(spoken).unionByName(absent).withColumn("met", F.col("expected") == F.col("found"))


def missing_substrings(texts: DataFrame, needles: list[str]) -> DataFrame:
    """For each needle whether any text contains it: one pass, one row of flags."""
    found = texts.agg(*[F.max(F.contains("text", F.lit(n))).alias(f"n{i}") for i, n in enumerate(needles)])
    items = [F.struct(F.lit(n).alias("needle"), F.coalesce(f"n{i}", F.lit(False)).alias("found")) for i, n in enumerate(needles)]
    return found.select(F.inline(F.array(*items)))


def retry_chains(
    attempts: DataFrame, keys: list[str], order: list[str], failed: Column, retryable: Column,
    max_retries: int = MAX_RETRIES, chunk_rows: int | None = None,
) -> DataFrame:
    """Attempts cut into chains with an outcome each.

    A chain goes on after a retryable failure until max_retries retries were
    made. It ends with ok or recovered, exhausted, fatal, or open when the log
    stops.
    """
    again = F.coalesce(failed & retryable, F.lit(False))
    rows = Ordered(attempts.withColumns({"_again": again, "_bad": failed}), keys, order, chunk_rows)
    # An island is a run of attempts joined by retryable failures ...
    rows = rows.with_running(_prev=previous(F.col("_again")))
    rows = rows.with_column("_starts", F.when(F.coalesce("_prev", F.lit(False)), 0).otherwise(1).cast("bigint"))
    rows = rows.with_running(_island=running_sum(F.col("_starts")), _at=running_sum(F.lit(1).cast("bigint")))
    rows = rows.with_running(_first=last_upto(F.when(F.col("_starts") == 1, F.col("_at"))))
    # ... and a chain is a block of at most 1 + max_retries attempts of it.
    block = F.floor((F.col("_at") - F.col("_first")) / (1 + max_retries)).cast("bigint")
    chains = rows.frame().withColumn("chain", F.col("_island")).withColumn("block", block)
    ended = chains.groupBy(*keys, "chain", "block").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by(F.struct("_again", "_bad"), F.struct(*order)).alias("_end"),
    )
    outcome = (
        F.when(F.col("_end._again") & (F.col("attempts") > max_retries), "exhausted")
        .when(F.col("_end._again"), "open")
        .when(F.col("_end._bad"), "fatal")
        .when(F.col("attempts") > 1, "recovered")
        .otherwise("ok")
    )
    return ended.select(*keys, "chain", "block", "attempts", outcome.alias("outcome"))


def late_results(
    results: DataFrame, turns: DataFrame, key: str, at: str, tie: str, chunk_rows: int | None = None
) -> DataFrame:
    """Each result with the first turn of its session that starts at or after it.

    results(key, at, tie), turns(key, at, tie). Both go through one ordered pass in
    reverse time, so no result is compared with more than its own turn.
    """
    both = results.select(key, at, tie, F.lit(False).alias("_turn")).unionByName(
        turns.select(key, at, tie, F.lit(True).alias("_turn"))
    )
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    # Reverse time; at the same instant the turn comes first.
    both = both.withColumns({"_back": -micros, "_rank": F.when(F.col("_turn"), 0).otherwise(1), "_tie": -F.col(tie)})
    placed = Ordered(both, [key], ["_back", "_rank", "_tie"], chunk_rows).with_running(
        turn=last_upto(F.when(F.col("_turn"), F.col(tie)))
    )
    return placed.frame().filter(~F.col("_turn")).select(key, at, tie, "turn")


def idle_gaps(events: DataFrame, keys: list[str], order: list[str], at: Column, seconds: int,
              chunk_rows: int | None = None) -> DataFrame:
    """Sessions cut where nothing happens for `seconds`: batch twin of the streaming form."""
    rows = Ordered(events.withColumn("_us", F.unix_micros(at.cast("timestamp"))), keys, order, chunk_rows)
    rows = rows.with_running(_prev=previous(F.col("_us")))
    cold = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= seconds * 1_000_000)
    rows = rows.with_column("_starts", F.when(cold, 1).otherwise(0).cast("bigint"))
    return rows.with_running(visit=running_sum(F.col("_starts"))).frame().drop("_us", "_prev", "_starts")


def lookup_default(rows: DataFrame, dimension: DataFrame, key: str, column: str, default) -> DataFrame:
    joined = rows.join(small_side(dimension), key, "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(default)))


