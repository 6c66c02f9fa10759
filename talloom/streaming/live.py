"""Idle sessions, ticks, request matching, budgets, streaks and late results on streams."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from talloom.operators.ordered import Ordered, running_sum
from talloom.streaming.pairs import paired
from talloom.streaming.reorder import InOrder, in_order
from talloom.streaming.run import held_map, waiting_rows

# -- windows ------------------------------------------------------------------------


def idle_sessions(calls: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """Visits of a session, closed once nothing came for the gap. Event time must be timestamp."""
    visit = F.session_window(at, gap)
    counted = calls.withWatermark(at, delay).groupBy(key, visit).agg(F.count(F.lit(1)).alias("calls"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls")


def ticks(calls: DataFrame, at: str, interval: str, amount: Column, delay: str) -> DataFrame:
    """One row per tick of fixed length with its calls and amount."""
    tick = F.window(at, interval)
    counted = calls.withWatermark(at, delay).groupBy(tick).agg(F.count(F.lit(1)).alias("calls"), F.sum(amount).alias("amount"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "calls", "amount")


def bounded_ticks(closed: DataFrame, max_ticks: int, max_amount: int) -> DataFrame:
    """Ticks from the start until the tick count or the running amount reaches its limit.

    closed(start, calls, amount) has one row per tick. The limit on ticks is a
    top-k, so the running sum only ever sees max_ticks rows.
    """
    first = closed.orderBy("start").limit(max_ticks).withColumn("_all", F.lit(0))
    rows = Ordered(first, ["_all"], ["start"]).with_running(
        _before=running_sum(F.col("amount"), inclusive=False), total=running_sum(F.col("amount"))
    )
    return rows.frame().filter(F.col("_before") < max_amount).drop("_all", "_before")


def open_windows(spark: SparkSession, state: str, *columns: str) -> DataFrame:
    """Windows that a stopped stream of `idle_sessions` or `ticks` still holds, with the columns of the closed ones.

    columns: names of the aggregates, in the order of the operator.
    """
    rows = spark.read.format("statestore").load(state)
    value = rows.schema["value"].dataType.names
    if "session_window" in value:
        own = [n for n in rows.schema["key"].dataType.names if n != "sessionStartTime"]
        window, rest = "value.session_window", [n for n in value if n != "session_window" and n not in own]
    else:
        own = [n for n in rows.schema["key"].dataType.names if n != "window"]
        window, rest = "key.window", value
    aggregates = [F.col(f"value.`{n}`").alias(c) for n, c in zip(rest, columns, strict=True)]
    return rows.select(*[F.col(f"key.`{n}`") for n in own], F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("end"), *aggregates)


def correlate_rpc_stream(
    requests: DataFrame, responses: DataFrame, key: str, sent: str, received: str, timeout: str, delay: str
) -> DataFrame:
    """Each request with its response within the timeout, or nulls once that has passed."""
    return paired(requests, responses, key, sent, received, timeout, delay)


# -- running state --------------------------------------------------------------------
#
# Streams that need the order of rows give results (`kind` is done) and rows that came after their time had passed
# (late), see `reorder`. What waits or is open when a stream stops is read from its state.


class _Budget(InOrder):
    state = "total bigint, turns bigint, alerted boolean"
    fields = {"amount": "bigint", "turn": "boolean"}
    returns = {"seq": "bigint", "total": "bigint", "turns": "bigint", "reason": "string"}

    def __init__(self, max_amount: int, max_turns: int):
        self.max_amount, self.max_turns = max_amount, max_turns

    def fold(self, key, pdf, held):
        total, turns, alerted = held or (0, 0, False)
        turn = pdf["turn"].to_numpy().astype(bool)
        totals = total + pdf["amount"].to_numpy().cumsum()
        counts = turns + turn.cumsum()
        over = turn & ((totals >= self.max_amount) | (counts >= self.max_turns))
        out = []
        if over.any() and not alerted:
            i = int(over.argmax())
            reason = "cost" if totals[i] >= self.max_amount else "turns"
            out = [pd.DataFrame({"seq": [int(pdf["seq"].iloc[i])], "total": [int(totals[i])], "turns": [int(counts[i])], "reason": [reason]})]
        return (int(totals[-1]), int(counts[-1]), bool(alerted or over.any())), out


def usage_stream(usage: DataFrame, max_amount: int, max_turns: int, delay: str = "1 hour") -> DataFrame:
    """One alert per session at its first call over a limit. usage(session, ts, seq, amount, turn)."""
    return in_order(usage, _Budget(max_amount, max_turns), delay)


class _Streak(InOrder):
    state = "run bigint, total bigint"
    fields = {"denied": "boolean"}
    returns = {"seq": "bigint", "total": "bigint", "run": "bigint", "limit_reached": "boolean"}

    def __init__(self, max_run: int, max_total: int):
        self.max_run, self.max_total = max_run, max_total

    def fold(self, key, pdf, held):
        run, total = held or (0, 0)
        denied = pdf["denied"].to_numpy().astype(np.int64)
        totals = total + denied.cumsum()
        # The total at the last allowed call; before any, the run so far counts.
        resets = np.where(denied == 0, totals, total - run)
        base = np.maximum.accumulate(resets)
        runs = totals - base
        limit = (denied == 1) & ((runs >= self.max_run) | (totals >= self.max_total))
        out = pd.DataFrame({"seq": pdf["seq"].to_numpy(), "total": totals, "run": runs, "limit_reached": limit})
        return (int(runs[-1]), int(totals[-1])), [out]


def streaks_stream(decisions: DataFrame, max_run: int, max_total: int, delay: str = "1 hour") -> DataFrame:
    """Denial streaks, row by row. decisions(session, ts, seq, denied)."""
    return in_order(decisions, _Streak(max_run, max_total), delay)


class _Late(InOrder):
    """Gives every result to the first turn at or after it. Results without a turn so far are parts in map state."""

    state = "parts bigint"
    fields = {"is_turn": "boolean"}
    by = ("us", "is_turn", "seq")  # a turn comes after the results of its instant
    returns = {"seq": "bigint", "turn": "bigint"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "session bigint, part bigint", "seqs array<bigint>")

    def fold(self, key, pdf, held):
        turn, seq = pdf["is_turn"].to_numpy().astype(bool), pdf["seq"].to_numpy()
        out = []
        if turn.any():
            first = int(turn.argmax())
            if held and held[0]:
                for part in range(held[0]):
                    out.append(self._given(self.open.getValue((key, part))[0], seq[first]))
                    self.open.removeKey((key, part))
            # the place of the next turn of every row
            place = np.where(turn, np.arange(len(seq)), len(seq))
            follows = np.minimum.accumulate(place[::-1])[::-1]
            settled = ~turn & (follows < len(seq))
            out.append(pd.DataFrame({"seq": seq[settled], "turn": seq[follows[settled]]}))
            rest = seq[~turn & (follows == len(seq))]
            held = (0,)
        else:
            rest = seq
        if len(rest):
            parts = held[0] if held else 0
            self.open.updateValue((key, parts), (rest.tolist(),))
            held = (parts + 1,)
        return held, out

    @staticmethod
    def _given(part, turn) -> pd.DataFrame:
        return pd.DataFrame({"seq": part, "turn": int(turn)})


def late_results_stream(rows: DataFrame, delay: str) -> DataFrame:
    """Results and turns of sessions, rows (session, ts, seq, is_turn), as (session, seq, turn).

    A result is given to the first turn at or after it once no earlier turn can
    still arrive.
    """
    return in_order(rows, _Late(), delay)


def unsettled_results(spark: SparkSession, state: str) -> DataFrame:
    """Results that a stopped stream of late results has not given to a turn yet, as (session, seq)."""
    waiting = waiting_rows(spark, state).where("NOT is_turn").select("session", "seq")
    return waiting.unionByName(held_map(spark, state, "open").select("session", F.explode("seqs").alias("seq")))


class _Retry(InOrder):
    state = "attempts bigint, first bigint, open boolean"
    fields = {"bad": "boolean", "again": "boolean"}
    returns = {"seq": "bigint", "first": "bigint", "attempts": "bigint", "outcome": "string"}

    def __init__(self, max_retries: int):
        self.max_retries = max_retries

    def fold(self, key, pdf, held):
        attempts, first, open_ = held or (0, 0, False)
        again, bad, seq = pdf["again"].to_numpy().astype(bool), pdf["bad"].to_numpy().astype(bool), pdf["seq"].to_numpy()
        # a chain starts after each row that is not tried again; what is left open goes before the first rows
        at = np.arange(len(seq))
        begins = np.concatenate([[not open_], ~again[:-1]])
        chain_start = np.maximum.accumulate(np.where(begins, at, -1))
        place = np.where(chain_start < 0, at + attempts, at - chain_start)  # attempts made before, without cuts
        size = 1 + self.max_retries
        ends = ~again | (place % size == size - 1)
        start = np.where(place % size <= at, at - place % size, -1)
        firsts = np.where(start < 0, first, seq[np.maximum(start, 0)])
        tries = place % size + 1
        outcome = np.select([again, bad, tries > 1], ["exhausted", "fatal", "recovered"], "ok")
        out = pd.DataFrame({"seq": seq, "first": firsts, "attempts": tries, "outcome": outcome})[ends]
        still = not ends[-1]
        return (int(tries[-1]) if still else 0, int(firsts[-1]) if still else 0, bool(still)), [out]


def retry_stream(attempts: DataFrame, max_retries: int = 3, delay: str = "1 hour") -> DataFrame:
    """Retry chains as they end, seq being the last attempt. attempts(session, ts, seq, bad, again)."""
    return in_order(attempts, _Retry(max_retries), delay)


def open_chains(spark: SparkSession, state: str) -> DataFrame:
    """Chains that a stopped retry stream has begun and not ended: (session, first, attempts)."""
    return held_map(spark, state, "held").where("open").select("session", "first", "attempts")


# -- requests, responses and exits ------------------------------------------------------

SALTS = 8
_REQUEST, _RESPONSE, _EXIT = 0, 1, 2


class _Rpc(InOrder):
    """Requests of servers with their responses; what gets none in time fails with the server's next exit.

    What a slot holds open is read once per passed time and written once: requests that were not answered yet, or are overdue
    without an exit so far, in chunks of rows, and the exits since the oldest request of their server. Between that a row
    costs a lookup in memory, whatever the number of servers.
    """

    fields = {"what": "int", "id": "bigint", "failed": "boolean"}
    by = ("us", "what", "seq")
    returns = {"seq": "bigint", "id": "bigint", "status": "string", "exit_us": "bigint"}

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        columns = f"servers array<{self.key_type}>, ids array<bigint>, us array<bigint>, overdue array<boolean>"
        self.sent = handle.getMapState("sent", "chunk int", columns)
        self.gone = handle.getMapState("gone", "chunk int", f"servers array<{self.key_type}>, us array<bigint>")
        self.plan = handle.getValueState("plan", "sent int, gone int, due bigint")

    def _bucket_end(self, us: int) -> int:
        return ((us // 1000 + self.timeout) // self.bucket_ms + 1) * self.bucket_ms

    def wake(self) -> int | None:
        return self.plan.get()[2] if self.plan.exists() else None

    def describe(self, late: pd.DataFrame) -> pd.DataFrame:
        named = late["what"].map({_REQUEST: "late request", _RESPONSE: "late response", _EXIT: "late exit"})
        return pd.DataFrame({"seq": late["seq"], "id": late["id"], "status": named})

    def load(self) -> None:
        """waits: (server, id) -> time sent; overdue: server -> ids; exits: server -> times."""
        self.waits, self.overdue, self.exits = {}, {}, {}
        self.chunks = self.plan.get()[:2] if self.plan.exists() else (0, 0)
        for chunk in range(self.chunks[0]):
            for server, id_, us, over in zip(*self.sent.getValue((chunk,))):
                if over:
                    self.overdue.setdefault(server, []).append(id_)
                else:
                    self.waits[server, id_] = us
        for chunk in range(self.chunks[1]):
            for server, us in zip(*self.gone.getValue((chunk,))):
                self.exits.setdefault(server, []).append(us)

    def store(self) -> None:
        rows = [(s, i, us, False) for (s, i), us in self.waits.items()] + [(s, i, None, True) for s, ids in self.overdue.items() for i in ids]
        gone = [(s, us) for s, times in self.exits.items() for us in times]
        for state, rows_, before in ((self.sent, rows, self.chunks[0]), (self.gone, gone, self.chunks[1])):
            cuts = range(0, len(rows_), self.frame_rows)
            for chunk, c in enumerate(cuts):
                state.updateValue((chunk,), tuple(list(x) for x in zip(*rows_[c : c + self.frame_rows])))
            for chunk in range(len(cuts), before):
                state.removeKey((chunk,))
        if rows or gone:
            due = self._bucket_end(min(self.waits.values())) if self.waits else None
            self.plan.update((-(-len(rows) // self.frame_rows), -(-len(gone) // self.frame_rows), due))
        else:
            self.plan.clear()

    def fold_frame(self, rows: list[tuple]) -> list[tuple]:
        found = []
        for us, _, server, what, id_, failed in rows:
            if what == _REQUEST:
                self.waits[server, id_] = us
            elif what == _RESPONSE:
                sent = self.waits.get((server, id_))
                if sent is not None and us <= sent + 1000 * self.timeout:
                    found.append((server, id_, "error" if failed else "ok", None))
                    del self.waits[server, id_]
            else:
                self.exits.setdefault(server, []).append(us)
                found += [(server, i, "server exited", us) for i in self.overdue.pop(server, ())]
        return self._results(found)

    def settle(self, now_ms: int) -> list[tuple]:
        """Fails requests that are overdue, once every row before their due time was folded."""
        found, oldest = [], {}
        for (server, id_), us in list(self.waits.items()):
            if self._bucket_end(us) > now_ms:
                oldest[server] = min(us, oldest.get(server, us))
                continue
            del self.waits[server, id_]
            exits = self.exits.get(server, [])
            at = bisect_left(exits, us)
            if at < len(exits):
                found.append((server, id_, "server exited", exits[at]))
            else:
                self.overdue.setdefault(server, []).append(id_)
        # exits before the oldest open request of their server concern none
        kept = {s: times[bisect_left(times, oldest[s]) :] for s, times in self.exits.items() if s in oldest}
        self.exits = {s: times for s, times in kept.items() if times}
        return self._results(found)

    @staticmethod
    def _results(found: list[tuple]) -> list[tuple]:
        if not found:
            return []
        servers, ids, status, exits = (list(x) for x in zip(*found))
        return [(servers, pd.DataFrame({"id": ids, "status": status, "exit_us": pd.Series(exits, dtype=object)}))]


def rpc_rows(requests: DataFrame, responses: DataFrame, exits: DataFrame) -> DataFrame:
    """Requests (server, id, ts), responses (server, id, ts, failed) and exits (server, ts) as one stream.

    Requests of a server are dealt over SALTS keys by id and its few exits go to all of them, so that a busy server is
    not one task.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    no, seq = F.lit(False).alias("failed"), F.col("id").alias("seq")
    asked = requests.select("server", salt, "ts", seq, F.lit(_REQUEST).alias("what"), "id", no)
    told = responses.select("server", salt, "ts", seq, F.lit(_RESPONSE).alias("what"), "id", "failed")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    gone = exits.select(
        "server", every, "ts", F.lit(0).cast("bigint").alias("seq"), F.lit(_EXIT).alias("what"), F.lit(0).cast("bigint").alias("id"), no
    )
    return asked.unionByName(told).unionByName(gone)


def correlate_rpc_exits_stream(rows: DataFrame, timeout_ms: int, delay: str) -> DataFrame:
    """Settled requests of `rpc_rows` as (session: the server, id, status, exit_us): ok, error or server exited.

    A request without a response in time fails with the first exit of its server since it was sent; until there is one
    it is a timeout, see `unanswered`. An id is used once per server.
    """
    return in_order(rows, _Rpc(timeout_ms), delay, ("server", "salt"))


def unanswered(spark: SparkSession, state: str) -> DataFrame:
    """Requests that a stopped stream has not settled, as (session, id, status): timeout, or pending while a response can come."""
    held = held_map(spark, state, "sent").select(F.inline(F.arrays_zip("servers", "ids", "overdue"))).select(
        F.col("servers").alias("session"), F.col("ids").alias("id"), F.when(F.col("overdue"), "timeout").otherwise("pending").alias("status")
    )
    waiting = waiting_rows(spark, state).where(f"what = {_REQUEST}").select(F.col("server").alias("session"), "id", F.lit("pending").alias("status"))
    return held.unionByName(waiting)
