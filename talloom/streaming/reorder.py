"""Rows of a key in time order, over micro-batches of any cut: the reorder buffer of the stateful processors.

Keys are dealt over `SLOTS` slots by hash, and a slot is what the engine calls with: a call, its timer and its state
entries serve all keys of the slot, so a stream costs by its rows, not by its number of keys.

Rows wait in map state. Every arriving frame is sorted and becomes a run, an entry per chunk of rows; time is counted in
buckets of `BUCKET_MS`. When the watermark has passed a bucket, the runs that reach into passed time are merged, one chunk of
each at a time, and handed on in frames of bounded size, cut by session: a session is never one list, and nothing is sorted
but the rows of one arriving frame. What of a chunk has not passed yet stays in its entry; sparse sessions have one entry, not one per time.

Rows that arrive after their bucket has passed come out as rows of kind `late`, beside the results of kind `done`. For
that the engine must not drop them: the event time column ends at the watermark, and rows go on with `us` alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNK_ROWS = 2_048
FRAME_ROWS = 32_768
BUCKET_MS = 60_000
SLOTS = 1_024

#: Time that no row has. A row at this time ends the input, see `run.with_end`.
END = "9000-01-01 00:00:00"


def _plain(column: pd.Series, kind: str | None) -> list:
    """Python values for a state; pandas holds whole numbers with gaps as floats."""
    if column.dtype.kind == "f" and kind in ("int", "bigint"):
        return [None if x != x else int(x) for x in column.tolist()]
    return column.tolist()


class InOrder(StatefulProcessor):
    """Folds the rows of a key in order of `by`. Subclasses state their fields, held state and `fold`.

    Columns of the rows: us (event time in microseconds), seq, the key columns, and `fields`. `fold(session, frame, held)`
    gives the new held state of a session and a list of result frames; frames of a session come in order.
    """

    fields: dict[str, str] = {}
    state = "seen bigint"
    by = ("us", "seq")
    returns: dict[str, str] = {}
    keys, key_type = ("session",), "bigint"
    bucket_ms, chunk_rows, frame_rows = BUCKET_MS, CHUNK_ROWS, FRAME_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.types = {"us": "bigint", "seq": "bigint"} | {k: self.key_type for k in self.keys} | self.fields
        self.names = list(self.types)
        self.held = handle.getMapState("held", f"session {self.key_type}", self.state)
        self.waiting = handle.getMapState("waiting", "run bigint, chunk int", ", ".join(f"{n} array<{t}>" for n, t in self.types.items()))
        # open runs with their next chunk, number of chunks and earliest time; the number of the next run; the timer set
        self.index = handle.getValueState(
            "index", "runs array<bigint>, heads array<int>, ends array<int>, firsts array<bigint>, next bigint, timer bigint"
        )

    def close(self) -> None:
        pass

    # -- arriving rows ------------------------------------------------------------

    def _open(self) -> tuple[dict[int, tuple[int, int, int]], int, int | None]:
        """Open runs as (next chunk, number of chunks, earliest time), the next run number, and the timer."""
        if not self.index.exists():
            return {}, 0, None
        runs, heads, ends, firsts, number, timer = self.index.get()
        return dict(zip(runs, zip(heads, ends, firsts))), number, timer

    def _save(self, open_: dict[int, tuple[int, int, int]], number: int, timer: int | None, wake: int | None) -> None:
        """Keep the index, with one timer at the end of the first bucket that holds rows or at `wake`, in milliseconds."""
        ends = [(min(x[2] for x in open_.values()) // (1000 * self.bucket_ms) + 1) * self.bucket_ms] if open_ else []
        at = min(ends + ([wake] if wake is not None else []), default=None)
        if at is not None:
            at -= 1  # a timer fires once the watermark is beyond it
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.index.clear()
        else:
            columns = [list(x) for x in zip(*open_.values())] if open_ else [[], [], []]
            self.index.update((list(open_), *columns, number, at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues)
        open_, number, timer = self._open()
        for pdf in rows:
            if passed is not None:
                late = pdf["us"].to_numpy() // (1000 * self.bucket_ms) < passed
                if late.any():
                    behind = pdf[late]
                    yield self.frame("late", [(_plain(behind[self.keys[0]], self.key_type), self.describe(behind))])
                if late.all():
                    continue
                pdf = pdf[~late]
            pdf = pdf.sort_values(list(self.by), kind="stable")
            columns = [_plain(pdf[n], self.types[n]) for n in self.names]
            cuts = range(0, len(pdf), self.chunk_rows)
            for chunk, c in enumerate(cuts):
                self.waiting.updateValue((number, chunk), tuple(x[c : c + self.chunk_rows] for x in columns))
            open_[number] = (0, len(cuts), columns[0][0])
            number += 1
        self._save(open_, number, timer, self.wake())

    # -- passed rows --------------------------------------------------------------

    def passed(self, timerValues) -> int | None:
        """Buckets below this number have passed; None before the first watermark."""
        watermark = timerValues.getCurrentWatermarkInMs()
        return watermark // self.bucket_ms if watermark > 0 else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues)
        open_, number, _ = self._open()
        if passed is not None:
            self.load()
            until = passed * self.bucket_ms * 1000
            left: dict[int, tuple[int, list]] = {}
            due = [run for run, (_, _, first) in open_.items() if first < until]
            rows = heapq.merge(*[self._before(run, *open_[run][:2], until, left) for run in due], key=itemgetter(*[self.names.index(n) for n in self.by]))
            while part := list(islice(rows, self.frame_rows)):
                if out := self.fold_frame(part):
                    yield self.frame("done", out)
            for run in due:
                head, end, _ = open_.pop(run)
                at, rest = left.get(run, (end, []))
                for chunk in range(head, at):
                    self.waiting.removeKey((run, chunk))
                if rest:
                    self.waiting.updateValue((run, at), tuple(list(x) for x in zip(*rest)))
                    open_[run] = (at, end, rest[0][0])
            if out := self.settle(passed * self.bucket_ms):
                yield self.frame("done", out)
            self.store()
        self._save(open_, number, None, self.wake())

    def _before(self, run: int, head: int, end: int, until: int, left: dict[int, tuple[int, list]]) -> Iterator[tuple]:
        """Rows of a run before a time, chunk by chunk; notes in `left` the chunk at which it stops, and its other rows."""
        for chunk in range(head, end):
            rows = list(zip(*self.waiting.getValue((run, chunk))))
            for i, row in enumerate(rows):
                if row[0] >= until:
                    left[run] = (chunk, rows[i:])
                    return
                yield row

    # -- for subclasses -----------------------------------------------------------

    def load(self) -> None:
        """Before rows of the slot are folded."""
        self.states: dict = {}
        self.changed: set = set()

    def fold_frame(self, rows: list[tuple]) -> list[tuple]:
        """Result frames of rows of the slot in order, each with its session."""
        pdf, out = pd.DataFrame(rows, columns=self.names), []
        for session, part in pdf.groupby(pd.Series([r[2] for r in rows], dtype=object), sort=False, dropna=False):
            session = None if pd.isna(session) else session
            if session not in self.states:
                self.states[session] = self.held.getValue((session,)) if self.held.containsKey((session,)) else None
            before = self.states[session]
            held, found = self.fold(session, part.reset_index(drop=True), before)
            if held is not None and held != before:
                self.states[session] = held
                self.changed.add(session)
            out += [(session, x) for x in found if len(x)]
        return out

    def store(self) -> None:
        """After rows of the slot were folded."""
        for session in self.changed:
            self.held.updateValue((session,), self.states[session])

    def fold(self, session, pdf: pd.DataFrame, held):
        raise NotImplementedError

    def settle(self, now_ms: int) -> list[tuple]:
        """After all rows before a time were folded: what follows from the time alone."""
        return []

    def wake(self) -> int | None:
        """A time in milliseconds at which `settle` must run though no row waits."""
        return None

    def describe(self, late: pd.DataFrame) -> pd.DataFrame:
        """Late rows as result columns."""
        return late[["seq"]]

    def frame(self, kind: str, found: list[tuple]) -> pd.DataFrame:
        """Rows of the result schema from frames with their session, or list of sessions; columns that a kind does not have are null."""
        sessions = [s for own, x in found for s in (own if isinstance(own, list) else [own] * len(x))]

        def column(name: str) -> np.ndarray:
            parts = [x[name].to_numpy() if name in x.columns else np.full(len(x), None, object) for _, x in found]
            kinds = {p.dtype.kind for p in parts}
            return np.concatenate(parts if len(kinds) == 1 else [p.astype(object) for p in parts])

        return pd.DataFrame({"kind": kind, "session": sessions} | {n: column(n) for n in self.returns}, index=range(len(sessions)))


def in_order(rows: DataFrame, processor: InOrder, delay: str, keys: tuple[str, ...] = ("session",), key_type: str = "bigint") -> DataFrame:
    """Rows (keys, ts, seq, fields) through a processor: kind, session, and the columns that it returns.

    keys: the first one is the session; more of them only deal its rows over several slots.
    """
    # set here, on the driver, so that the processor takes them along to the workers
    processor.bucket_ms, processor.chunk_rows, processor.frame_rows = BUCKET_MS, CHUNK_ROWS, FRAME_ROWS
    processor.keys, processor.key_type = keys[:1], key_type
    timed = rows.withWatermark("ts", delay).where(F.col("ts") < F.lit(END).cast("timestamp"))
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int").alias("slot")
    timed = timed.withColumn("us", F.unix_micros("ts")).select(slot, "us", "seq", keys[0], *processor.fields)
    schema = f"kind string, session {key_type}, " + ", ".join(f"{n} {t}" for n, t in processor.returns.items())
    return timed.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime",
    )


def done(results: DataFrame) -> DataFrame:
    """Results proper of a stream that tells late rows apart."""
    return results.where("kind = 'done'").drop("kind")


def late(results: DataFrame) -> DataFrame:
    """Rows that came after their time had passed, as (session, seq)."""
    return results.where("kind = 'late'").select("session", "seq")
