"""Requests and responses of a stream put together by key and time.

Keys are dealt over `SLOTS` slots by hash, and a slot is what the engine calls with. Rows of a slot that wait lie in map
state as Arrow batches, an entry per chunk of rows, and meet what arrives by sorted search: a row costs no state access of
its own. A request that nothing can answer any more comes out without a response, if it had none, and goes; so does a
response once all requests that it could answer have come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talloom.streaming.reorder import END, SLOTS

#: Arriving rows of a slot that are handled at once, rows of an entry of the state, and rows of a result frame.
PART_ROWS, CHUNK_ROWS, FRAME_ROWS = 1 << 20, 1 << 15, 1 << 16
#: The event times that the engine sees end here, as pandas has no later ones.
LATEST = "2262-01-01"


def _packed(pdf: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(stored: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(stored))).read_all().to_pandas()


def _pairs(requests: pd.DataFrame, responses: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of requests and of the responses to them, sent at or before them and due at or after them."""
    keyed = np.flatnonzero(requests["keyed"].to_numpy())
    n = len(keyed)
    codes = pd.factorize(pd.concat([requests["key"].iloc[keyed], responses["key"]]), use_na_sentinel=False)[0].astype(np.int64)
    times = [requests["us"].to_numpy()[keyed], requests["due"].to_numpy()[keyed], responses["us"].to_numpy()]
    rank = np.unique(np.concatenate(times), return_inverse=True)[1].astype(np.int64)
    place = np.concatenate([codes[:n], codes]) * (rank.max(initial=0) + 1) + rank  # by key, then by time
    order = np.argsort(place[:n], kind="stable")
    sent, due, told = place[:n][order], place[n : 2 * n][order], place[2 * n :]
    first, end = np.searchsorted(np.maximum.accumulate(due), told, "left"), np.searchsorted(sent, told, "right")
    hit = np.flatnonzero(end > first)
    counts = (end - first)[hit]
    until = np.cumsum(counts)
    a = 0
    while a < len(hit):
        b = max(int(np.searchsorted(until, (until[a - 1] if a else 0) + FRAME_ROWS, "right")), a + 1)
        some = counts[a:b]
        at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(first[hit[a:b]], some)
        r = np.repeat(hit[a:b], some)
        good = due[at] >= told[r]  # months differ in length, so that a later request may be due earlier
        yield keyed[order[at[good]]], r[good]
        a = b


class _Side:
    """Waiting rows of one side of a slot: those of the state, by chunk, and those that came since."""

    def __init__(self, state, chunks: list[int]):
        self.state, self.chunks = state, chunks
        self.frames = [_unpacked(state.getValue((c,))[0]) for c in chunks]
        self.changed = [False] * len(chunks)

    def add(self, pdf: pd.DataFrame) -> int:
        """Returns the place of the first of the rows."""
        start = sum(map(len, self.frames))
        if len(pdf):
            self.frames.append(pdf)
            self.changed.append(True)
        return start

    def rows(self) -> pd.DataFrame | None:
        return pd.concat(self.frames, ignore_index=True) if self.frames else None

    def drop(self, column: str, until: int) -> list[pd.DataFrame]:
        """Rows whose time is over; the others stay."""
        gone = []
        for i, pdf in enumerate(self.frames):
            over = pdf[column].to_numpy() <= until
            if over.any():
                gone.append(pdf[over])
                self.frames[i], self.changed[i] = pdf[~over].reset_index(drop=True), True
        return gone

    def mark(self, at: np.ndarray) -> None:
        """Note rows, by their places in `rows`, as answered."""
        start = 0
        for i, pdf in enumerate(self.frames):
            here = at[(at >= start) & (at < start + len(pdf))] - start
            here = here[~pdf["answered"].to_numpy()[here]]
            if len(here):
                answered = pdf["answered"].to_numpy().copy()
                answered[here] = True
                self.frames[i], self.changed[i] = pdf.assign(answered=answered), True
            start += len(pdf)

    def store(self, number: int) -> tuple[list[int], int]:
        """Entries that changed are written anew; `number` is the next free one."""
        kept, fresh = [], []
        for i, pdf in enumerate(self.frames):
            old = self.chunks[i] if i < len(self.chunks) else None
            if old is not None and not self.changed[i]:
                kept.append(old)
                continue
            if old is not None:
                self.state.removeKey((old,))
            fresh.append(pdf)
        rows = pd.concat(fresh, ignore_index=True) if fresh else []
        for c in range(0, len(rows), CHUNK_ROWS):
            self.state.updateValue((number,), (_packed(rows[c : c + CHUNK_ROWS]),))
            kept.append(number)
            number += 1
        return kept, number


class _Pairs(StatefulProcessor):
    """Rows of a slot: asked (whether a request), key, keyed (whether it has one), us (its time), due (of a request), and
    the columns of both sides. Results: key, keyed, us and columns of a request, found, and r_us and columns of a response."""

    def __init__(self, left: list[str], right: dict[str, object]):
        self.left, self.right = left, right  # of the right ones what stands for no value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getMapState("asked", "chunk int", "rows binary")
        self.told = handle.getMapState("told", "chunk int", "rows binary")
        # entries in use, the next free one, and the timer set
        self.plan = handle.getValueState("plan", "asked array<int>, told array<int>, next int, timer bigint")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[_Side, _Side]:
        asked, told, self.next, self.timer = self.plan.get() if self.plan.exists() else ([], [], 0, None)
        return _Side(self.asked, list(asked)), _Side(self.told, list(told))

    def _save(self, asked: _Side, told: _Side) -> None:
        """One timer at the first time, in milliseconds, at which a request or a response is over."""
        at = min((-(-int(f[n].min()) // 1000) for side, n in ((asked, "due"), (told, "us")) for f in side.frames if len(f)), default=None)
        entries, self.next = asked.store(self.next)
        more, self.next = told.store(self.next)
        if at != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.plan.clear()
        else:
            self.plan.update((entries, more, self.next, at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, told = self._load()
        held, size = [], 0
        for pdf in rows:
            held, size = [*held, pdf], size + len(pdf)
            if size >= PART_ROWS:
                yield from self._take(pd.concat(held, ignore_index=True), asked, told)
                held, size = [], 0
        if held:
            yield from self._take(pd.concat(held, ignore_index=True), asked, told)
        self._save(asked, told)

    def _take(self, pdf: pd.DataFrame, asked: _Side, told: _Side) -> Iterator[pd.DataFrame]:
        """New requests meet the responses so far, then new responses meet all requests so far."""
        is_asked = pdf["asked"].to_numpy().astype(bool)
        requests = pdf.loc[is_asked, ["key", "keyed", "us", "due", *self.left]].assign(answered=False).reset_index(drop=True)
        responses = pdf.loc[~is_asked, ["key", "us", *self.right]].reset_index(drop=True)
        before = told.rows()
        yield from self._meet(requests, before, asked, asked.add(requests))
        yield from self._meet(asked.rows(), responses, asked, 0)
        told.add(responses)

    def _meet(self, requests: pd.DataFrame | None, responses: pd.DataFrame | None, asked: _Side, start: int) -> Iterator[pd.DataFrame]:
        if requests is None or responses is None or not len(requests) or not len(responses):
            return
        answered = np.zeros(len(requests), bool)
        for q, r in _pairs(requests, responses):
            answered[q] = True
            out = {n: requests[n].to_numpy()[q] for n in ["key", "keyed", "us", *self.left]}
            out |= {"found": np.ones(len(q), bool), "r_us": responses["us"].to_numpy()[r]}
            yield pd.DataFrame(out | {n: responses[n].to_numpy()[r] for n in self.right})
        asked.mark(np.flatnonzero(answered) + start)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, told = self._load()
        self.timer = None  # it has fired
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for gone in asked.drop("due", now):
            left = gone.loc[~gone["answered"].to_numpy(), ["key", "keyed", "us", *self.left]].reset_index(drop=True)
            if len(left):
                yield left.assign(found=False, r_us=0, **self.right)
        told.drop("us", now)
        self._save(asked, told)


#: Types that pandas holds with gaps as other ones.
_FILLED = (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType)


def _plain(column: Column, kind: T.DataType, name: str) -> dict[str, tuple[Column, object]]:
    """A column for pandas, which must not change its values: by name the columns to send, and what stands for no value."""
    if not isinstance(kind, _FILLED) or isinstance(kind, T.DecimalType):
        return {name: (column, None)}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column, kind = F.unix_micros(column.cast("timestamp")), T.LongType()
    return {name: (F.coalesce(column, F.lit(0).cast(kind)), False if isinstance(kind, T.BooleanType) else 0), f"{name}_null": (column.isNull(), True)}


def _restored(name: str, kind: T.DataType, sent: dict) -> Column:
    column = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column = F.timestamp_micros(column)
    return F.when(~F.col(f"{name}_null"), column).cast(kind) if f"{name}_null" in sent else column


def paired(requests: DataFrame, responses: DataFrame, key: str, sent: str, received: str, timeout: str, delay: str) -> DataFrame:
    """Columns of requests and, but for the key, of responses: every request with each response of its key in the timeout.

    One that got none comes out with nulls once its time has passed. Rows behind the watermark are dropped by the engine.
    """
    kinds = [{f.name: f.dataType for f in side.schema} for side in (requests, responses)]
    q = {n: f"q{i}" for i, n in enumerate(x for x in kinds[0] if x not in (key, sent))}
    r = {n: f"r{i}" for i, n in enumerate(x for x in kinds[1] if x not in (key, received))}
    left, right = ({k: v for n in names for k, v in _plain(F.col(n), kind[n], names[n]).items()} for names, kind in zip((q, r), kinds))

    def side(rows: DataFrame, at: str, asked: bool) -> tuple[DataFrame, T.StructType]:
        us = F.unix_micros(F.col(at).cast("timestamp"))
        due = F.unix_micros((F.col(at) + F.expr(f"INTERVAL {timeout}")).cast("timestamp")) if asked else us
        own, other = (left, right) if asked else (right, left)
        columns = {n: c for n, (c, _) in own.items()}
        kept = rows.where(F.col(at).isNotNull() & (F.lit(asked) | F.col(key).isNotNull()))
        schema = kept.select(*[c.alias(n) for n, c in columns.items()]).schema
        timed = kept.select(
            F.least(F.col(at).cast("timestamp"), F.lit(LATEST).cast("timestamp")).alias("ts"), F.lit(asked).alias("asked"), F.col(key).alias("key"),
            us.alias("us"), due.alias("due"), *[c.alias(n) for n, c in columns.items()],
        ).withWatermark("ts", delay)
        # a row at the end of time moves the watermark only; without `ts` the test would move below that
        timed = timed.where((F.col("ts") < F.lit(LATEST).cast("timestamp")) | (F.col("us") < F.unix_micros(F.lit(END).cast("timestamp"))))
        return timed, schema

    asked, left_schema = side(requests, sent, True)
    told, right_schema = side(responses, received, False)
    for n, (_, none) in right.items():
        asked = asked.withColumn(n, F.lit(none).cast(right_schema[n].dataType))
    for n, (_, none) in left.items():
        told = told.withColumn(n, F.lit(none).cast(left_schema[n].dataType))
    rows = asked.unionByName(told)
    key_kind = rows.schema["key"].dataType
    sent_key = _plain(F.col("key"), key_kind, "key")
    # requests without a key meet nothing, and need not be together
    slot = F.pmod(F.xxhash64("key", F.when(F.col("key").isNull(), F.col("us"))), F.lit(SLOTS)).cast("int")
    rows = rows.select("ts", slot.alias("slot"), "asked", F.col("key").isNotNull().alias("keyed"), sent_key["key"][0].alias("key"), "us", "due", *left, *right)
    fields = lambda names: [T.StructField(n, rows.schema[n].dataType) for n in names]
    returns = T.StructType([
        *fields(["key", "keyed", "us", *left]), T.StructField("found", T.BooleanType()), T.StructField("r_us", T.LongType()), *fields(right),
    ])
    found = rows.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=_Pairs(list(left), {n: none for n, (_, none) in right.items()}), outputStructType=returns,
        outputMode="append", timeMode="eventTime",
    )
    restored_key = F.timestamp_micros("key") if isinstance(key_kind, (T.TimestampType, T.TimestampNTZType)) else F.col("key")
    out = {key: F.when(F.col("keyed"), restored_key).cast(kinds[0][key]), sent: F.timestamp_micros("us").cast(kinds[0][sent])}
    out |= {n: _restored(q[n], kinds[0][n], left) for n in q}
    back = {received: F.timestamp_micros("r_us").cast(kinds[1][received])} | {n: _restored(r[n], kinds[1][n], right) for n in r}
    return found.select(
        *[out[n].alias(n) for n in kinds[0]], *[F.when(F.col("found"), back[n]).alias(n) for n in kinds[1] if n != key],
    )
