"""Blocks put together from rows that arrive in any order, over hours, more than once, or never.

Replies are dealt over `SLOTS` slots by hash, and a slot is what the engine calls with: a call, its timer and the small
ledger of its open replies serve all replies of the slot. Rows come and results go as packed Arrow batches (`packed`). Rows
of blocks that are not whole yet wait in map state, one packed entry for all that an arriving part leaves of its slot, and
are read once: when the first row, the last row and as many rows as lie between them are there. An entry goes with the last
block that waits in it. Every reply has a time at which it is given up: when nothing arrived for it during the quiet time,
what is not whole comes out as `lost`, and its state goes. A row that comes after that opens the reply anew, and is lost in
turn once the reply falls silent again; so no row vanishes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talloom.streaming.packed import frames, one_batch, packed, parts, to_rows, to_slots, unpacked
from talloom.streaming.reorder import END, SLOTS

#: Values of `edge`: a row begins a block, ends it, or both.
FIRST, LAST = 1, 2
#: A reply that sends nothing for so long is given up.
QUIET = "10 minutes"
#: Rows and bytes of one slot that are handled at once.
PART_ROWS, PART_BYTES = 100_000, 32 << 20
#: Bytes of entries that a call keeps at hand.
HELD_BYTES = 64 << 20

_NEVER = np.iinfo(np.int64).max


def _schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


class _Quiet(StatefulProcessor):
    """A processor with a ledger of the open replies of a slot, and one timer at the first time that one is given up.

    A reply of the ledger is a list: the time at which it is given up, its number in the slot, and what the subclass knows.
    Rows that wait lie in entries, sorted by the number of their reply; the ledger counts for each who waits in it.
    """

    #: Columns of arriving rows, of entries, and of results.
    arriving: pa.Schema
    waiting: pa.Schema
    returns: pa.Schema
    #: Results of plain columns go as they are, which spares a Python process that unpacks them.
    plain = False

    def __init__(self, quiet_ms: int):
        self.quiet, self.part_rows, self.part_bytes = quiet_ms, PART_ROWS, PART_BYTES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", "replies string, entries string, next bigint, timer bigint")
        self.stored = handle.getMapState("waiting", "entry bigint", "rows binary")

    def close(self) -> None:
        pa.default_memory_pool().release_unused()

    def _load(self) -> None:
        replies, entries, self.next, self.timer = self.ledger.get() if self.ledger.exists() else ("[]", "[]", 0, None)
        self.replies: dict[str | None, list] = {name: entry for name, *entry in json.loads(replies)}
        self.entries: dict[int, int] = dict(json.loads(entries))
        self.held: dict[int, pa.RecordBatch] = {}

    def _save(self) -> None:
        at = min((entry[0] for entry in self.replies.values()), default=None)
        if at != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if at is not None:
                self.handle.registerTimer(at)
        if at is None:
            self.ledger.clear()
        else:
            replies = json.dumps([[name, *entry] for name, entry in self.replies.items()])
            self.ledger.update((replies, json.dumps(list(self.entries.items())), self.next, at))
        self.held = {}

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _entry(self, name: str | None, known) -> list:
        if name not in self.replies:
            self.replies[name] = [0, self._number(), known]
        return self.replies[name]

    # -- entries --------------------------------------------------------------------

    def _put(self, batch: pa.RecordBatch, users: int) -> int:
        number = self._number()
        self.stored.updateValue((number,), (packed(batch),))
        self.entries[number] = users
        return number

    def _get(self, number: int) -> pa.RecordBatch:
        if number not in self.held:
            self.held[number] = unpacked(bytes(self.stored.getValue((number,))[0]), self.waiting)
            while len(self.held) > 1 and sum(b.nbytes for b in self.held.values()) > HELD_BYTES:
                del self.held[next(iter(self.held))]
        return self.held[number]

    def _leave(self, number: int) -> None:
        self.entries[number] -= 1
        if not self.entries[number]:
            self.stored.removeKey((number,))
            self.held.pop(number, None)
            del self.entries[number]

    # -- calls ----------------------------------------------------------------------

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        batches = (unpacked(x, self.arriving) for pdf in rows for x in pdf["rows"].tolist())
        for some in parts(batches, self.part_rows, self.part_bytes):
            batch = one_batch(some, self.arriving)
            coded = batch.column("stream_id").dictionary_encode(null_encoding="encode")
            names, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            yield from self._frames(self.take(batch, names, place))
            latest = np.full(len(names), np.iinfo(np.int64).min)
            np.maximum.at(latest, place, batch.column("us").to_numpy())
            for name, us in zip(names, latest.tolist()):
                entry = self.replies[name]
                entry[0] = max(us // 1000 + self.quiet, entry[0])
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        self.timer = None  # it has fired
        now = timerValues.getCurrentWatermarkInMs()
        over = [name for name, entry in self.replies.items() if entry[0] < now]  # a time is over once the watermark is beyond it
        yield from self._frames(self.give_up([(name, *self.replies.pop(name)) for name in over]))
        self._save()

    def _frames(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in frames(batch):
                yield some.to_pandas() if self.plain else pd.DataFrame({"rows": [packed(some)]})

    # take: rows with the names of their replies and the place of each row among these;
    # give_up: replies as (name, time, number, known), which are no longer in the ledger

    def take(self, batch: pa.RecordBatch, names: list, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def give_up(self, replies: list[tuple]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def _between(values: np.ndarray, value: int, a: int, b: int) -> tuple[int, int]:
    """Where a value stands in a stretch of sorted ones."""
    return a + int(np.searchsorted(values[a:b], value, "left")), a + int(np.searchsorted(values[a:b], value, "right"))


class _Reply(_Quiet):
    """Per block the ledger knows: rows that wait, their entries, the places of the first and the last row as far as
    known, and whether it is whole."""

    arriving = _schema(stream_id=pa.string(), us=pa.int64(), seq=pa.int64(), block=pa.int64(), edge=pa.int32(), item=pa.string())
    waiting = _schema(reply=pa.int64(), block=pa.int64(), seq=pa.int64(), edge=pa.int32(), item=pa.string())
    returns = _schema(
        kind=pa.string(), stream_id=pa.string(), block=pa.int64(), missing=pa.int64(),
        seqs=pa.list_(pa.int64()), edges=pa.list_(pa.int32()), items=pa.list_(pa.string()),
    )

    def take(self, batch: pa.RecordBatch, names: list, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        for name in names:
            self._entry(name, {})
        came = np.flatnonzero(batch.column("block").is_valid().to_numpy(zero_copy_only=False))
        if not len(came):
            return
        block, seq, edge = (batch.column(n).take(pa.array(came)).to_numpy() for n in ("block", "seq", "edge"))
        place, arrived = place[came], seq
        order = np.lexsort((seq, block, place))  # stable: of repeated rows the first that came is first
        place, block, seq, edge = place[order], block[order], seq[order], edge[order]
        begins = np.r_[True, (np.diff(place) != 0) | (np.diff(block) != 0)]
        starts = np.flatnonzero(begins)
        firsts, lasts = (self._edge(arrived, np.where(edge & mark > 0, order, _NEVER), starts) for mark in (FIRST, LAST))
        distinct = begins | np.r_[True, np.diff(seq) != 0]
        group = (np.cumsum(begins) - 1)[distinct]
        counts = np.bincount(group)
        rows = batch.take(pa.array(came[order[distinct]]))  # distinct rows, by reply, block and place
        cuts = np.r_[0, np.cumsum(counts)].tolist()
        whole, waits, found, again = [], [], [], []
        for k, (p, b, n) in enumerate(zip(place[starts].tolist(), block[starts].tolist(), counts.tolist())):
            _, number, blocks = self.replies[names[p]]
            known = blocks.setdefault(str(b), [0, [], None, None, False])  # names in JSON are strings
            if known[4]:
                continue
            count, entries = known[0] + n, known[1]
            first = known[2] if firsts[k] is None else firsts[k]
            last = known[3] if lasts[k] is None else lasts[k]
            known[:] = [count, entries, first, last, False]
            if first is None or last is None or count <= last - first:
                waits.append((k, number, known))
            elif not entries:  # what came in one piece is never stored
                if n == last - first + 1:
                    known[4] = True
                    whole.append(k)
                else:
                    waits.append((k, number, known))
            else:
                merged = self._merged(number, b, entries, rows.slice(cuts[k], n))
                for e in entries:
                    self._leave(e)
                known[:] = [merged.num_rows, [], first, last, merged.num_rows == last - first + 1]
                if known[4]:
                    found.append((names[p], b, 0, merged))
                else:  # repeated rows are not kept, or they would be counted again
                    again.append((number, b, known, merged))
        if whole:
            chosen = np.zeros(len(starts), bool)
            chosen[whole] = True
            own = rows.filter(pa.array(chosen[group]))
            at = starts[whole]
            yield self._rows("whole", [names[p] for p in place[at].tolist()], block[at], np.zeros(len(at), np.int64), counts[whole], own)
        if found:
            yield self._listed("whole", found)
        if waits or again:
            self._wait(rows, group, cuts, waits, again)

    def _wait(self, rows: pa.RecordBatch, group: np.ndarray, cuts: list[int], waits: list, again: list) -> None:
        """What is not whole becomes one entry."""
        numbers = np.full(len(cuts) - 1, -1)
        for k, number, _ in waits:
            numbers[k] = number
        of = numbers[group]
        kept = rows.filter(pa.array(of >= 0))
        made = [pa.RecordBatch.from_arrays([pa.array(of[of >= 0]), *(kept.column(n) for n in self.waiting.names[1:])], schema=self.waiting)]
        for number, block, _, merged in again:
            columns = [pa.array(np.full(merged.num_rows, x)) for x in (number, block)]
            made.append(pa.RecordBatch.from_arrays([*columns, *merged.columns], schema=self.waiting))
        batch = one_batch(made, self.waiting)
        order = np.lexsort((batch.column("seq").to_numpy(), batch.column("block").to_numpy(), batch.column("reply").to_numpy()))
        entry = self._put(batch.take(pa.array(order)), len(waits) + len(again))
        for known in [x[2] for x in [*waits, *again]]:
            known[1].append(entry)

    @staticmethod
    def _edge(arrived: np.ndarray, marked: np.ndarray, starts: np.ndarray) -> list[int | None]:
        """Per block the place of the first marked row that came."""
        at = np.minimum.reduceat(marked, starts)
        known = at < _NEVER
        return [s if k else None for s, k in zip(arrived[np.where(known, at, 0)].tolist(), known.tolist())]

    def _merged(self, number: int, block: int, entries: list[int], *more: pa.RecordBatch) -> pa.RecordBatch:
        """Distinct rows (seq, edge, item) of a block by place, with those of its entries; of repeated ones the first that came."""
        schema = pa.schema([self.waiting.field(n) for n in ("seq", "edge", "item")])
        batch = one_batch([*(self._own(e, number, block) for e in entries), *more], schema)
        _, at = np.unique(batch.column("seq").to_numpy(), return_index=True)
        return batch.take(pa.array(at))

    def _own(self, entry: int, number: int, block: int) -> pa.RecordBatch:
        batch = self._get(entry)
        a, b = _between(batch.column("reply").to_numpy(), number, 0, batch.num_rows)
        a, b = _between(batch.column("block").to_numpy(), block, a, b)
        return batch.slice(a, b - a)

    def _rows(self, kind: str, names: list, blocks, missing, counts, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Blocks whose rows follow each other in a batch."""
        ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, rows.column(n)) for n in ("seq", "edge", "item")]
        columns = [pa.array([kind] * len(names)), pa.array(names, pa.string()), pa.array(blocks, pa.int64()), pa.array(missing, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *lists], schema=self.returns)

    def _listed(self, kind: str, found: list[tuple]) -> pa.RecordBatch:
        names, blocks, missing, rows = zip(*found)
        return self._rows(kind, list(names), blocks, missing, [r.num_rows for r in rows], one_batch(list(rows), rows[0].schema))

    def give_up(self, replies: list[tuple]) -> Iterator[pa.RecordBatch]:
        lost = [
            (known[1], number, int(block), name, known[2], known[3])
            for name, _, number, blocks in replies for block, known in blocks.items() if not known[4]
        ]
        found, size = [], 0
        for entries, number, block, name, first, last in sorted(lost, key=lambda x: x[:3]):  # those of an entry follow each other
            rows = self._merged(number, block, entries)
            missing = last - first + 1 - rows.num_rows if first is not None and last is not None else None
            found.append((name, block, missing, rows))
            size += rows.nbytes
            for e in entries:
                self._leave(e)
            if size >= self.part_bytes:
                yield self._listed("lost", found)
                found, size = [], 0
        if found:
            yield self._listed("lost", found)


def _quiet_ms(rows: DataFrame, quiet: str) -> int:
    seconds = rows.sparkSession.sql(f"SELECT CAST(INTERVAL {quiet} AS INTERVAL SECOND) AS s").first()["s"]
    return int(1000 * seconds.total_seconds())


def _through(rows: DataFrame, processor: _Quiet, returns: str) -> DataFrame:
    timed = rows.withWatermark("arrived", "0 seconds").where(F.col("arrived") < F.lit(END).cast("timestamp"))
    timed = timed.withColumn("us", F.unix_micros("arrived")).withColumn("slot", F.pmod(F.xxhash64("stream_id"), F.lit(SLOTS)).cast("int"))
    dealt = to_slots(timed.select("slot", *processor.arriving.names), processor.arriving)
    found = dealt.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=returns if processor.plain else "rows binary", outputMode="append", timeMode="eventTime",
    )
    return found if processor.plain else to_rows(found, processor.returns, returns)


def assembled(rows: DataFrame, quiet: str = QUIET) -> DataFrame:
    """Blocks of rows (stream_id, arrived, seq, block, edge, item): kind (whole, lost), missing, and their rows in order.

    missing: how many rows of a lost block did not come, null where its first or last row is among them.
    """
    narrow = rows.select("stream_id", "arrived", "seq", "block", F.col("edge").cast("int").alias("edge"), "item")
    returns = "kind string, stream_id string, block bigint, missing bigint, seqs array<bigint>, edges array<int>, items array<string>"
    return _through(narrow, _Reply(_quiet_ms(rows, quiet)), returns)


# -- raw bytes --------------------------------------------------------------------------

#: Ends of lines. A carriage return at the end of what came may be half of one.
_LINE_END = re.compile(rb"\r\n|\n|\r(?!\Z)")


def _bytes(column: pa.BinaryArray) -> tuple[list[int], memoryview]:
    """Offsets of binary values and what they point into."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    return ends, memoryview(data if data is not None else b"")


class _Framer(_Quiet):
    """Cuts the bytes of a reply into events, wherever the pieces were cut. Pieces ahead of their turn wait by number.

    The ledger knows of a reply the next piece, the next event, the bytes of a begun line, the lines of a begun event, and
    its entries with the first piece that waits in each.
    """

    arriving = _schema(stream_id=pa.string(), us=pa.int64(), piece=pa.int64(), bytes=pa.binary())
    waiting = _schema(reply=pa.int64(), piece=pa.int64(), bytes=pa.binary())
    returns = _schema(kind=pa.string(), stream_id=pa.string(), us=pa.int64(), seq=pa.int64(), payload=pa.string())
    plain = True

    def take(self, batch: pa.RecordBatch, names: list, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        piece = batch.column("piece").to_numpy()
        order = np.lexsort((piece, place))  # stable: of repeated pieces the first that came is first
        piece, place = piece[order], place[order]
        distinct = np.r_[True, (np.diff(place) != 0) | (np.diff(piece) != 0)]
        order, piece, place = order[distinct], piece[distinct], place[distinct]
        given = batch.column("bytes").take(pa.array(order))
        latest = np.full(len(names), np.iinfo(np.int64).min)
        np.maximum.at(latest, place, batch.column("us").to_numpy()[order])
        (ends, data), pieces = _bytes(given), piece.tolist()
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        jumps = np.flatnonzero(np.r_[np.diff(place) != 0, True] | np.r_[np.diff(piece) != 1, True])
        runs = (jumps[np.searchsorted(jumps, starts)] + 1).tolist()  # where the first run of consecutive pieces of a reply ends
        out, left = [], []
        for p, a, b, run in zip(place[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(place)], runs):
            name = names[p]
            _, number, known = self._entry(name, [0, 0, "", [], []])
            due, got = known[0], []
            if pieces[a] == due:  # the usual case
                got.append(data[ends[a] : ends[run]])
                due, a = due + run - a, run
            while a < b and pieces[a] < due:  # repeated ones are done with
                a += 1
            if known[4] and known[4][0][1] <= due or a < b and pieces[a] == due:
                due = self._gather(number, due, known[4], {pieces[i]: data[ends[i] : ends[i + 1]] for i in range(a, b)}, got)
                while a < b and pieces[a] < due:
                    a += 1
            known[0] = due
            if a < b:
                left.append((a, b, number, known))
            if got:
                out += [(name, int(latest[p]), seq, payload) for seq, payload in self._cut(known, got)]
        if left:
            left.sort(key=lambda x: x[2])
            at = np.concatenate([np.arange(a, b) for a, b, _, _ in left])
            numbers = np.repeat([x[2] for x in left], [b - a for a, b, _, _ in left])
            entry = self._put(pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(piece[at]), given.take(pa.array(at))], schema=self.waiting), len(left))
            for a, _, _, known in left:
                known[4] = sorted([*known[4], [entry, pieces[a]]], key=lambda x: x[1])
        if out:
            yield self._rows("event", out)

    def _gather(self, number: int, due: int, entries: list, fresh: dict, got: list) -> int:
        """Adds pieces whose turn it is, from those that came and from entries; returns the next piece. entries: by first piece."""
        found, read = fresh, []
        while True:
            while due in found:
                got.append(found.pop(due))
                due += 1
            if not entries or entries[0][1] > due:
                break
            entry = entries.pop(0)[0]
            there = self._own(entry, number)
            read.append((entry, list(there)))
            found = there | found
        for entry, numbers in read:
            waits = next((x for x in numbers if x >= due), None)
            if waits is None:
                self._leave(entry)
            else:
                entries.append([entry, waits])
        entries.sort(key=lambda x: x[1])
        return due

    def _own(self, entry: int, number: int) -> dict[int, memoryview]:
        """Pieces of a reply in an entry, in order."""
        batch = self._get(entry)
        a, b = _between(batch.column("reply").to_numpy(), number, 0, batch.num_rows)
        ends, data = _bytes(batch.column("bytes").slice(a, b - a))
        return dict(zip(batch.column("piece").to_numpy()[a:b].tolist(), (data[x:y] for x, y in zip(ends, ends[1:]))))

    @staticmethod
    def _cut(known: list, got: list) -> list[tuple]:
        """Events that end within the pieces; the rest of them is kept."""
        _, seq, rest, data, _ = known
        *lines, left = _LINE_END.split(b"".join([rest.encode("latin-1"), *got]))
        out = []
        for line in lines:
            if not line and data:
                out.append((seq, "\n".join(data)))
                seq, data = seq + 1, []
            elif line.startswith(b"data:"):
                data.append(line[5:].removeprefix(b" ").decode("utf-8", "replace"))
        known[1:4] = [seq, left.decode("latin-1"), data]
        return out

    def _rows(self, kind: str, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, f.type) for x, f in zip(zip(*found), list(self.returns)[1:])]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(found)), *columns], schema=self.returns)

    def give_up(self, replies: list[tuple]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for name, at, number, (due, seq, rest, data, entries) in replies:
            left = ["\n".join(data)] if data else []
            left += [rest.encode("latin-1").decode("utf-8", "replace")] if rest else []
            waiting = {}
            for entry, _ in sorted(entries):
                waiting |= {k: x for k, x in self._own(entry, number).items() if k >= due}
                self._leave(entry)
            left += [bytes(waiting[x]).decode("utf-8", "replace") for x in sorted(waiting)]
            found += [(name, at * 1000, seq + i, x) for i, x in enumerate(left)]
            size += sum(map(len, left))
            if size >= self.part_bytes:
                yield self._rows("rest", found)
                found, size = [], 0
        if found:
            yield self._rows("rest", found)


def framed(pieces: DataFrame, quiet: str = QUIET) -> DataFrame:
    """Events of raw replies (stream_id, arrived, piece, bytes): kind, stream_id, arrived, seq, payload.

    Pieces are numbered from 0 and may be cut at any byte. An event ends at a blank line; the lines of its data are joined.
    What a silent reply leaves, an event without its end or pieces behind a gap, has kind `rest`.
    """
    returns = "kind string, stream_id string, us bigint, seq bigint, payload string"
    found = _through(pieces.select("stream_id", "arrived", "piece", "bytes"), _Framer(_quiet_ms(pieces, quiet)), returns)
    return found.select("kind", "stream_id", F.timestamp_micros("us").alias("arrived"), "seq", "payload")
