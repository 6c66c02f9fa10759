"""Exact removal of byte strings that an earlier document already holds.

A byte goes if it lies in a string of `width` bytes that also starts in a document with a smaller id. The work is cut
three ways so that no task sees more than a share:

1. Texts are packed into chunks, stored once. Every window of `width` bytes is routed by the smallest hash of the
   grams inside it, so equal windows meet whatever text they come from (`windows.window_runs`). First only these
   hashes travel, once per chunk: most belong to one document and need no further work.
2. Runs of windows under a shared hash travel as byte strings, one per chunk and distinct string, with the smallest id
   that holds it. Copies therefore meet as one string per chunk, however many they are. Each route builds a
   Burrows-Wheeler transform over its strings and finds the classes of equal windows by breadth-first backward
   extension that stops at `width` (`windows.prefix_classes`). A string alone under its hash has no partner.
3. One bit per window goes back to its chunk, where removed runs, kept bytes and digests are made.

The number of routes follows the bytes of the input, so that a route holds about `ROUTE_BYTES` of text. So does the
number of tasks that routes and chunks are dealt to, whatever the session's number of shuffle partitions is: what a
task reads does not grow with the input.

Defined cases: a null text is empty; a null id ranks behind all others, so such a row removes nothing from rows with
an id; rows with equal ids never remove from each other; texts shorter than `width` stay whole; an empty table gives no
rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import give_back, prepared, stored
from talloom.llm.windows import prefix_classes, window_runs

WIDTH = 50
CHUNK_BYTES = 1 << 20
ROUTE_BYTES = 12 << 20
#: Tasks per route; above one, so that few tasks get several routes. More than MAX_TASKS would cost the scheduler more than they save.
TASKS_PER_ROUTE = 2
MAX_TASKS = 50_000
NO_ID = np.iinfo(np.int64).max


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def chunk_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts in chunks of about CHUNK_BYTES: chunk, ids, where each text ends, and the bytes, compressed."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []

        def flush() -> pd.DataFrame:
            ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
            return pd.DataFrame({
                "chunk": [part << 32 | number], "n_bytes": [int(ends[-1])], "ids": [np.array(ids, np.int64).tobytes()],
                "ends": [ends.tobytes()], "data": [_pack(b"".join(texts))],
            })

        held = 0
        for batch in batches:
            for doc, text_ in zip(batch["doc_id"], batch["text"]):
                ids.append(NO_ID if pd.isna(doc) else int(doc))
                texts.append(text_.encode("utf-8", "surrogatepass") if isinstance(text_, str) else b"")
                held += len(texts[-1]) + 64
                if held >= CHUNK_BYTES:
                    yield flush()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield flush()

    # ids as text, because pandas would turn whole numbers beside nulls into floats
    rows = docs.select(F.col(f"`{id_col}`").cast("long").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInPandas(pack, "chunk long, n_bytes long, ids binary, ends binary, data binary")


def _opened(row) -> tuple[np.ndarray, bytes, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), _unpack(row.data), np.frombuffer(row.ends, np.int64)


def _routes_of(hashes: np.ndarray, routes: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(routes)).astype(np.int64)


def _dealt(rows: DataFrame, key: str, routes: int) -> DataFrame:
    """Rows by a key, in a number of partitions that follows the input. Groupings and joins on the key need no other shuffle."""
    return rows.repartition(min(TASKS_PER_ROUTE * routes, MAX_TASKS), key)


def _chunk_hashes(raw: bytes, ends: np.ndarray, width: int):
    """Runs of a chunk and its distinct hashes in ascending order, with the place of each run's hash."""
    first, count, text, hashes = window_runs(np.frombuffer(raw, np.uint8), ends, width)
    distinct, place = np.unique(hashes, return_inverse=True)
    return first, count, text, distinct, place


def shared_hashes(chunks: DataFrame, routes: int, width: int = WIDTH) -> DataFrame:
    """Per chunk and route: a bit for each of the chunk's distinct hashes there, set if two documents hold it."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, raw, ends = _opened(row)
                _, _, text, distinct, place = _chunk_hashes(raw, ends, width)
                if not len(distinct):
                    continue
                least = np.full(len(distinct), NO_ID)
                most = np.full(len(distinct), np.iinfo(np.int64).min)
                np.minimum.at(least, place, ids[text])
                np.maximum.at(most, place, ids[text])
                route = _routes_of(distinct, routes)
                by = np.argsort(route, kind="stable")
                cuts = np.searchsorted(route[by], np.arange(routes + 1))
                low, several = distinct.astype(np.uint32), least < most
                made = [(r, by[a:b]) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pd.DataFrame({
                    "route": [r for r, _ in made], "chunk": row.chunk, "low": [low[x].tobytes() for _, x in made],
                    "several": [np.packbits(several[x]).tobytes() for _, x in made],
                })
            give_back()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        low = [np.frombuffer(x, np.uint32) for x in group["low"]]
        every = np.concatenate(low)
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(x)).astype(bool) for s, x in zip(group["several"], low)])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        size = np.diff(start, append=len(ordered))
        shared = (size > 1) | np.logical_or.reduceat(several[order], start)
        flags = np.empty(len(every), bool)
        flags[order] = np.repeat(shared, size)
        cuts = np.cumsum([0, *map(len, low)])
        return pd.DataFrame({
            "route": group["route"], "chunk": group["chunk"],
            "bits": [np.packbits(flags[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])],
        })

    sent = chunks.mapInPandas(send, "route long, chunk long, low binary, several binary")
    return _dealt(sent, "route", routes).groupBy("route").applyInPandas(meet, "route long, chunk long, bits binary")


def _strings(raw: bytes, ends: np.ndarray, ids: np.ndarray, flags: list, routes: int, width: int):
    """Runs under shared hashes, and per route the distinct strings in a fixed order with the smallest id of each."""
    first, count, text, distinct, place = _chunk_hashes(raw, ends, width)
    shared = np.zeros(len(distinct), bool)
    route = _routes_of(distinct, routes)
    bits = {f["route"]: f["bits"] for f in flags}
    by = np.argsort(route, kind="stable")
    cuts = np.searchsorted(route[by], np.arange(routes + 1))
    for r, packed in bits.items():
        at = by[cuts[r] : cuts[r + 1]]
        shared[at] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(at)).astype(bool)
    keep = shared[place]
    first, count, text, place = first[keep], count[keep], text[keep], place[keep]
    number: dict[tuple[int, bytes], int] = {}
    of = np.fromiter(
        (number.setdefault((h, raw[a : a + n + width - 1]), len(number)) for h, a, n in zip(place.tolist(), first.tolist(), count.tolist())),
        np.int64, len(first),
    )
    least = np.full(len(number), NO_ID)
    np.minimum.at(least, of, ids[text])
    return first, text, of, list(number), least, distinct, route


def equal_windows(joined: DataFrame, routes: int, width: int = WIDTH) -> DataFrame:
    """Per chunk and route: a bit for each window of its strings, set if a smaller id holds an equal window."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.flags is None or not len(row.flags):
                    continue
                ids, raw, ends = _opened(row)
                _, _, _, strings, least, distinct, route = _strings(raw, ends, ids, row.flags, routes, width)
                if not strings:
                    continue
                place = np.fromiter((p for p, _ in strings), np.int64, len(strings))
                order = np.argsort(route[place], kind="stable")
                cuts = np.searchsorted(route[place][order], np.arange(routes + 1))
                made = [(r, order[a:b]) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pd.DataFrame({
                    "route": [r for r, _ in made], "chunk": row.chunk,
                    "hashes": [distinct[place[x]].tobytes() for _, x in made], "least": [least[x].tobytes() for _, x in made],
                    "sizes": [np.array([len(strings[k][1]) for k in x], np.int64).tobytes() for _, x in made],
                    "data": [_pack(b"".join([strings[k][1] for k in x])) for _, x in made],
                })
            give_back()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        group = group.sort_values("chunk")
        number: dict[bytes, int] = {}
        of, own, hashes, rows = [], [], [], []
        for row in group.itertuples(index=False):
            raw, ends = _unpack(row.data), np.cumsum(np.frombuffer(row.sizes, np.int64)).tolist()
            of.append(np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends)), np.int64, len(ends)))
            own.append(np.frombuffer(row.least, np.int64))
            hashes.append(np.frombuffer(row.hashes, np.uint64))
            rows.append(len(ends))
        every, mine = np.concatenate(of), np.concatenate(own)
        least = np.full(len(number), NO_ID)
        np.minimum.at(least, every, mine)
        key = np.empty(len(number), np.uint64)
        key[every] = np.concatenate(hashes)
        strings = list(number)
        del number
        windows = np.array([len(x) - width + 1 for x in strings], np.int64)
        begin = np.cumsum(windows) - windows
        lowest = np.repeat(least, windows)  # of each window, so far from its own string
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[back] > 1)
        if len(several):
            data = np.frombuffer(b"".join([strings[k] for k in several]), np.uint8)
            sizes = windows[several] + width - 1
            order, starts = prefix_classes(data, width)
            string = np.repeat(np.arange(len(several)), sizes)
            offset = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            valid = offset < windows[several][string]  # suffixes that hold a whole window
            value = np.where(valid, least[several][string], NO_ID)[order]
            begins = np.flatnonzero(starts)
            best = np.repeat(np.minimum.reduceat(value, begins), np.diff(begins, append=len(data)))
            at = order[valid[order]]
            lowest[begin[several][string[at]] + offset[at]] = best[valid[order]]
        out, k = [], 0
        for n in rows:
            ids = every[k : k + n]
            size = windows[ids]
            place = np.repeat(begin[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append(np.packbits(lowest[place] < np.repeat(mine[k : k + n], size)).tobytes())
            k += n
        return pd.DataFrame({"route": group["route"], "chunk": group["chunk"], "bits": out})

    sent = joined.mapInPandas(send, "route long, chunk long, hashes binary, least binary, sizes binary, data binary")
    return _dealt(sent, "route", routes).groupBy("route").applyInPandas(meet, "route long, chunk long, bits binary")


RESULT = "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _settle(joined: DataFrame, routes: int, width: int) -> DataFrame:
    """Removed runs and digests of every document, from the bits that came back."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, raw, ends = _opened(row)
                depth = np.zeros(len(raw) + 1, np.int32)
                if row.flags is not None and len(row.flags):
                    first, text, of, strings, least, _, route = _strings(raw, ends, ids, row.flags, routes, width)
                    place = np.fromiter((p for p, _ in strings), np.int64, len(strings))
                    size = np.fromiter((len(s) - width + 1 for _, s in strings), np.int64, len(strings))
                    at = route[place]
                    order = np.argsort(at, kind="stable")
                    cuts = np.searchsorted(at[order], np.arange(routes + 1))
                    begin = np.cumsum(size) - size
                    hit = np.zeros(int(size.sum()), bool)
                    for found in row.found if row.found is not None else ():
                        mine = order[cuts[found["route"]] : cuts[found["route"] + 1]]
                        n = size[mine]
                        where = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        hit[where] = np.unpackbits(np.frombuffer(found["bits"], np.uint8), count=len(where)).astype(bool)
                    n = size[of]
                    where = np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    window = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    # a document behind the smallest holder of its string loses the whole string
                    gone = window[hit[where] | np.repeat(ids[text] > least[of], n)]
                    depth[gone] += 1
                    ending = gone + width
                    depth -= np.bincount(ending, minlength=len(raw) + 1).astype(np.int32)
                covered = np.cumsum(depth[:-1]) > 0
                edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
                # texts touch in the chunk: cut runs at text ends
                start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                out = []
                begin_ = 0
                for doc, end in zip(ids.tolist(), ends.tolist()):
                    body = raw[begin_:end]
                    a, b = np.searchsorted(stop, begin_, "right"), np.searchsorted(start, end, "left")
                    # an empty text inside a run has none of it
                    runs = [(max(s, begin_) - begin_, min(e, end) - begin_) for s, e in zip(start[a:b].tolist(), stop[a:b].tolist()) if min(e, end) > max(s, begin_)]
                    pieces, last = [], 0
                    for s, e in runs:
                        pieces.append(body[last:s])
                        last = e
                    pieces.append(body[last:])
                    out.append((
                        str(doc), xxhash.xxh64(body, seed=42).intdigest().to_bytes(8, "little"), len(body), sum(e - s for s, e in runs), len(runs),
                        hashlib.sha256(b"".join(pieces)).hexdigest(), [{"start": s, "end": e} for s, e in runs],
                    ))
                    begin_ = end
                frame = pd.DataFrame(out, columns=["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
                frame["text_hash"] = [int.from_bytes(x, "little", signed=True) for x in frame["text_hash"]]
                yield frame
            give_back()

    made = joined.mapInPandas(settle, RESULT.replace("doc_id long", "doc_id string"))
    doc = F.col("doc_id").cast("long")
    return made.withColumn("doc_id", F.when(doc != int(NO_ID), doc))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of what is left, and the runs themselves.

    `text_hash` is the xxhash64 of the text, for joining back where ids repeat.
    """
    prepared(docs.sparkSession)
    chunks = stored(chunk_texts(docs, id_col, text), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    routes = max(12, -(-total // ROUTE_BYTES))

    def by_chunk(bits: DataFrame, name: str) -> DataFrame:
        return _dealt(bits, "chunk", routes).groupBy("chunk").agg(F.collect_list(F.struct("route", "bits")).alias(name))

    flags = by_chunk(stored(shared_hashes(chunks, routes, width), "shared"), "flags")
    joined = _dealt(chunks, "chunk", routes).join(flags, "chunk", "left")
    found = by_chunk(stored(equal_windows(joined, routes, width), "equal"), "found")
    return _settle(joined.join(found, "chunk", "left"), routes, width)


def without_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with removed runs cut out of `text` and `n_chars` counted anew; emptied ones go.

    Runs are narrowed to whole characters, so that the text stays valid. Rows that were empty before stay.
    """
    found = duplicate_spans(docs, width=width).where("n_removed > 0")
    spans = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    spans = spans.dropDuplicates(["_id", "_hash"])
    # own columns travel packed, whatever their names are
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    whole = packed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, r) for t, r in zip(texts, runs)], dtype="object")

    shorter = whole.withColumn("text", F.when(F.col("_spans").isNotNull(), cut("text", "_spans")).otherwise(F.col("text")))
    kept = shorter.where(F.col("_spans").isNull() | (F.col("text") != "")).select(
        *[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    )
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept


def _cut(text: str | None, runs) -> str | None:
    if text is None or runs is None:
        return text
    raw, pieces, last = text.encode("utf-8", "surrogatepass"), [], 0
    for run in runs:
        start, end = run["start"], run["end"]
        while start < end and raw[start] & 0xC0 == 0x80:  # begin with a whole character
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(raw[last:start])
        last = max(last, end)
    pieces.append(raw[last:])
    return b"".join(pieces).decode("utf-8", "surrogatepass")
