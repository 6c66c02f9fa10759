"""Rows on their way to a stateful processor and back, many to one.

The engine hands rows to Python processors one at a time. So rows of a slot go there as Arrow batches, compressed, an entry
per slot and part of the input, and results come back as Arrow batches too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of the input that are dealt over the slots at once, and bytes of a batch of results.
PACK_ROWS, PACK_BYTES = 1 << 16, 8 << 20
FRAME_BYTES = 4 << 20


def packed(batch: pa.RecordBatch) -> bytes:
    raw = batch.serialize()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(stored: bytes, schema: pa.Schema) -> pa.RecordBatch:
    raw = pa.decompress(pa.py_buffer(stored)[8:], int.from_bytes(stored[:8], "little"), codec="zstd")
    return pa.ipc.read_record_batch(raw, schema)


def one_batch(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.concat_arrays([b.column(f.name).cast(f.type) for b in batches]) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def parts(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together to parts of bounded size."""
    held, n, nbytes = [], 0, 0
    for batch in batches:
        held, n, nbytes = [*held, batch], n + batch.num_rows, nbytes + batch.nbytes
        if n >= rows or nbytes >= size:
            yield held
            held, n, nbytes = [], 0, 0
    if held:
        yield held


def frames(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of results in batches of bounded size."""
    step = max(1, batch.num_rows * FRAME_BYTES // max(batch.nbytes, 1))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def to_slots(rows: DataFrame, schema: pa.Schema) -> DataFrame:
    """Rows (slot, columns of the schema) as packed batches (slot, rows), in the order in which they came."""
    names, wide = ["slot", "rows"], pa.schema([("slot", pa.int32()), *schema])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in parts((b for b in batches if b.num_rows), PACK_ROWS, PACK_BYTES):
            whole = one_batch(some, wide)
            slot = whole.column("slot").to_numpy()
            order = np.argsort(slot, kind="stable")
            slot, sorted_ = slot[order], whole.select(schema.names).take(pa.array(order))
            starts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
            made = [packed(sorted_.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(slot)])]
            yield pa.RecordBatch.from_arrays([pa.array(slot[starts], pa.int32()), pa.array(made, pa.binary())], names=names)
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks

    return rows.mapInArrow(pack, "slot int, rows binary")


def to_rows(found: DataFrame, schema: pa.Schema, returns: str) -> DataFrame:
    """Packed batches (rows) as their rows."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield unpacked(x.as_py(), schema)
        pa.default_memory_pool().release_unused()

    return found.mapInArrow(unpack, returns)
