"""Minimax contiguous partition of atomic groups into shards of near-equal bytes.

Equal texts form one atomic group. Groups stand in the order of their text hash, which spreads sizes evenly. The
smallest feasible shard capacity is found by binary search; a capacity is checked by filling shards greedily up to it,
and the final greedy fill gives the cuts.

The driver holds sums of hash buckets instead of groups. A group of more than a shard's fair share takes a shard of its own,
and the others are shared out among the rest. Within the range that the search can still reach, a cut can only fall
into few buckets; only these are read group by group, so the result equals that of a search over all groups. What the
driver reads is bounded: `MAX_BUCKETS` sums, at most `8 * shards` large groups, and the groups of about
`shards * shards / 2` buckets.

A document's shard then is an expression of its text hash. Slots are row numbers within small parts plus the counts of the parts
before, so no shard passes through one task.

Defined cases: a null text has no bytes and is grouped with the empty text; null and repeated ids are rows like any
other; with fewer groups than shards some shards stay empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talloom.llm.common import prepared, stored

SHARDS = 24
#: Fixed value: bytes counted for a row besides its text.
ROW_BYTES = 8
GROUPS_PER_BUCKET = 256
MAX_BUCKETS = 1 << 18
ROWS_PER_PART = 50_000


class _Units:
    """Consecutive groups or buckets: first hash, bytes before, bytes."""

    def __init__(self, units: list[tuple[int, int]]):
        self.keys = [k for k, _ in units]
        self.ends = list(accumulate(n for _, n in units))
        self.total = self.ends[-1] if units else 0

    def fill(self, capacity: int, shards: int) -> list[int] | None:
        """Units at which a new shard starts when each takes all that fits; None if shards run out."""
        cuts, done = [], 0
        while done < len(self.ends):
            before = self.ends[done - 1] if done else 0
            after = bisect_right(self.ends, before + capacity)
            if after == done or len(cuts) == shards - 1 and after < len(self.ends):
                return None
            done = after
            if done < len(self.ends):
                cuts.append(done)
        return cuts

    def capacity(self, shards: int, low: int, high: int) -> int:
        """Smallest capacity from low to high with a full fill."""
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low


def plan_cuts(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """Hashes of groups with a shard of their own, and the first hashes of the further shards but the first of them.

    groups: hash, bytes.
    """
    total, n = groups.agg(F.sum("bytes"), F.count("*")).first()
    if not n:
        return [], []
    bits = max(1, min(MAX_BUCKETS.bit_length() - 1, (n // GROUPS_PER_BUCKET).bit_length()))
    large = groups.where(F.col("bytes") > total // (8 * shards)).select("hash", "bytes").collect()
    own, left, rest = [], shards, total
    for row in sorted(large, key=lambda r: (-r["bytes"], r["hash"])):
        if left > 1 and row["bytes"] * left > rest:
            own.append(row["hash"])
            left, rest = left - 1, rest - row["bytes"]
    bucket = F.shiftright("hash", 64 - bits)
    others = groups.where(~F.col("hash").isin(own)) if own else groups
    sums = {r[0]: r[1] for r in others.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("n")).collect()}
    largest = others.agg(F.max("bytes")).first()[0] or 0
    details: dict[int, list[tuple[int, int]]] = {}

    def detail(wanted: set[int]) -> _Units:
        new = sorted(wanted - details.keys())
        if new:
            for b in new:
                details[b] = []
            for row in others.where(bucket.isin(new)).select(bucket.alias("b"), "hash", "bytes").collect():
                details[row["b"]].append((row["hash"], row["bytes"]))
        units: list[tuple[int, int]] = []
        for b in sorted(sums):
            units += sorted(details[b]) if b in details else [(b << (64 - bits), sums[b])]
        return _Units(units)

    units = detail({r["hash"] >> (64 - bits) for r in large if r["hash"] not in own})
    low = max(largest, -(-rest // left))
    high = units.capacity(left, low, max(rest, low))
    # where the cuts of any capacity from low to high can fall
    near, at, to = set(), 0, 0
    for _ in range(left - 1):
        at, to = bisect_right(units.ends, at + low), min(rest, to + high)
        if at >= len(units.ends):
            break
        near |= {k >> (64 - bits) for k in units.keys[at : bisect_left(units.ends, to) + 1]}
        at = units.ends[at - 1] if at else 0
    units = detail(near)
    best = units.capacity(left, low, high)
    return own, [units.keys[k] for k in units.fill(best, left)]


def shard_of(own: list[int], cuts: list[int]) -> Column:
    """Shard number by text hash."""
    further = F.lit(len(own))
    for cut in cuts:
        further = further + (F.col("hash") >= F.lit(cut)).cast("int")
    for k, value in enumerate(own):
        further = F.when(F.col("hash") == F.lit(value), F.lit(k)).otherwise(further)
    return further.cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    prepared(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("hash"),
        ),
        "sizes",
    )
    own, cuts = plan_cuts(stored(rows.groupBy("hash").agg(F.sum("size").alias("bytes")), "groups"), shards)
    parts = max(1, -(-rows.count() // ROWS_PER_PART))
    placed = rows.select("*", shard_of(own, cuts).alias("shard"), F.pmod(F.xxhash64("doc_id", "hash"), F.lit(parts)).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "hash", "text_crc32"))
    return placed.withColumn("number", number).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("number") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
