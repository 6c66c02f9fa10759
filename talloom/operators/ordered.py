"""Running values over ordered groups that may be far larger than one task.

A plain window puts a whole group into one task. `Ordered` keeps that form
while the input is small or no group is large. Otherwise it cuts each large group into
consecutive chunks, computes the running value inside every chunk and adds what
the earlier chunks of the group contribute (the carry). All supported values
are associative, so both forms give the same rows, in columns of the same types.

Borders are looked for once, and the rows with their chunks are stored once: every
later value of the same `Ordered` reads the columns it needs from there. An operator
that takes an `Ordered` goes on with its chunks, so a chain of operators has one
border job, whatever its length.

Chunk borders are the order values of rows chosen by a hash, so they
depend on the data alone: a lost executor recomputes the same chunks, and two
branches of one plan agree. About rows / chunk_rows borders exist, which bounds
what is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talloom.session import must_split, reliable

CHUNK_ROWS = 2_000_000
# Groups with fewer borders, a few million rows, stay whole.
MIN_BORDERS = 3
MAX_BROADCAST_ROWS = 2_000_000
# Text that a task of a window over long texts sorts.
TASK_BYTES = 16 << 20

_CHUNK = "_chunk"
_HOT = "_hot"


@dataclass(frozen=True)
class Running:
    """One running value: kind is sum, last, previous or max."""

    kind: str
    value: Column
    inclusive: bool = True


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_count() -> Running:
    return Running("sum", F.lit(1).cast("bigint"))


def last_upto(value: Column) -> Running:
    """Last non-null value at or before the row."""
    return Running("last", value)


def last_before(value: Column) -> Running:
    """Last non-null value strictly before the row."""
    return Running("last", value, inclusive=False)


def previous(value: Column) -> Running:
    """Value of the directly preceding row, nulls included."""
    return Running("previous", value, inclusive=False)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def wide_tasks(rows: DataFrame, value: str) -> int | None:
    """How many tasks rows with a long text need, or None if the plan's own number will do.

    Adaptive execution joins shuffle partitions by their compressed size; repetitive texts are a small part of what a
    task that sorts them then holds. So their bytes are measured.
    """
    held = rows.agg(F.sum(F.octet_length(value).cast("bigint"))).first()[0] or 0
    return max(held // TASK_BYTES, rows.sparkSession.sparkContext.defaultParallelism) if held > TASK_BYTES else None


class Ordered:
    """A frame with group keys and a total order inside each group.

    tasks: over how many tasks groups are dealt, see `wide_tasks`; else adaptive execution chooses.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        chunk_rows: int | None = None,
        tasks: int | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        self.columns = list(df.columns)
        borders = None
        if chunk_rows is not None or must_split(df):
            borders = self._borders(df, chunk_rows or CHUNK_ROWS)
        self.split = borders is not None
        self.df = reliable(self._cut(df, borders), "chunks") if self.split else df
        if tasks is not None:
            self.df = self.df.repartition(tasks, *self._groups())

    @classmethod
    def over(cls, rows: DataFrame | Ordered, keys: Sequence[str], order: Sequence[str], chunk_rows: int | None = None) -> Ordered:
        """Rows in order; an `Ordered` with these keys and this order is gone on with."""
        if isinstance(rows, DataFrame):
            return cls(rows, keys, order, chunk_rows)
        return rows if (rows.keys, rows.order) == (list(keys), list(order)) else cls(rows.frame(), keys, order, chunk_rows)

    # -- chunks ---------------------------------------------------------

    def _borders(self, df: DataFrame, chunk_rows: int) -> DataFrame | None:
        """Sorted borders of each large group, or None if no group is large."""
        position = F.struct(*self.order)
        chosen = F.pmod(F.xxhash64(*self.keys, *self.order), F.lit(chunk_rows)) == 0
        borders = (
            df.filter(chosen)
            .groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.keys])
            .agg(F.array_sort(F.collect_set(position)).alias("_borders"))
            .filter(F.size("_borders") >= MIN_BORDERS)
        )
        return _small_table(borders, F.sum(F.size("_borders")))

    def _cut(self, df: DataFrame, borders: DataFrame) -> DataFrame:
        return df.join(borders, self._same_key(), "left").select(
            *self.columns,
            F.col("_borders").isNotNull().alias(_HOT),
            _borders_below(F.col("_borders"), F.struct(*self.order)).alias(_CHUNK),
        )

    def _same_key(self) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]

    def _groups(self) -> list[str]:
        # _HOT is fixed by the key; as a partition column it lets the filter on
        # cut groups move below the window.
        return [*self.keys, _CHUNK, _HOT] if self.split else self.keys

    def _window(self, inclusive: bool):
        spec = Window.partitionBy(*self._groups()).orderBy(*self.order)
        return spec.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    # -- running values -------------------------------------------------

    def with_running(self, **values: Running) -> Ordered:
        """Add one column per running value, sharing one sort."""
        local = {n: self._local(v) for n, v in values.items()}
        if not self.split:
            return self._next(self.df.withColumns(local), values)

        position = F.struct(*self.order)
        totals = self.df.filter(_HOT).groupBy(*self.keys, _CHUNK)
        parts = totals.agg(*[_chunk_total(v, position).alias(f"_t_{n}") for n, v in values.items()])
        earlier = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        carries = parts.select(
            *[F.col(k).alias(f"_k_{k}") for k in self.keys],
            F.col(_CHUNK).alias("_k_chunk"),
            *[_carry(v, F.col(f"_t_{n}"), earlier).alias(f"_c_{n}") for n, v in values.items()],
        ).filter(F.col("_k_chunk") > 0)
        # One row per chunk of a cut group, no more than there are borders. Kept
        # in storage, so that chained running values do not repeat each other.
        carries = _small_table(carries, F.count(F.lit(1)))
        if carries is None:
            return self._next(self._unwrapped(local, values), values)
        same = [*self._same_key(), F.col(_CHUNK) == F.col("_k_chunk")]
        joined = self.df.withColumns({f"_l_{n}": c for n, c in local.items()}).join(carries, same, "left")
        # a sum over sums of decimals has a wider type than the sum itself
        merged = {n: _merge(v, F.col(f"_c_{n}"), F.col(f"_l_{n}")).cast(_kind(v, joined.schema[f"_l_{n}"].dataType)) for n, v in values.items()}
        kept = joined.withColumns(merged).select(*self.columns, *values, _HOT, _CHUNK)
        return self._next(kept, values)

    def _unwrapped(self, local: dict[str, Column], values: dict[str, Running]) -> DataFrame:
        plain = {n: c["v"] if values[n].kind == "previous" else c for n, c in local.items()}
        return self.df.withColumns(plain)

    def with_total(self, **values: Column) -> Ordered:
        """Add per-group sums (null counts as 0) next to every row."""
        whole = Window.partitionBy(*self._groups())
        local = {n: F.coalesce(F.sum(v).over(whole), F.lit(0)) for n, v in values.items()}
        if not self.split:
            return self._next(self.df.withColumns(local), values)
        # A group that was not cut is whole in its chunk; the others are few.
        sums = self.df.filter(_HOT).groupBy(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).agg(
            *[F.coalesce(F.sum(v), F.lit(0)).alias(f"_t_{n}") for n, v in values.items()]
        )
        sums = _small_table(sums, F.count(F.lit(1)))
        if sums is None:
            return self._next(self.df.withColumns(local), values)
        joined = self.df.withColumns({f"_l_{n}": c for n, c in local.items()}).join(sums, self._same_key(), "left")
        chosen = {n: F.when(F.col(_HOT), F.col(f"_t_{n}").cast(joined.schema[f"_l_{n}"].dataType)).otherwise(F.col(f"_l_{n}")) for n in values}
        return self._next(joined.withColumns(chosen).select(*self.columns, *values, _HOT, _CHUNK), values)

    def with_later(self, name: str, flag: Column, within: str) -> Ordered:
        """Add whether a flagged row is followed by another flagged one with the same value of a column in its group."""
        position, keys = F.struct(*self.order), [*self.keys, within]
        chosen = flag & F.col(within).isNotNull()
        if not self.split:
            last = F.max(F.when(chosen, position)).over(Window.partitionBy(*keys))
            return self.with_column(name, F.coalesce(chosen & (position < last), F.lit(False)))
        # the last positions are aggregated before they move; no group is brought together for them
        ends = self.df.filter(chosen).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(position).alias("_last"))
        joined = self.df.join(ends, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
        flagged = joined.withColumn(name, F.coalesce(chosen & (position < F.col("_last")), F.lit(False)))
        return self._next(flagged.drop("_last", *[f"_k_{k}" for k in keys]), [name])

    def with_column(self, name: str, value: Column) -> Ordered:
        return self._next(self.df.withColumn(name, value), [name])

    def _local(self, v: Running) -> Column:
        if v.kind == "sum":
            return F.coalesce(F.sum(v.value).over(self._window(v.inclusive)), F.lit(0))
        if v.kind == "max":
            return F.max(v.value).over(self._window(v.inclusive))
        if v.kind == "last":
            return F.last(v.value, ignorenulls=True).over(self._window(v.inclusive))
        spec = Window.partitionBy(*self._groups()).orderBy(*self.order)
        if not self.split:
            return F.lag(v.value).over(spec)
        # Wrapped, so that a null value differs from "no row before".
        return F.lag(F.struct(v.value.alias("v"))).over(spec)

    def _next(self, df: DataFrame, added) -> Ordered:
        other = object.__new__(Ordered)
        other.keys, other.order, other.split = self.keys, self.order, self.split
        other.columns = self.columns + [n for n in added if n not in self.columns]  # a replaced column keeps its place
        other.df = df
        return other

    def drop(self, *names: str) -> Ordered:
        other = self._next(self.df.drop(*names), [])
        other.columns = [c for c in self.columns if c not in names]
        return other

    def frame(self) -> DataFrame:
        return self.df.select(*[f"`{c}`" for c in self.columns])


def _small_table(table: DataFrame, size: Column) -> DataFrame | None:
    """Store a table about the cut groups; broadcast it if its measured size allows.

    None if it is empty.
    """
    table = reliable(table)
    measured = table.select(F.coalesce(size, F.lit(0))).first()[0]
    if measured == 0:
        return None
    return F.broadcast(table) if measured <= MAX_BROADCAST_ROWS else table


def _kind(v: Running, local: T.DataType) -> T.DataType:
    return local["v"].dataType if v.kind == "previous" else local


def _borders_below(borders: Column, value: Column) -> Column:
    """How many sorted borders lie below the value, by binary search."""
    rounds = F.floor(F.log2(F.size(borders))).cast("int")

    def step(found: Column, i: Column) -> Column:
        ahead = F.call_function("shiftleft", F.lit(1), i)
        reach = found + ahead
        below = F.get(borders, reach - 1) < value
        return found + F.when((reach <= F.size(borders)) & below, ahead).otherwise(0)

    found = F.aggregate(F.sequence(rounds, F.lit(0), F.lit(-1)), F.lit(0), step)
    return F.when(borders.isNull(), 0).otherwise(found)


def _chunk_total(v: Running, position: Column) -> Column:
    if v.kind == "sum":
        return F.sum(v.value)
    if v.kind == "max":
        return F.max(v.value)
    if v.kind == "last":
        return F.max_by(v.value, F.when(v.value.isNotNull(), position))
    return F.max_by(F.struct(v.value.alias("v")), position)


def _carry(v: Running, total: Column, earlier) -> Column:
    if v.kind == "previous":
        return F.lag(total).over(earlier)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    if v.kind == "sum":
        return F.sum(total).over(before)
    if v.kind == "max":
        return F.max(total).over(before)
    return F.last(total, ignorenulls=True).over(before)


def _merge(v: Running, carry: Column, local: Column) -> Column:
    if v.kind == "sum":
        return F.coalesce(carry, F.lit(0)) + local
    if v.kind == "max":
        return F.greatest(carry, local)
    if v.kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(local, carry)["v"]


def concat_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: Column,
    separator: str,
    part_bytes: int,
    name: str = "text",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Join the texts of each group in order, in parts of bounded size.

    A group up to `part_bytes` gives one row with part 0. A larger group gives
    consecutive parts; joining them with the separator gives the whole text, so
    no task ever holds more than about one part of a group.
    """
    rows = df.select(*dict.fromkeys([*keys, *order]), text.alias("_text"))
    rows = rows.withColumn("_bytes", (F.octet_length("_text") + len(separator.encode())).cast("bigint"))
    placed = Ordered(rows, keys, order, chunk_rows).with_running(
        _before=running_sum(F.col("_bytes"), inclusive=False)
    )
    parts = placed.frame().withColumn("part", F.floor(F.col("_before") / part_bytes).cast("bigint"))
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("_text"))
    pieces = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_text"])
    return parts.groupBy(*keys, "part").agg(
        F.array_join(pieces, separator).alias(name), F.count(F.lit(1)).alias("items")
    )
