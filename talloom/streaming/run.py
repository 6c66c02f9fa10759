"""Running a stream over what is there now."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talloom.session import configure, freed_shuffles, reliable, scratch_path
from talloom.streaming.reorder import END

# State that outlives one process and the processors' list state need RocksDB.
STATE_PARTITIONS_KEY = "spark.talloom.statePartitions"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    # Upload what changed instead of a snapshot in every batch.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Executors keep a stopped run's copy of the state, which a resumed one loads anew, until the next maintenance.
    spark.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "10s")
    # What all stores of an executor keep in memory, rather than up to 64 MB and more for each.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")
    return spark


def table_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 64) -> DataFrame:
    """A stored table as a stream of its files, a bounded number of them per micro-batch."""
    use_rocksdb(spark)
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # As a pattern the path may be one file as well as a folder of files.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(f"{folder}/{table}.parque[t]")


@contextmanager
def _state_partitions(spark: SparkSession):
    """A stream keeps the partition count it starts with; a setting may give it one of its own."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, spark.conf.get(STATE_PARTITIONS_KEY, before))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_rows(spark: SparkSession, state: str, variable: str) -> DataFrame:
    """What a stopped stream still holds in a list state, key columns beside the rows' own."""
    rows = spark.read.format("statestore").option("stateVarName", variable).load(state)
    return rows.select("key.*", "list_element.*")


def held_map(spark: SparkSession, state: str, variable: str) -> DataFrame:
    """Entries of a map state, key columns beside those of the entry."""
    rows = spark.read.format("statestore").option("stateVarName", variable).load(state)
    return rows.select("key.*", "user_map_key.*", "user_map_value.*")


def held_value(spark: SparkSession, state: str, variable: str = "held") -> DataFrame:
    """Values of a value state beside their keys."""
    return spark.read.format("statestore").option("stateVarName", variable).load(state).select("key.*", "value.*")


def waiting_rows(spark: SparkSession, state: str) -> DataFrame:
    """Rows that wait for the watermark in the reorder buffer of a stopped stream: its pending output."""
    chunks = spark.read.format("statestore").option("stateVarName", "waiting").load(state)
    names = chunks.schema["user_map_value"].dataType.names
    arrays = F.arrays_zip(*[F.col(f"user_map_value.{n}") for n in names])
    return chunks.select("key.*", F.inline(arrays))


def with_end(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A stream with a second source, an empty folder. A row at the end of time in it (`end_input`) closes the stream:
    the watermark passes everything, and what waits is handled like the rest."""
    spark = rows.sparkSession
    path = scratch_path(spark, f"{name}-end")
    spark.createDataFrame([], rows.schema).write.parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path)), path


def end_input(spark: SparkSession, path: str, at: str = "ts", **values) -> None:
    """Close a stream of `with_end`. Columns of the closing row are null but for its time and the given values."""
    given = {at: F.lit(END).cast("timestamp"), **{n: F.lit(v) for n, v in values.items()}}
    schema = spark.read.parquet(path).schema
    row = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).write.mode("append").parquet(path)


def run_available(
    stream: DataFrame, name: str, mode: str = "append", state: str | None = None, more: Iterable[Callable[[], None]] = (),
    each: Callable[[DataFrame], DataFrame] | None = None, out: str | None = None,
) -> DataFrame:
    """Process everything available, then return the emitted rows as a table.

    state: where to keep the stream's state, to read what it still holds; out: where to keep the emitted rows.
    more: steps that add input, after each of which the stream is resumed and processes what is new.
    each: a batch operator for the rows of every micro-batch, e.g. a join with tables as they are by then. The rows are
    stored first: an operator that reads them more than once does not run the stream's own stages as often.

    Update mode and `each` have no file sink of their own: every batch overwrites its own
    folder, so a batch that is run again after a failure does not repeat rows.
    """
    spark = use_rocksdb(stream.sparkSession)
    out, state = out or scratch_path(spark, f"{name}-out"), state or scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    schema = stream.schema
    if mode == "append" and each is None:
        files, writer = out, writer.format("parquet").option("path", out).option("compression", "zstd")
    else:
        files, judge = f"{out}/batch-*", (lambda df: each(reliable(df, f"{name}-rows"))) if each is not None else (lambda df: df)
        if each is not None:
            schema = each(spark.createDataFrame([], schema)).schema
        writer = writer.foreachBatch(lambda df, batch: judge(df).write.mode("overwrite").parquet(f"{out}/batch-{batch}"))
    for step in (None, *more):
        if step is not None:
            step()
        with _state_partitions(spark), freed_shuffles(spark):
            query = writer.start()
        query.awaitTermination()
    return spark.read.schema(schema).parquet(files)


def run_to_end(
    rows: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, state: str | None = None, at: str = "ts",
    more: Iterable[Callable[[], None]] = (), out: str | None = None,
) -> DataFrame:
    """Run `make` over a stream of rows with event time `at` that is closed when everything was processed."""
    closed, path = with_end(rows, name)
    return run_available(make(closed), name, state=state, more=[*more, lambda: end_input(rows.sparkSession, path, at)], out=out)
