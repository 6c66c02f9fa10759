"""Session settings, shared scratch space and plan-size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runtime settings every operator relies on. All can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

SPLIT_BYTES_KEY = "spark.talloom.splitBytes"
BROADCAST_BYTES_KEY = "spark.talloom.broadcastBytes"
DEFAULT_SPLIT_BYTES = 1 << 30
DEFAULT_BROADCAST_BYTES = 64 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "talloom", master: str | None = None, **conf) -> SparkSession:
    """A session for scripts and tests; on a cluster spark-submit sets the master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local-mode session may fall back to a temporary folder, because
    there every task runs on this machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="talloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in one folder per application.

    That folder can be removed as a whole once the application has ended.
    """
    own = f"{shared_dir(spark).rstrip('/')}/talloom-{spark.sparkContext.applicationId}"
    return f"{own}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder, once its results are no longer read."""
    remove(spark, f"{shared_dir(spark).rstrip('/')}/talloom-{spark.sparkContext.applicationId}")


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that is no longer read."""
    at, files = _located(spark, path)
    files.delete(at, True)


def hand_over(spark: SparkSession, path: str, to: str) -> None:
    """Move a written folder to where a stream looks; a folder that nothing was written to becomes an empty one."""
    (at, files), (place, _) = _located(spark, path), _located(spark, to)
    files.mkdirs(place.getParent())
    if not (files.exists(at) and files.rename(at, place)):
        files.mkdirs(place)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go with their job; otherwise they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def reliable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a table in the shared folder, which outlives executors.

    Later steps read only the columns they need, and the planner knows its size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """Estimated bytes the plan reads after pruning, or None if unknown."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # e.g. a Connect session, which exposes no plan
        return None


def must_split(df: DataFrame) -> bool:
    """True if one group of this input could be too large for a single task."""
    limit = int(df.sparkSession.conf.get(SPLIT_BYTES_KEY, str(DEFAULT_SPLIT_BYTES)))
    size = input_bytes(df)
    return size is None or size > limit


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table given in code. Built from Arrow, so that its size is known to the planner."""
    target = T.StructType.fromDDL(schema)
    table = pa.Table.from_pydict({f.name: pa.array([r.get(f.name) for r in rows]) for f in target})
    made = spark.createDataFrame(table)
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast a join side only if its inputs are proven small.

    Otherwise no hint is given: adaptive execution then chooses by measured
    size and splits skewed partitions of a sort-merge join.
    """
    limit = int(df.sparkSession.conf.get(BROADCAST_BYTES_KEY, str(DEFAULT_BROADCAST_BYTES)))
    size = input_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df
