"""A table with the newest row of each session, saved by many writers at once.

A save appends its rows as files of its own, and then one small commit file that names them; nothing that is stored is
touched. Readers list the commits and take the newest row of each id, so concurrent saves need no lock, and data of a
save that failed before its commit is never read. A commit is one new file, which file systems and object stores alike
create as a whole or not at all.

Compaction merges saves into buckets by a hash of the id. It reads and rewrites only buckets that the saves touch, and
names in its commit what it replaces. The number of buckets follows the stored bytes; where it grows, every bucket splits.
Two compactions at once leave rows twice, which readers resolve like any other versions. `vacuum` deletes what is replaced.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BYTES = 256 << 20
#: Buckets that a task writes, where they are small; and what is small: so many of them are no more than Spark puts in a task.
TASK_BUCKETS, SMALL_BYTES = 64, 1 << 20
#: Tasks that list the folders of a table. Spark would start one for each folder.
LISTING_TASKS = 64
_HASH = "xxhash64(id)"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _size(spark: SparkSession, path: str) -> int:
    fs, target = _fs(spark, path)
    return fs.getContentSummary(target).getLength()


def _bucket_sizes(spark: SparkSession, path: str) -> list[list[int]]:
    """Buckets of a compaction with their bytes. Files are listed by tasks, and not read."""
    files = _listed(spark).format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bucket = F.regexp_extract("path", "/bucket=([0-9]+)/[^/]*$", 1).cast("int")
    return sorted([r["bucket"], r["size"]] for r in files.groupBy(bucket.alias("bucket")).agg(F.sum("length").alias("size")).collect())


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    fs, target = _fs(spark, f"{path}/commits/{entry['id']}.json")
    out = fs.create(target, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()


def _commits(spark: SparkSession, path: str) -> list[dict]:
    """Commits in the order of their times; as many as there were saves and compactions since the last vacuum."""
    fs, target = _fs(spark, f"{path}/commits")
    if not fs.exists(target):
        return []
    lines = spark.read.text(f"{path}/commits", wholetext=True).collect()
    return sorted((json.loads(r["value"]) for r in lines), key=lambda c: (c["at"], c["id"]))


class Live:
    """What readers must read: saves not merged yet, and the buckets of compactions that no later one replaced."""

    def __init__(self, commits: list[dict]):
        gone = {i for c in commits for i in c["replaces"]}
        dropped = {tuple(d) for c in commits for d in c["drops"]}
        self.saves = [c for c in commits if c["bits"] is None and c["id"] not in gone]
        merged = [c for c in commits if c["bits"] is not None]
        self.bits = max((c["bits"] for c in merged), default=0)
        self.buckets = [(c["id"], c["bits"], b, size) for c in merged for b, size in c["buckets"] if (c["id"], b) not in dropped]
        self.replaced = sorted(gone) + [c["id"] for c in merged if all((c["id"], b) in dropped for b, _ in c["buckets"])]

    def bytes(self) -> int:
        return sum(c["bytes"] for c in self.saves) + sum(size for *_, size in self.buckets)

    def folders(self, path: str) -> list[str]:
        own = [f"{path}/data/{c['id']}" for c in self.saves]
        return own + [f"{path}/data/{i}/bucket={b}" for i, _, b, _ in self.buckets]

    def disjoint(self) -> bool:
        """Whether no two compactions left buckets with the same part of the ids."""
        parts = Counter(b for _, _, b, _ in self.buckets)
        return max(parts.values(), default=1) == 1 and len({bits for _, bits, *_ in self.buckets}) <= 1

    def single(self) -> bool:
        """Whether every id has one row."""
        return not self.saves and self.disjoint()


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each id; equal times are told apart by a hash of the row."""
    rest = [c for c in rows.columns if c != "id"]
    latest = F.max_by(F.struct(*rest), F.struct("saved_at", F.xxhash64(*rest)))
    return rows.groupBy("id").agg(latest.alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def _schema(commits: list[dict]) -> T.StructType:
    """The columns of the last commit; older rows have null in those that they lack."""
    return T.StructType.fromJson(json.loads(commits[-1]["schema"]))


def _read(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    return _listed(spark).schema(schema).parquet(*folders)


def _listed(spark: SparkSession) -> DataFrameReader:
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(LISTING_TASKS))
    return spark.read


def _dealt(rows: DataFrame, buckets: int, size: int) -> DataFrame:
    """Rows dealt over tasks by bucket: few files per bucket, and several for one that outgrew the others.

    Adaptive execution goes by bytes and would give all small buckets to one task, which then writes a file for each.
    """
    if size >= buckets * SMALL_BYTES:
        return rows.hint("rebalance", "bucket")
    return rows.repartition(-(-buckets // TASK_BUCKETS), "bucket")


def write_sessions(saved: DataFrame, path: str) -> str:
    """Save rows (id, saved_at, ...), of which the newest of each id counts. Returns the id of the save."""
    spark, save = saved.sparkSession, uuid.uuid4().hex
    data = f"{path}/data/{save}"
    _newest(saved).write.parquet(data)
    schema = saved.schema.json()
    _commit(spark, path, {"id": save, "at": time.time(), "bits": None, "bytes": _size(spark, data), "buckets": [], "replaces": [], "drops": [], "schema": schema})
    return save


def stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The newest saved row of each id."""
    commits = _commits(spark, path)
    if not commits:
        raise FileNotFoundError(f"no sessions were saved below {path}")
    live, schema = Live(commits), _schema(commits)
    folders = live.folders(path)
    rows = _read(spark, folders, schema) if folders else spark.createDataFrame([], schema)
    return rows if live.single() else _newest(rows)


def compact_sessions(spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Merge all saves so far into the buckets that they touch; buckets split where the table has outgrown them."""
    commits = _commits(spark, path)
    live = Live(commits)
    if live.single():
        return
    schema = _schema(commits)
    bits = live.bits
    if not live.buckets or live.bytes() > 2 * bucket_bytes << bits:  # beyond twice the size, so that it does not waver
        bits = max(bits, max(live.bytes() - 1, 0).bit_length() - (bucket_bytes - 1).bit_length())
    bucket = F.expr(f"pmod({_HASH}, {1 << bits})").cast("int")
    old, buckets = live.buckets, 1 << bits
    if live.disjoint() and live.bits == bits:  # otherwise all buckets are dealt anew
        touched = {r[0] for r in _read(spark, [f"{path}/data/{c['id']}" for c in live.saves], schema).select(bucket).distinct().collect()}
        old, buckets = [b for b in old if b[2] in touched], max(len(touched), 1)
    folders = [f"{path}/data/{c['id']}" for c in live.saves] + [f"{path}/data/{i}/bucket={b}" for i, _, b, _ in old]
    made = uuid.uuid4().hex
    merged = f"{path}/data/{made}"
    rows = _newest(_read(spark, folders, schema)).withColumn("bucket", bucket)
    size = sum(c["bytes"] for c in live.saves) + sum(size for *_, size in old)
    _dealt(rows, buckets, size).write.partitionBy("bucket").parquet(merged)
    _commit(spark, path, {
        "id": made, "at": time.time(), "bits": bits, "bytes": 0, "buckets": _bucket_sizes(spark, merged), "replaces": [c["id"] for c in live.saves],
        "drops": [[i, b] for i, _, b, _ in old], "schema": commits[-1]["schema"],
    })


def vacuum(spark: SparkSession, path: str, older_than_s: float = 7 * 86_400) -> list[str]:
    """Delete data that was replaced by a compaction some time ago, so that no reader can still be at it; returns the ids.

    Commits stay: they are a line each, and tell later readers what is replaced.
    """
    commits = _commits(spark, path)
    recent = {i for c in commits if c["at"] > time.time() - older_than_s for i in [*c["replaces"], *(d[0] for d in c["drops"])]}
    gone = [i for i in Live(commits).replaced if i not in recent]
    for i in gone:
        fs, target = _fs(spark, f"{path}/data/{i}")
        fs.delete(target, True)
    return gone
