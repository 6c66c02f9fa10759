"""Markdown notes with a header: reading, listing, rendering, removing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talloom.functions.frontmatter import DEFAULT_TYPE, NOTE_TYPES, parse_frontmatter, render_frontmatter, valid_type
from talloom.functions.text import first_lines, slugify
from talloom.operators.corpus import build_index
from talloom.session import reliable, small_side

INDEX_FILE = "MEMORY.md"  # fixed value
HEADER_LINES = 30
PACKED_SPLITS = 16


def _note_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return raw.where(F.element_at(F.split("path", "/"), -1) != INDEX_FILE)


def _packed(files: DataFrame) -> DataFrame:
    """More files to a task than Spark packs, which counts four megabytes for each beside its bytes."""
    tasks = files.rdd.getNumPartitions() // PACKED_SPLITS + 1
    return files.coalesce(max(tasks, files.sparkSession.sparkContext.defaultParallelism))


def read_markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """*.md files below a folder, without the index: path, file, folder, mtime, text.

    Millions of tiny files list slowly; write the result as Parquet once, point
    later jobs at that, and keep it up to date with `note_changes`.
    """
    parts = F.split("path", "/")
    raw = _note_files(spark, path).select(
        "path",
        F.element_at(parts, -1).alias("file"),
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"),
        F.col("modificationTime").alias("mtime"),
        F.decode("content", "UTF-8").alias("text"),
    )
    return _packed(raw)


def note_index(raw: DataFrame) -> DataFrame:
    """What `note_changes` compares with: path, mtime and content hash of every note. Store it."""
    return raw.select("path", "mtime", F.sha2("text", 256).alias("hash"))


def note_changes(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """New, changed and removed notes below a folder since an index was made: path, status, mtime, hash, text.

    Files are listed once, without their contents; what differs from the index is stored. Contents are read of files that
    are new or have another time than in the index, and the earliest of these times is a filter that reaches the source; a
    file whose content is the same after all is no change.
    """
    files = _note_files(spark, path)
    listed = _packed(files.select("path", F.col("modificationTime").alias("mtime")))
    known = index.select("path", F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"))
    both = reliable(listed.join(known, "path", "full").where("mtime IS NULL OR NOT (_mtime <=> mtime)"), "differing")
    open_ = both.where("mtime IS NOT NULL").select("path", "_hash")
    since = both.agg(F.min("mtime")).first()[0]
    removed = both.where("mtime IS NULL").select(
        "path", F.lit("removed").alias("status"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("string").alias("hash"),
        F.lit(None).cast("string").alias("text"),
    )
    if since is None:
        return removed
    read = files.where(F.col("modificationTime") >= F.lit(since))
    read = _packed(read.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text")))
    seen = read.join(small_side(open_), "path").withColumn("hash", F.sha2("text", 256)).where("NOT (hash <=> _hash)")
    status = F.when(F.col("_hash").isNull(), "new").otherwise("changed").alias("status")
    return seen.select("path", status, "mtime", "hash", "text").unionByName(removed)


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after the changes."""
    kept = index.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(changes.where("status <> 'removed'").select("path", "mtime", "hash"))


def write_note_files(files: DataFrame, path: str) -> None:
    """A Markdown file per row (folder, file, text) below a folder that all executors reach; null text deletes the file."""

    def write(rows) -> None:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        made = set()
        for row in rows:
            folder = f"{base}/{row['folder']}"
            if row["text"] is None:
                place.delete_file(f"{folder}/{row['file']}")
                continue
            if folder not in made:
                place.create_dir(folder, recursive=True)
                made.add(folder)
            with place.open_output_stream(f"{folder}/{row['file']}") as out:
                out.write(row["text"].encode("utf-8", "surrogatepass"))

    files.select("folder", "file", "text").foreachPartition(write)


def list_notes(raw: DataFrame) -> DataFrame:
    """Notes with a name and a type; an unknown type becomes the default."""
    def entry(p: Column) -> Column:
        meta = p["meta"]
        return F.struct(
            meta["name"].alias("name"),
            F.coalesce(meta["description"], F.lit("")).alias("description"),
            meta["type"].alias("type"),
            p["body"].alias("body"),
        )

    # Kept or not is decided inside the array: a filter on the columns would
    # move below the projection and parse every text once more per condition.
    entries = F.transform(F.array(parse_frontmatter(F.col("text"))), entry)
    kept = F.filter(entries, lambda n: (n["name"] != "") & (n["type"] != ""))
    notes = raw.select(*[c for c in raw.columns if c != "text"], F.inline(kept))
    return notes.withColumn("type", valid_type(F.col("type"), NOTE_TYPES, DEFAULT_TYPE))


def scan_headers(raw: DataFrame) -> DataFrame:
    """Header fields from the first lines alone; unknown types become null."""
    head = parse_frontmatter(first_lines(F.col("text"), HEADER_LINES))["meta"]
    rows = raw.withColumn("_m", head)
    return rows.select(
        *[c for c in raw.columns if c != "text"],
        F.nullif(F.col("_m")["description"], F.lit("")).alias("description"),
        valid_type(F.col("_m")["type"], NOTE_TYPES, None).alias("type"),
    )


def note_files(entries: DataFrame) -> DataFrame:
    """Entries (name, description, type, body) as file name and file text."""
    file = F.concat("type", F.lit("_"), slugify(F.col("name")), F.lit(".md"))
    fields = [(c, F.col(c)) for c in ("name", "description", "type")]
    rest = [c for c in entries.columns if c not in ("name", "description", "type", "body")]
    return entries.select(*rest, "type", file.alias("file"), render_frontmatter(fields, F.col("body")).alias("text"))


def write_note_table(entries: DataFrame, path: str) -> None:
    """Rendered notes, one folder per type; a type that holds most notes is still many files."""
    note_files(entries).write.mode("overwrite").partitionBy("type").parquet(path)


def delete_notes(notes: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Notes that stay, and for each asked key whether it existed."""
    gone = doomed.select(key).distinct()
    stay = notes.join(gone, key, "left_anti")
    known = notes.join(gone, key, "left_semi").select(key).distinct().withColumn("existed", F.lit(True))
    report = gone.join(known, key, "left").select(key, F.coalesce("existed", F.lit(False)).alias("existed"))
    return stay, report


def rebuild_index(notes: DataFrame, part_bytes: int = 1 << 24) -> DataFrame:
    return build_index(notes, newest=True, part_bytes=part_bytes)
