"""Search, listing, edits, includes, indexes and recall over text corpora."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talloom.functions import predicates, text
from talloom.operators.ordered import Ordered, concat_parts, running_sum
from talloom.session import configure, reliable, small_side

# Limits, and the forms of include lines and notes.
LIST_CAP = 200
MAX_INCLUDE_DEPTH = 5
CIRCULAR = ("<!-- circular: ", " -->")
MISSING = ("<!-- not found: ", " -->")
SPILL_NOTE = ("[Result too large (", " KB, ", " lines). Full output saved to ")
TASK_PAIRS = 1 << 20
INCLUDE_LINE = r"^@(\./\S+|~/\S+|/\S+)$"


# -- search ---------------------------------------------------------------


def grep(files: DataFrame, pattern: str, include: str | None = None, base: str | None = None) -> DataFrame:
    """Every matching line as path, line_no, line. Files are rows (path, text); base: a folder to search below."""
    kept = _below(files, base).filter(predicates.visible_path(F.col("path")))
    if include:
        name = F.element_at(F.split("path", "/"), -1)
        kept = kept.filter(F.rlike(name, F.lit(predicates.name_regex(include))))
    if matches_across_lines(pattern):
        # A whole-text test first: most files never get split into lines.
        kept = kept.filter(F.rlike("text", F.lit(f"(?m){pattern}")))
    lines = kept.select("path", F.posexplode(text.lines_of(F.col("text"))).alias("pos", "line"))
    return lines.filter(F.rlike("line", F.lit(pattern))).select(
        "path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def matches_across_lines(pattern: str) -> bool:
    """True if a match in a line is sure to be one in the whole text.

    Not so for anchors (no line starts at the very end of a text), patterns that can be empty, look-around, inline
    groups, word borders and possessive repeats.
    """
    if re.search(r"\(\?|\\[AzZGbB]|[*+?}]\+|[\^$]", pattern):
        return False
    try:
        return re.search(pattern, "") is None
    except re.error:  # syntax that only the engine of the lines knows
        return False


def list_paths(files: DataFrame, glob: str, base: str | None = None) -> DataFrame:
    """Paths that a glob matches; with a base folder the glob applies to the path below it."""
    kept = _below(files.select("path"), base)
    inner = F.col("path") if not base else F.substr("path", F.lit(len(base.rstrip("/")) + 2))
    match = F.rlike(inner, F.lit(predicates.glob_regex(glob)))
    return kept.filter(match & predicates.visible_path(F.col("path")))


def _below(files: DataFrame, base: str | None) -> DataFrame:
    return files.filter(F.startswith("path", F.lit(base.rstrip("/") + "/"))) if base else files


def first_with_rest(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first rows in order, each with the number of rows left out.

    The limit is a per-task top-k and the count a partial aggregate, so no
    task sorts everything.
    """
    rest = rows.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("omitted"))
    return rows.orderBy(*order).limit(cap).withColumn("omitted", rest.scalar())


def first_per_group(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """At most n rows per key; tasks cut to n rows per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def newest_first(rows: DataFrame, at: str, tie: str, cap: int = LIST_CAP) -> DataFrame:
    return rows.orderBy(F.desc(at), F.asc(tie)).limit(cap)


# -- edits ----------------------------------------------------------------


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """One edit per path (old, new): exactly one match is replaced, else an error status.

    A match up to quote style counts and is noted.
    """
    both = files.join(edits, "path")
    both = both.withColumn("actual", text.find_actual(F.col("text"), F.col("old")))
    both = both.withColumn(
        "matches", F.coalesce(text.count_occurrences(F.col("text"), F.col("actual")), F.lit(0))
    )
    once = F.col("matches") == 1
    status = (
        F.when(F.col("matches") == 0, "not found")
        .when(~once, F.concat(F.lit("found "), F.col("matches").cast("string"), F.lit(" times")))
        .when(F.col("actual") != F.col("old"), "edited via quote normalization")
        .otherwise("edited")
    )
    return both.select(
        "path",
        status.alias("status"),
        F.when(once, F.replace("text", F.col("actual"), F.col("new"))).otherwise(F.col("text")).alias("text"),
        F.when(once, text.diff_hunk(F.col("text"), F.col("actual"), F.col("new"))).alias("diff"),
    )


# -- large values -----------------------------------------------------------


def spill_large(
    rows: DataFrame, value: str, max_bytes: int = 30 * 1024, preview: int = 200, hard_cut: int = 50000
) -> tuple[DataFrame, DataFrame]:
    """Rows with over-large values replaced by a preview, and the side table of whole values.

    The side table is keyed by content hash, so a rerun writes the same keys
    and equal values are stored once.
    """
    col = F.col(value)
    large = F.octet_length(col) > max_bytes
    key = F.sha2(col, 256)
    note = F.concat(
        F.lit(SPILL_NOTE[0]), text.size_kb(col), F.lit(SPILL_NOTE[1]),
        text.line_count(col).cast("string"), F.lit(SPILL_NOTE[2]), key,
        F.lit(f"]\n\nPreview (first {preview} lines):\n"), text.first_lines(col, preview),
    )
    kept = rows.withColumns({
        "spill_key": F.when(large, key),
        value: F.when(large, text.head_tail(note, hard_cut, 60)).otherwise(col),
    })
    side = rows.filter(large).select(key.alias("spill_key"), col.alias("content"))
    return kept, side.dropDuplicates(["spill_key"])


# -- directories ----------------------------------------------------------------


def ancestors(path: Column) -> Column:
    """Every folder prefix of a path, root first ('' is the root)."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def context_for_paths(paths: DataFrame, files: DataFrame, part_bytes: int) -> DataFrame:
    """For each path the texts found in its ancestor folders, root first.

    paths(path), files(folder, text). The join is on the folder; a folder that
    most paths share is a hot key, which a broadcast of a small `files` or
    the skew split of the sort-merge join takes care of.
    """
    found = paths.select(
        "path", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder")
    ).join(small_side(files), "folder")
    return concat_parts(
        found, ["path"], ["depth"], F.col("text"), "\n\n---\n\n", part_bytes, name="context"
    )


def concat_dir(files: DataFrame, header: tuple[str, str], part_bytes: int) -> DataFrame:
    """Texts of a folder sorted by name, each under a line with its name.

    files(folder, name, text).
    """
    block = F.concat(F.lit(header[0]), F.col("name"), F.lit(header[1] + "\n"), F.col("text"))
    return concat_parts(files, ["folder"], ["name"], block, "\n\n", part_bytes)


def build_index(notes: DataFrame, newest: bool, part_bytes: int) -> DataFrame:
    """One line per note and folder: newest first, or by file name.

    notes(folder, file, mtime, name, type, description).
    """
    line = F.concat(
        F.lit("- **["), F.col("name"), F.lit("]("), F.col("file"), F.lit(")** ("), F.col("type"),
        F.lit(") — "), F.coalesce("description", F.lit("")),
    )
    kept = notes.filter((F.col("name") != "") & (F.col("type") != ""))
    kept = kept.withColumn("_age", -F.unix_micros(F.col("mtime").cast("timestamp")))
    order = ["_age", "file"] if newest else ["file"]
    return concat_parts(kept, ["folder"], order, line, "\n", part_bytes, name="index")


# -- includes -------------------------------------------------------------------


def expand_includes(files: DataFrame, max_depth: int = MAX_INCLUDE_DEPTH, home: str = "") -> DataFrame:
    """Lines of every file with `@/path` lines replaced by the lines of that file.

    files(path, text) with unique paths. Returns (root, position array, line):
    sorting by position gives the text, so a file included everywhere is never
    collected in one place. An include already open on the way down becomes a
    circular marker, one that does not exist a missing marker; at max_depth
    lines stay as they are.

    The rounds run on include points alone, rows without text. Texts are joined
    once at the end, and only those of files that are included somewhere.
    """
    lines = files.select("path", F.posexplode(text.lines_of(F.col("text"))).alias("n", "line"))
    lines = lines.select("*", F.nullif(F.regexp_extract("line", INCLUDE_LINE, 1), F.lit("")).alias("raw"))
    own = lines.filter("raw IS NULL").select(F.col("path").alias("root"), F.array("n").alias("position"), "line")

    edges = lines.filter("raw IS NOT NULL").select("path", "n", "raw", _resolved(F.col("path"), F.col("raw"), home).alias("target"))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("exists"))
    edges = reliable(edges.join(known, "target", "left").select("path", "n", "raw", "target", "exists"))

    asked = edges.select(
        F.col("path").alias("root"), F.array("n").alias("position"), "raw", "target", "exists",
        F.array().cast("array<string>").alias("open"),
    )
    onward = edges.select("path", "n", F.col("raw").alias("_raw"), F.col("target").alias("_target"), F.col("exists").alias("_exists"))
    points, marked = [], []
    for depth in range(1, max_depth + 1):
        circular = F.array_contains("open", F.col("target"))
        mark = F.when(circular, F.concat(F.lit(CIRCULAR[0]), "raw", F.lit(CIRCULAR[1]))).when(
            F.col("exists").isNull(), F.concat(F.lit(MISSING[0]), "raw", F.lit(MISSING[1]))
        )
        asked = asked.withColumn("mark", mark)
        marked.append(asked.filter("mark IS NOT NULL").select("root", "position", F.col("mark").alias("line")))
        entered = asked.filter("mark IS NULL").select(
            "root", "position", F.col("target").alias("path"), F.concat("open", F.array("target")).alias("open")
        )
        points.append(entered.select("root", "position", "path", F.lit(depth == max_depth).alias("last")))
        if depth == max_depth:
            break
        asked = reliable(entered.join(onward, "path").select(
            "root", F.concat("position", F.array("n")).alias("position"), F.col("_raw").alias("raw"),
            F.col("_target").alias("target"), F.col("_exists").alias("exists"), "open",
        ))
        if asked.isEmpty():
            break

    every = points[0]
    for more in points[1:]:
        every = every.unionByName(more)
    included = lines.join(edges.select(F.col("target").alias("path")).distinct(), "path", "left_semi")
    inserted = every.join(included, "path").filter("raw IS NULL OR last")
    out = own.unionByName(inserted.select("root", F.concat("position", F.array("n")).alias("position"), "line"))
    for more in marked:
        out = out.unionByName(more)
    return out


def _resolved(path: Column, raw: Column, home: str) -> Column:
    """Path of an include: relative to its file, to the home, or absolute already; without `.`, `..` and empty parts."""
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    whole = (
        F.when(F.startswith(raw, F.lit("./")), F.concat(folder, F.substr(raw, F.lit(3))))
        .when(F.startswith(raw, F.lit("~/")), F.concat(F.lit(home), F.substr(raw, F.lit(2))))
        .otherwise(raw)
    )
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.when(F.startswith(whole, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


# -- recall ---------------------------------------------------------------------


def words(value: Column) -> Column:
    """Distinct lower-case words (letters of any script, digits, _) of more than two characters."""
    return F.filter(F.array_distinct(F.split(F.lower(value), r"[^\p{L}\p{N}_]+")), lambda w: F.length(w) > 2)


def recall_by_overlap(queries: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """For each query the k docs sharing most distinct words, ties to the lower id.

    queries(query_id, text), docs(doc_id bigint, text). Docs are dealt by their id over as many tasks as pairs of a query
    and a doc need. Doc words that no query asks for are dropped; the rest meet the queries' words and are counted in the
    task of their doc, and the k best per query are cut out there: of all the pairs none moves but these.
    """
    spark = configure(docs.sparkSession)
    asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("word"))
    pairs = docs.select("doc_id").count() * max(queries.select("query_id").count(), 100)
    tasks = max(spark.sparkContext.defaultParallelism, pairs // TASK_PAIRS + 1)
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartition(tasks, "doc_id")
    tokens = dealt.select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    known = tokens.join(small_side(asked.select("word").distinct()), "word", "left_semi")
    shared = known.join(small_side(asked), "word").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    return first_per_group(shared, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def byte_budget(items: DataFrame, keys: list[str], order: list[str], size: str, limit: int,
                chunk_rows: int | None = None) -> DataFrame:
    """Items that start while the bytes before them are below the limit."""
    placed = Ordered(items, keys, order, chunk_rows).with_running(
        bytes_before=running_sum(F.col(size), inclusive=False)
    )
    return placed.frame().withColumn("starts", F.col("bytes_before") < limit)
