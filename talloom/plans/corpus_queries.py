"""Queries over files, notes, folders and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from talloom.functions import predicates, text
from talloom.operators import catalog, corpus
from talloom.plans.registry import Tables, query
from talloom.plans.standins import calls, ctes, files, notes
from talloom.session import reliable, scratch_path
from talloom.sources import config, notes as note_source

_PATTERN = "[0-9]{3}"


def _lines_sql(where: str) -> str:
    return f"""l AS (SELECT path, CAST(i AS BIGINT) AS line_no, line FROM (SELECT path, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM files) WHERE {where})"""


@query(
    "grep_lines",
    ctes("files", more=_lines_sql("regexp_matches(line, '[0-9]{3}')")) + "SELECT path, line_no, line FROM l",
)
def _(t: Tables):
    return corpus.grep(files(t), _PATTERN)


@query(
    "grep_blank_lines",
    ctes("files", more="""l AS (SELECT path, unnest(string_split(text || chr(10) || ' ' || chr(10), chr(10))) AS line,
      CAST(generate_subscripts(string_split(text || chr(10) || ' ' || chr(10), chr(10)), 1) AS BIGINT) AS line_no FROM files)""")
    + "SELECT path, line_no, line FROM l WHERE regexp_matches(line, '^\\s*$')",
)
def _(t: Tables):
    """Texts that end with a blank and an empty line."""
    return corpus.grep(files(t).withColumn("text", F.concat("text", F.lit("\n \n"))), r"^\s*$")


@query(
    "grep_first_with_rest",
    ctes("files", more=_lines_sql("regexp_matches(line, ' the .*ed') AND path LIKE '%.en'"))
    + """SELECT path || ':' || line_no || ':' || line AS match, greatest((SELECT count(*) FROM l) - 100, 0) AS omitted FROM l ORDER BY path, line_no LIMIT 100""",
)
def _(t: Tables):
    found = corpus.first_with_rest(corpus.grep(files(t), " the .*ed", "*.en"), ["path", "line_no"], 100)
    return found.select(
        F.concat_ws(":", "path", F.col("line_no").cast("string"), "line").alias("match"), "omitted"
    )


@query(
    "grep_first_per_file",
    ctes("files", more=_lines_sql("contains(line, 'and')"))
    + "SELECT path, line_no, line FROM l QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 2",
)
def _(t: Tables):
    return corpus.first_per_group(corpus.grep(files(t), "and"), ["path"], ["line_no"], 2).select("path", "line_no", "line")


_MIXED = "CASE lang WHEN 'es' THEN concat(source, '/.git/', file) WHEN 'fr' THEN concat(source, '/node_modules/x/', file) ELSE path END"


@query(
    "list_paths",
    ctes("files") + "SELECT path FROM files WHERE lang IN ('de', 'en') AND regexp_matches(source, '^src1.$')",
)
def _(t: Tables):
    rows = files(t).select(F.expr(_MIXED).alias("path"))
    return corpus.list_paths(rows, "src1?/**/*.*")


@query(
    "list_paths_braces",
    ctes("files") + "SELECT path FROM files WHERE lang IN ('de', 'en') AND regexp_matches(source, '^src[1-4]$')",
)
def _(t: Tables):
    return corpus.list_paths(files(t).select("path"), "src[1-4]/**/*.{de,en}")


@query(
    "list_paths_first_with_rest",
    ctes("files") + """SELECT path, greatest((SELECT count(*) FROM files WHERE lang = 'en') - 200, 0) AS omitted FROM files WHERE lang = 'en' ORDER BY path LIMIT 200""",
)
def _(t: Tables):
    return corpus.first_with_rest(corpus.list_paths(files(t), "**/*.en"), ["path"], 200)


@query(
    "newest_orders",
    "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 200",
)
def _(t: Tables):
    top = corpus.newest_first(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return top.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))


_EDITS = """SELECT path, CASE lang WHEN 'es' THEN concat(split_part(text, chr(10), 1), '#') WHEN 'fr' THEN 'e'
 ELSE replace(split_part(text, chr(10), 1), '’', '''') END AS old, concat('[', path, ']', chr(10), 'edited') AS new FROM files"""
_CURLY = "SELECT path, lang, replace(text, ' th', ' ’th') AS text FROM files"


@query(
    "apply_edits",
    ctes("files", more=f"""c AS ({_CURLY}), e AS ({_EDITS.replace("FROM files", "FROM c")}),
      j AS (SELECT c.path, text, old, new, CASE WHEN contains(text, old) THEN old WHEN instr(replace(text, '’', ''''), old) > 0
        THEN substr(text, instr(replace(text, '’', ''''), old), length(old)) END AS actual FROM c JOIN e USING (path)),
      m AS (SELECT *, CASE WHEN actual IS NULL OR actual = '' THEN 0 ELSE CAST((length(text) - length(replace(text, actual, ''))) / length(actual) AS BIGINT) END AS n FROM j)""")
    + """SELECT path, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'found ' || n || ' times' WHEN actual <> old THEN 'edited via quote normalization' ELSE 'edited' END AS status,
      CASE WHEN n = 1 THEN replace(text, actual, new) ELSE text END AS text,
      CASE WHEN n = 1 THEN '@@ -' || p || ',' || len(string_split(actual, chr(10))) || ' +' || p || ',2 @@' || chr(10) || '- ' || replace(actual, chr(10), chr(10) || '- ') || chr(10) || '+ ' || replace(new, chr(10), chr(10) || '+ ') END AS diff
    FROM (SELECT *, len(string_split(split_part(text, actual, 1), chr(10))) AS p FROM m)""",
)
def _(t: Tables):
    curly = t.spark.sql(_CURLY.replace("FROM files", "FROM {f}"), f=files(t))
    edits = t.spark.sql(_EDITS.replace("FROM files", "FROM {f}"), f=curly)
    return corpus.apply_edits(curly, edits)


_SPILL_NOTE = """'[Result too large (' || CAST(CAST(round(CAST(strlen(text) AS DECIMAL(20,4)) * CAST(0.0009765625 AS DECIMAL(11,10)), 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KB, ' ||
 len(string_split(text, chr(10))) || ' lines). Full output saved to ' || sha256(text) || ']' || chr(10) || chr(10) || 'Preview (first 20 lines):' || chr(10) || array_to_string(string_split(text, chr(10))[1:20], chr(10))"""


@query(
    "spill_large_kept",
    f"""WITH s AS (SELECT doc_id, strlen(text) > 8000 AS big, sha256(text) AS k, text, {_SPILL_NOTE} AS note FROM documents)
    SELECT doc_id, CASE WHEN big THEN k END AS spill_key, CASE WHEN NOT big THEN text WHEN length(note) > 5000
      THEN left(note, 2470) || chr(10) || chr(10) || '[... truncated ' || (length(note) - 4940) || ' chars ...]' || chr(10) || chr(10) || right(note, 2470) ELSE note END AS text FROM s""",
)
def _(t: Tables):
    kept, _ = corpus.spill_large(t.documents.select("doc_id", "text"), "text", 8000, 20, 5000)
    return kept


@query(
    "spill_large_side",
    "SELECT DISTINCT sha256(text) AS spill_key, text AS content FROM documents WHERE strlen(text) > 8000",
)
def _(t: Tables):
    _, side = corpus.spill_large(t.documents.select("doc_id", "text"), "text", 8000, 20)
    path = scratch_path(t.spark, "spill")
    side.write.parquet(path)
    return t.spark.read.parquet(path)


@query(
    "context_for_paths",
    """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path, html FROM pages),
    d AS (SELECT DISTINCT path FROM p), f AS (SELECT split_part(path, '/', 1) AS folder, 'site ' || split_part(path, '/', 1) || ' ' || count(*) AS text FROM p GROUP BY 1
      UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 'section ' || max(page_id) FROM p GROUP BY 1, split_part(path, '/', 1), split_part(path, '/', 2) UNION ALL SELECT '', 'root ' || count(*) FROM p),
    m AS (SELECT d.path, f.text, length(f.folder) AS n FROM d JOIN f ON f.folder = '' OR d.path = f.folder OR starts_with(d.path, f.folder || '/'))
    SELECT path, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM m GROUP BY path""",
)
def _(t: Tables):
    pages = t.pages.select("page_id", F.regexp_replace("url", r"^https?://|[?#].*\z", "").alias("path"))
    host = F.split_part("path", F.lit("/"), F.lit(1))
    section = F.concat(host, F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)))
    by_host = pages.groupBy(host.alias("folder")).agg(
        F.concat(F.lit("site "), F.first(host), F.lit(" "), F.count(F.lit(1)).cast("string")).alias("text")
    )
    by_section = pages.groupBy(section.alias("folder")).agg(
        F.concat(F.lit("section "), F.max("page_id").cast("string")).alias("text")
    )
    root = pages.agg(F.concat(F.lit("root "), F.count(F.lit(1)).cast("string")).alias("text")).select(F.lit("").alias("folder"), "text")
    known = by_host.unionByName(by_section).unionByName(root)
    return corpus.context_for_paths(pages.select("path").distinct(), known, 1 << 20).select("path", "context")


def parts_sql(rows: str, keys: str, order: str, sep: str, sep_bytes: int, part: int, name: str, more: str = "") -> str:
    """Check for concat_parts over rows(keys, order, x)."""
    return f"""SELECT {keys}, part, string_agg(x, {sep} ORDER BY {order}) AS {name}{more} FROM (SELECT *, CAST(floor(coalesce(
      sum(strlen(x) + {sep_bytes}) OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {part}) AS BIGINT) AS part FROM ({rows})) GROUP BY {keys}, part"""


@query(
    "concat_dir",
    ctes("files") + parts_sql("SELECT source AS folder, file, '<!-- file: ' || file || ' -->' || chr(10) || text AS x FROM files", "folder", "file", "chr(10) || chr(10)", 2, 50000, "text"),
)
def _(t: Tables):
    rows = files(t).select(F.col("source").alias("folder"), F.col("file").alias("name"), "text")
    return corpus.concat_dir(rows, ("<!-- file: ", " -->"), 50000).drop("items")


_INDEX_ROW = "'- **[Note ' || doc_id || '](' || file || ')** (' || CASE WHEN kind = 'other' THEN 'project' ELSE kind END || ') — ' || lang || ': from ' || source"


@query(
    "build_index_newest",
    ctes("notes") + parts_sql(f"SELECT source AS folder, doc_id, -doc_id AS age, {_INDEX_ROW} AS x FROM notes WHERE lang <> 'es' AND source <> 'src3'", "folder", "age", "chr(10)", 1, 2000, "index"),
)
def _(t: Tables):
    return note_source.rebuild_index(_listed(t), 2000).drop("items")


@query(
    "build_index_by_name",
    ctes("notes") + parts_sql(f"SELECT source AS folder, file, {_INDEX_ROW} AS x FROM notes WHERE lang <> 'es' AND source <> 'src3'", "folder", "file", "chr(10)", 1, 1 << 20, "index"),
)
def _(t: Tables):
    return corpus.build_index(_listed(t), newest=False, part_bytes=1 << 20).drop("items")


def _raw_notes(t: Tables):
    """Notes with a file time of one minute per id."""
    mtime = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000)
    return notes(t).select("doc_id", F.col("source").alias("folder"), "file", mtime.alias("mtime"), "text")


def _listed(t: Tables):
    return note_source.list_notes(_raw_notes(t))


@query(
    "list_notes",
    ctes("notes") + """SELECT doc_id, file, 'Note ' || doc_id AS name, lang || ': from ' || source AS description, CASE WHEN kind = 'other' THEN 'project' ELSE kind END AS type,
      regexp_replace(plain, '^\\s+|\\s+\\z', '', 'g') AS body FROM notes WHERE lang <> 'es' AND source <> 'src3'""",
)
def _(t: Tables):
    return _listed(t).select("doc_id", "file", "name", "description", "type", "body")


@query(
    "write_note_table",
    ctes("notes") + """SELECT doc_id, 'Note ' || doc_id AS name, lang || ': from ' || source AS description, CASE WHEN kind = 'other' THEN 'project' ELSE kind END AS type,
      regexp_replace(plain, '^\\s+|\\s+\\z', '', 'g') AS body FROM notes WHERE lang <> 'es' AND source <> 'src3'""",
)
def _(t: Tables):
    """Notes rendered, written as a table by type, read again and parsed."""
    path = scratch_path(t.spark, "notes")
    note_source.write_note_table(_listed(t).select("doc_id", "name", "description", "type", "body"), path)
    return note_source.list_notes(t.spark.read.parquet(path).drop("type")).select("doc_id", "name", "description", "type", "body")


def _note_folder(t: Tables) -> str:
    """Every document as a file of its own in the folder of its source; one in ten is not there yet."""
    path = scratch_path(t.spark, "notes")
    note_source.write_note_files(_as_files(t).where("doc_id % 10 <> 3"), path)
    return path


def _as_files(t: Tables):
    return t.documents.select("doc_id", F.col("source").alias("folder"), F.concat("doc_id", F.lit(".md")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))


@query(
    "read_markdown_corpus",
    "SELECT doc_id || '.md' AS file, source AS folder, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 3",
)
def _(t: Tables):
    raw = note_source.read_markdown_corpus(t.spark, _note_folder(t))
    return raw.select("file", F.element_at(F.split("folder", "/"), -1).alias("folder"), "text")


@query(
    "note_changes",
    """SELECT doc_id || '.md' AS file, CASE doc_id % 10 WHEN 3 THEN 'new' WHEN 4 THEN 'changed' ELSE 'removed' END AS status,
    CASE doc_id % 10 WHEN 3 THEN coalesce(text, '') WHEN 4 THEN coalesce(text, '') || '!' END AS text FROM documents WHERE doc_id % 10 IN (3, 4, 5)""",
)
def _(t: Tables):
    """Notes are written and indexed; then some come, some change, some go, and some are written again as they were."""
    path = _note_folder(t)
    index = reliable(note_source.note_index(note_source.read_markdown_corpus(t.spark, path)), "note-index")
    part, text = F.col("doc_id") % 10, F.col("text")
    after = F.when(part == 4, F.concat(text, F.lit("!"))).when(part != 5, text)
    note_source.write_note_files(_as_files(t).where(part.isin(3, 4, 5, 6)).withColumn("text", after), path)
    changes = note_source.note_changes(t.spark, path, index)
    return changes.select(F.element_at(F.split("path", "/"), -1).alias("file"), "status", "text")


@query(
    "scan_headers",
    ctes("notes") + """SELECT doc_id, CASE WHEN lang <> 'es' AND source <> 'src3' THEN lang || ': from ' || source END AS description,
      CASE WHEN lang <> 'es' AND source <> 'src3' AND kind <> 'other' THEN kind END AS type FROM notes""",
)
def _(t: Tables):
    return note_source.scan_headers(_raw_notes(t)).select("doc_id", "description", "type")


@query(
    "scan_headers_newest",
    ctes("notes") + """SELECT doc_id, CASE WHEN lang <> 'es' AND source <> 'src3' AND kind <> 'other' THEN kind END AS type FROM notes ORDER BY doc_id DESC LIMIT 200""",
)
def _(t: Tables):
    return corpus.newest_first(note_source.scan_headers(_raw_notes(t)), "mtime", "file").select("doc_id", "type")


@query(
    "delete_notes_stay",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def _(t: Tables):
    stay, _ = note_source.delete_notes(t.documents.select("doc_id", "source"), t.labels.filter("toxic = 1"), "doc_id")
    return stay


@query(
    "delete_notes_report",
    """SELECT doc_id, doc_id IN (SELECT doc_id FROM documents) AS existed FROM (SELECT DISTINCT page_id * 7 AS doc_id FROM pages)""",
)
def _(t: Tables):
    asked = t.pages.select((F.col("page_id") * 7).alias("doc_id"))
    _, report = note_source.delete_notes(t.documents.select("doc_id"), asked, "doc_id")
    return report


@query(
    "not_yet_seen",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t: Tables):
    return catalog.without(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query(
    "pick_selected",
    """SELECT source, doc_id, rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank FROM documents
      WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE rank <= 5""",
)
def _(t: Tables):
    chosen = catalog.pick(t.documents.select("source", "doc_id"), t.labels.filter("quality = 1"), ["doc_id"])
    return corpus.first_per_group(chosen, ["source"], ["doc_id"], 5)


_OVERLAP = """WITH q AS (SELECT DISTINCT query_id, w FROM (SELECT {id} AS query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM {table}) WHERE length(w) > 2),
 d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM documents)),
 s AS (SELECT query_id, doc_id, count(*) AS score FROM q JOIN d USING (w) GROUP BY ALL)
 SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3"""


@query("recall_by_overlap", _OVERLAP.format(id="item_id", table="benchmark"))
def _(t: Tables):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return corpus.recall_by_overlap(asked, t.documents.select("doc_id", "text"))


@query(
    "byte_budget",
    """WITH b AS (SELECT source, doc_id, CASE WHEN strlen(text) > 4096 THEN strlen(left(text, 4096)) + strlen('[... truncated, memory file too large ...]') + 2 ELSE strlen(text) END AS bytes FROM documents),
    r AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before FROM b)
    SELECT source, doc_id, CAST(bytes AS BIGINT) AS bytes, bytes_before, bytes_before < 61440 AS starts FROM r""",
)
def _(t: Tables):
    items = t.documents.select(
        "source", "doc_id", F.octet_length(text.cap_note(F.col("text"))).cast("bigint").alias("bytes")
    )
    return corpus.byte_budget(items, ["source"], ["doc_id"], "bytes", 60 * 1024)


_TREE = "SELECT doc_id, concat('/n/', doc_id) AS path, concat(CASE WHEN doc_id > 0 AND source <> 'src5' THEN concat('@/n/', CAST(floor(doc_id / 3) AS BIGINT)) WHEN source = 'src5' THEN '@./gone' ELSE '@/n/0' END, chr(10), text) AS text FROM documents"


@query(
    "expand_includes",
    f"""WITH RECURSIVE f AS ({_TREE}), l AS (SELECT path, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM f),
    x AS (SELECT path, n, line, CASE WHEN regexp_matches(line, '^@\\./\\S+$') THEN '/n/' || substr(line, 4) WHEN regexp_matches(line, '^@/\\S+$') THEN substr(line, 2) END AS target FROM l),
    r AS (SELECT path AS root, lpad(CAST(n AS VARCHAR), 4, '0') AS position, line, target, CAST([] AS VARCHAR[]) AS open, 0 AS depth FROM x
      UNION ALL SELECT r.root, r.position || '.' || lpad(CAST(x.n AS VARCHAR), 4, '0'), x.line, x.target, list_append(r.open, r.target), r.depth + 1
      FROM r JOIN x ON x.path = r.target WHERE r.depth < 5 AND NOT list_contains(r.open, r.target))
    SELECT root, position, CASE WHEN target IS NULL OR depth = 5 THEN line WHEN list_contains(open, target) THEN '<!-- circular: ' || substr(line, 2) || ' -->' ELSE '<!-- not found: ' || substr(line, 2) || ' -->' END AS line
    FROM r WHERE target IS NULL OR depth = 5 OR list_contains(open, target) OR target NOT IN (SELECT path FROM f)""",
)
def _(t: Tables):
    tree = t.spark.sql(_TREE.replace("FROM documents", "FROM {d}"), d=t.documents.select("doc_id", "source", "text"))
    lines = corpus.expand_includes(tree.select("path", "text"))
    place = F.array_join(F.transform("position", lambda n: F.lpad(n.cast("string"), 4, "0")), ".")
    return lines.select("root", place.alias("position"), "line")


# -- catalogues -------------------------------------------------------------------


@query(
    "catalog_search",
    "SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))",
)
def _(t: Tables):
    found = catalog.catalog_search(
        t.part.select("p_partkey", "p_name", "p_type", "p_size"), "RING", "p_name", "p_type", F.col("p_size") > 25
    )
    return found.select("p_partkey", "p_name")


@query(
    "active_catalog",
    "SELECT p_partkey, p_size <= 25 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AS active FROM part",
)
def _(t: Tables):
    used = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return catalog.active_catalog(t.part.select("p_partkey", "p_size"), used, "p_partkey", F.col("p_size") > 25).select("p_partkey", "active")


@query(
    "restrict_tools",
    """SELECT p_partkey, 'listed' AS how FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 25)
    UNION ALL SELECT p_partkey, 'default' FROM part WHERE p_brand <> 'Brand#1'""",
)
def _(t: Tables):
    part = t.part.select("p_partkey", "p_brand", "p_size")
    allowed = part.groupBy("p_brand").agg(F.avg("p_size").alias("size")).filter("size > 25")
    listed = catalog.restrict(part, allowed, "p_brand", "Brand#1").select("p_partkey", F.lit("listed").alias("how"))
    return listed.unionByName(
        catalog.restrict(part, None, "p_brand", "Brand#1").select("p_partkey", F.lit("default").alias("how"))
    )


@query(
    "layered_override",
    """WITH l AS (SELECT 0 AS layer, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 1, c_nationkey, max(c_name) FROM customer WHERE c_nationkey < 20 GROUP BY 2
      UNION ALL SELECT 2, s_nationkey, max(s_name) FROM supplier WHERE s_acctbal > 9000 GROUP BY 2)
    SELECT k, arg_max(name, layer) AS name, max(layer) AS layer FROM l GROUP BY k""",
)
def _(t: Tables):
    low = t.nation.select(F.lit(0).alias("layer"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    mid = t.customer.filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_name").alias("name"))
    top = t.supplier.filter("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("name"))
    layers = low.unionByName(mid.withColumn("layer", F.lit(1))).unionByName(top.withColumn("layer", F.lit(2)))
    return catalog.layered_override(layers, ["k"], "layer")


@query(
    "catalog_sections",
    parts_sql("""SELECT p_size > 25 AS flag, p_partkey, '- **' || CASE WHEN p_size > 25 THEN '/' ELSE '' END || p_name || ' ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '**: ' || p_type ||
      CASE WHEN p_brand = 'Brand#3' THEN chr(10) || '  When to use: ' || p_brand ELSE '' END AS x, p_name || ' ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name FROM part""", "flag", "name", "chr(10)", 1, 3000, "listing"),
)
def _(t: Tables):
    rows = t.part.select(
        (F.col("p_size") > 25).alias("flag"),
        F.concat("p_name", F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"),
        F.col("p_type").alias("description"),
        F.when(F.col("p_brand") == "Brand#3", F.col("p_brand")).alias("hint"),
    )
    return catalog.catalog_sections(rows, "flag", 3000).drop("items")


@query(
    "merged_catalogue",
    """SELECT c_name AS name, c_mktsegment AS description FROM customer
    UNION ALL SELECT 'mcp__' || n_name || '__' || s_name, 'MCP tool ' || s_name || ' from ' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t: Tables):
    own = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    external = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("server"), F.col("s_name").alias("name"), F.lit("").alias("description")
    )
    return catalog.merged_catalogue(own, external, "mcp")


@query(
    "remove_named",
    "SELECT p_partkey FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_retailprice > 1090)",
)
def _(t: Tables):
    part = t.part.select("p_partkey", "p_name", "p_retailprice")
    return catalog.without(part, part.filter("p_retailprice > 1090"), ["p_name"]).select("p_partkey")


@query("distinct_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables):
    return t.events.select("user_id", "event_type").dropDuplicates()


@query(
    "intersect_allowed",
    "SELECT p_name FROM part WHERE p_brand = 'Brand#7' INTERSECT SELECT p_name FROM part WHERE p_type = 'PROMO'",
)
def _(t: Tables):
    return t.part.filter("p_brand = 'Brand#7'").select("p_name").intersect(t.part.filter("p_type = 'PROMO'").select("p_name"))


@query(
    "tag_class",
    ctes("calls") + """SELECT seq, CASE tool WHEN 'read_file' THEN 'read,parallel,snippable' WHEN 'grep_search' THEN 'read,parallel,snippable'
      WHEN 'run_shell' THEN 'snippable' ELSE 'edit' END AS classes FROM calls""",
)
def _(t: Tables):
    return calls(t).select("seq", F.array_join(predicates.tag_class(F.col("tool")), ",").alias("classes"))


# -- layered settings -------------------------------------------------------------


@query(
    "read_rules",
    """SELECT p_partkey AS layer, CASE WHEN p_size > 25 THEN 'deny' ELSE 'allow' END AS effect, CASE WHEN p_type = 'SMALL' THEN 'run_shell' ELSE 'read_file' END AS tool,
      CASE WHEN p_brand <> 'Brand#1' THEN p_name || '*' END AS pattern FROM part""",
)
def _(t: Tables):
    # Every part becomes one settings document, written and read back as JSON.
    rule = F.expr(
        """concat(CASE WHEN p_type = 'SMALL' THEN 'run_shell' ELSE 'read_file' END,
           CASE WHEN p_brand <> 'Brand#1' THEN concat('(', p_name, '*)') ELSE '' END)"""
    )
    lists = F.when(F.col("p_size") > 25, F.struct(F.array().cast("array<string>").alias("allow"), F.array(rule).alias("deny"))).otherwise(
        F.struct(F.array(rule).alias("allow"), F.array().cast("array<string>").alias("deny"))
    )
    path = scratch_path(t.spark, "settings")
    t.part.select(F.to_json(F.struct(F.col("p_partkey").alias("layer"), lists.alias("permissions"))).alias("value")).write.text(path)
    return config.read_rules(t.spark.read.text(path))


@query(
    "read_layered_config",
    """WITH l AS (SELECT 0 AS layer, 's' || s_suppkey AS name, 'run ' || s_name AS command FROM supplier UNION ALL
      SELECT 1, 's' || s_suppkey, NULL FROM supplier WHERE s_acctbal < 1000 UNION ALL SELECT 2, 's' || s_suppkey, 'serve ' || s_nationkey FROM supplier WHERE s_acctbal > 5000)
    SELECT name, arg_max(command, layer) AS command, CAST(max(layer) AS BIGINT) AS layer FROM l WHERE command IS NOT NULL GROUP BY name""",
)
def _(t: Tables):
    def layer(n: int, rows, command):
        entry = F.to_json(F.create_map(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.struct(command.alias("command"))))
        body = F.concat(F.lit('{"mcpServers":'), entry, F.lit("}")) if n != 2 else entry
        return rows.select(F.lit(n).cast("bigint").alias("layer"), body.alias("value"))

    supplier = t.supplier
    documents = layer(0, supplier, F.concat(F.lit("run "), "s_name"))
    documents = documents.unionByName(layer(1, supplier.filter("s_acctbal < 1000"), F.lit(5)))
    documents = documents.unionByName(
        layer(2, supplier.filter("s_acctbal > 5000"), F.concat(F.lit("serve "), F.col("s_nationkey").cast("string")))
    )
    return config.read_layered_config(documents).select("name", "command", "layer")
