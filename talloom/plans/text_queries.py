"""Queries over text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from talloom.functions import frontmatter, predicates, text
from talloom.operators import catalog, transcript
from talloom.plans.registry import Tables, query
from talloom.plans.standins import calls, ctes, files, notes
from talloom.sources.notes import note_files

WS = r"'^\s+|\s+\z'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def _html(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '<script[\s\S]*?</script>', '', 'gi'), '<style[\s\S]*?</style>', '', 'gi')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, plain in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]:
        x = f"replace({x}, '{entity}', '{plain}')"
    return _trim(rf"regexp_replace({x}, '\s{{2,}}', ' ', 'g')")


def _lines(x: str) -> str:
    return f"len(string_split({x}, chr(10)))"


def _head_tail(x: str, limit: str, reserve: int, a: str, b: str) -> str:
    keep = f"CAST(floor(({limit} - {reserve}) / 2) AS BIGINT)"
    return (
        f"CASE WHEN length({x}) > {limit} THEN left({x}, {keep}) || chr(10) || chr(10) || '{a}' || "
        f"(length({x}) - 2 * {keep}) || '{b}' || chr(10) || chr(10) || right({x}, {keep}) ELSE {x} END"
    )


@query("html_to_text", f"SELECT page_id, {_html('html')} AS text FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", "html").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(
    "truncate_page",
    f"""WITH p AS (SELECT page_id, {_html('html')} AS x FROM pages)
    SELECT page_id, CASE WHEN length(x) > 900 THEN left(x, 900) || chr(10) || chr(10) || '[... truncated at 900 characters]'
      WHEN x = '' THEN '(empty response)' ELSE x END AS text FROM p""",
)
def _(t: Tables):
    return t.pages.select("page_id", "html").select("page_id", text.truncate_chars(text.html_to_text(F.col("html")), 900).alias("text"))


@query(
    "parse_frontmatter",
    ctes("notes") + f"""SELECT doc_id,
      CASE WHEN lang = 'es' OR source = 'src3' THEN NULL ELSE 'Note ' || doc_id END AS name,
      CASE WHEN lang = 'es' OR source = 'src3' THEN NULL ELSE lang || ': from ' || source END AS description,
      CASE WHEN lang = 'es' OR source = 'src3' THEN NULL ELSE kind END AS kind,
      CASE WHEN lang = 'es' OR source = 'src3' THEN text ELSE {_trim('plain')} END AS body FROM notes""",
)
def _(t: Tables):
    parsed = notes(t).select("doc_id", frontmatter.parse_frontmatter(F.col("text")).alias("p"))
    return parsed.select(
        "doc_id", F.col("p.meta")["name"].alias("name"), F.col("p.meta")["description"].alias("description"),
        F.col("p.meta")["type"].alias("kind"), F.col("p.body").alias("body"),
    )


@query(
    "head_tail",
    f"SELECT doc_id, {_head_tail('text', '2000', 60, '[... truncated ', ' chars ...]')} AS text FROM documents",
)
def _(t: Tables):
    return t.documents.select("doc_id", "text").select("doc_id", text.head_tail(F.col("text"), 2000, 60).alias("text"))


_QUOTED = "replace(replace(replace(text, ' th', ' ‘th'), ', ', '”, '), '. ', '″. ')"


@query(
    "normalize_quotes",
    f"""SELECT doc_id, translate({_QUOTED}, '‘’′“”″', '''''''""' || '"') AS text FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", "text").select("doc_id", text.normalize_quotes(F.expr(_QUOTED)).alias("text"))


@query(
    "find_actual",
    f"""WITH d AS (SELECT doc_id, {_QUOTED} AS text, CASE WHEN lang = 'en' THEN 'e" ' ELSE ' ''the' END AS needle FROM documents),
    n AS (SELECT *, instr(translate(text, '‘’′“”″', '''''''""' || '"'), needle) AS pos FROM d)
    SELECT doc_id, CASE WHEN contains(text, needle) THEN needle WHEN pos > 0 THEN substr(text, pos, length(needle)) END AS found FROM n""",
)
def _(t: Tables):
    rows = t.documents.select("doc_id", "text", "lang").select("doc_id", F.expr(_QUOTED).alias("text"), F.expr("CASE WHEN lang = 'en' THEN 'e\" ' ELSE ' \\'the' END").alias("needle"))
    return rows.select("doc_id", text.find_actual(F.col("text"), F.col("needle")).alias("found"))


@query(
    "diff_hunk",
    f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[-1] AS old, 'new ' || lang || chr(10) || source AS new FROM documents),
    b AS (SELECT *, {_lines('substr(text, 1, instr(text, old) - 1)')} AS pos FROM d WHERE old <> '')
    SELECT doc_id, '@@ -' || pos || ',1 +' || pos || ',2 @@' || chr(10) || '- ' || old || chr(10) || '+ ' || replace(new, chr(10), chr(10) || '+ ') AS diff FROM b""",
)
def _(t: Tables):
    rows = t.documents.select(
        "doc_id", "text", F.element_at(text.lines_of(F.col("text")), -1).alias("old"),
        F.concat(F.lit("new "), "lang", F.lit("\n"), "source").alias("new"),
    ).filter("old <> ''")
    return rows.select("doc_id", text.diff_hunk(F.col("text"), F.col("old"), F.col("new")).alias("diff"))


@query(
    "slugify",
    """SELECT p_partkey, left(regexp_replace(regexp_replace(lower('(' || p_name || ') ' || p_brand || ' - ' || p_type || ', made for sale!'),
      '[^a-z0-9]+', '_', 'g'), '^_|_\\z', '', 'g'), 40) AS slug FROM part""",
)
def _(t: Tables):
    name = F.concat(F.lit("("), "p_name", F.lit(") "), "p_brand", F.lit(" - "), "p_type", F.lit(", made for sale!"))
    return t.part.select("p_partkey", text.slugify(name).alias("slug"))


@query("key_hash", "SELECT page_id, left(sha256(url), 16) AS key FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", text.key_hash(F.col("url")).alias("key"))


_AGE = "CAST(greatest(floor((epoch(TIMESTAMP '1998-06-01 12:00:00') - epoch(o_orderdate)) / 86400), 0) AS BIGINT)"


@query(
    "age_label",
    f"""SELECT o_orderkey, CASE {_AGE} WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE {_AGE} || ' days ago' END AS age,
      CASE WHEN {_AGE} <= 1 THEN '' ELSE 'saved ' || {_AGE} || ' days back' END AS note FROM orders""",
)
def _(t: Tables):
    now = F.lit("1998-06-01 12:00:00").cast("timestamp")
    at = F.col("o_orderdate").cast("timestamp")
    return t.orders.select(
        "o_orderkey", text.age_label(at, now).alias("age"),
        text.freshness_note(at, now, "saved {days} days back").alias("note"),
    )


@query(
    "manifest_line",
    """SELECT event_id, '- ' || CASE WHEN event_type = 'view' THEN '' ELSE '[' || event_type || '] ' END || 'e' || event_id || '.md (' ||
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ')' || CASE WHEN value < 10 THEN '' ELSE ': ' || props END AS line FROM events""",
)
def _(t: Tables):
    return t.events.select(
        "event_id",
        text.manifest_line(
            F.when(F.col("event_type") != "view", F.col("event_type")),
            F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".md")),
            F.col("ts"),
            F.when(F.col("value") >= 10, F.col("props")),
        ).alias("line"),
    )


@query(
    "wrap_block",
    "SELECT conv_id, turn, '<note>' || chr(10) || role || chr(10) || chr(10) || text || chr(10) || '</note>' AS block FROM conversations",
)
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", text.wrap_block("note", F.col("role"), F.col("text")).alias("block"))


@query(
    "fill_template",
    """SELECT p_partkey, 'Use ' || p_name || ' $1 and ' || p_name || ' $1 from dir/' || p_type || ' for ' || p_brand || ' in dir/' || p_type AS text FROM part""",
)
def _(t: Tables):
    template = F.concat(F.lit("Use $ARGUMENTS and ${ARGUMENTS} from ${DIR} for "), "p_brand", F.lit(" in ${DIR}"))
    filled = text.fill_template(
        template, {"args": ["$ARGUMENTS", "${ARGUMENTS}"], "dir": ["${DIR}"]},
        {"args": F.concat("p_name", F.lit(" $1")), "dir": F.concat(F.lit("dir/"), "p_type")},
    )
    return t.part.select("p_partkey", filled.alias("text"))


_LIST = """CASE p_type WHEN 'SMALL' THEN concat('["', p_name, '","', p_brand, '"]')
 WHEN 'LARGE' THEN concat('[', p_name, ',  ', p_brand, ']') ELSE concat(p_name, ' , ', p_brand) END"""


@query("parse_list", "SELECT p_partkey, p_name || '|' || p_brand AS items, CAST(2 AS INTEGER) AS n FROM part")
def _(t: Tables):
    rows = t.part.select("p_partkey", text.parse_list(F.expr(_LIST)).alias("l"))
    return rows.select("p_partkey", F.array_join("l", "|").alias("items"), F.size("l").alias("n"))


_FLAG = "CASE WHEN p_size > 40 THEN 'false' WHEN p_size > 20 THEN 'true' WHEN p_size > 10 THEN 'False' END"


@query("flag_default_true", "SELECT p_partkey, p_size <= 40 AS invocable FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", text.flag_default_true(F.expr(_FLAG)).alias("invocable"))


@query(
    "first_json_object",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def _(t: Tables):
    prose = F.expr(
        """CASE event_type WHEN 'error' THEN concat('no object ', event_id)
           WHEN 'click' THEN concat('bad {', props) ELSE concat('Sure:\n```\n', props, '\n``` done') END"""
    )
    return t.events.select("event_id", F.try_variant_get(text.first_json_object(prose), "$.k", "bigint").alias("k"))


@query(
    "prefix_verdict",
    f"""SELECT conv_id, turn, role = 'user' AS ok, CASE WHEN role = 'user' THEN '' ELSE {_trim('text')} END AS reason FROM conversations""",
)
def _(t: Tables):
    said = F.expr("concat(CASE WHEN role = 'user' THEN ' DONE: ' ELSE '\\nOPEN: ' END, text)")
    verdict = text.prefix_verdict(said, "DONE", "OPEN:")
    return t.conversations.select("conv_id", "turn", verdict["ok"].alias("ok"), verdict["reason"].alias("reason"))


@query(
    "split_command",
    """SELECT p_partkey, CASE WHEN p_size > 5 THEN split_part(p_name, ' ', 1) END AS name,
      CASE WHEN p_size > 5 THEN split_part(p_name, ' ', 2) || ' of ' || p_brand END AS rest FROM part""",
)
def _(t: Tables):
    line = F.expr("concat(CASE WHEN p_size > 5 THEN '/' ELSE '' END, p_name, ' of ', p_brand, ' \n')")
    made = text.split_command(line)
    return t.part.select("p_partkey", made["name"].alias("name"), made["rest"].alias("rest"))


_LONG = "concat(command, ' && ', command, ' && ', command, ' && ', path)"


@query(
    "call_summary",
    ctes("calls") + f"""SELECT seq, CASE WHEN tool IN ('read_file', 'write_file', 'edit_file') THEN path
      WHEN tool = 'grep_search' THEN '"' || event_type || '" in ' || path
      WHEN tool = 'run_shell' THEN CASE WHEN length({_LONG}) > 60 THEN left({_LONG}, 60) || '...' ELSE {_LONG} END ELSE '' END AS summary FROM calls""",
)
def _(t: Tables):
    return calls(t).select(
        "seq", text.call_summary(F.col("tool"), F.col("path"), F.col("event_type"), F.expr(_LONG)).alias("summary")
    )


@query("backoff_ms", "SELECT p_partkey, CAST(least(1000 * pow(2, p_size), 30000) AS BIGINT) AS wait FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", text.backoff_ms(F.col("p_size")).alias("wait"))


@query("trim_ws", f"SELECT doc_id, {_trim('text')} AS text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", "text").select("doc_id", text.trim_ws(F.concat(F.lit("\t\n "), "text", F.lit(" \n\f"))).alias("text"))


@query(
    "mark_last_block",
    """SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AND role <> 'assistant' AS mark FROM conversations""",
)
def _(t: Tables):
    blocks = t.conversations.select("conv_id", "turn", "role")
    return transcript.mark_last_block(blocks, ["conv_id"], ["turn"], F.col("role") == "assistant").select("conv_id", "turn", "mark")


@query(
    "mark_static",
    """WITH p AS (SELECT conv_id, turn, role, turn % 5 < 2 AS static, text FROM conversations WHERE trim(text) <> ''),
    s AS (SELECT *, sum(CASE WHEN static THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS moved FROM p)
    SELECT conv_id, turn, coalesce(moved = 0 AND turn = max(CASE WHEN moved = 0 THEN turn END) OVER (PARTITION BY conv_id), FALSE) AS mark FROM s""",
)
def _(t: Tables):
    """Prompt parts of which the first turns are fixed."""
    parts = t.conversations.select("conv_id", "turn", "text")
    return transcript.mark_static(parts, F.col("turn") % 5 < 2, "turn", "conv_id").select("conv_id", "turn", "mark")


@query(
    "capability",
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 0 WHEN contains(lower(p_name), 'small') AND contains(lower(p_name), 'ring') THEN 64
      WHEN contains(lower(p_name), 'small') THEN 32 ELSE 16 END AS room FROM part""",
)
def _(t: Tables):
    rules = [(["red"], 0), (["small", "ring"], 64), (["small"], 32)]
    return t.part.select("p_partkey", text.lookup_ordered(F.col("p_name"), rules, 16).alias("room"))


@query(
    "reshape_def",
    """SELECT p_partkey, '{"type":"function","function":{"name":"' || p_name || '","description":"' || p_type || '","parameters":{"brand":"' || p_brand || '","size":' || p_size || '}}}' AS definition FROM part""",
)
def _(t: Tables):
    params = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return catalog.reshape_def(t.part, "p_name", "p_type", params).select("p_partkey", "definition")


@query(
    "preview_lines",
    f"""SELECT doc_id, CASE WHEN {_lines('text')} > 3 THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10) || '  ... (' || {_lines('text')} || ' lines total)'
      ELSE text END AS text FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", "text").select("doc_id", text.preview_lines(F.col("text"), 3).alias("text"))


@query(
    "cap_index",
    f"""WITH l AS (SELECT doc_id, CASE WHEN {_lines('text')} > 5 THEN array_to_string(string_split(text, chr(10))[1:5], chr(10)) || chr(10) || chr(10) || '[... truncated, too many memory entries ...]' ELSE text END AS x FROM documents)
    SELECT doc_id, CASE WHEN strlen(x) > 2500 THEN left(x, 2500) || chr(10) || chr(10) || '[... truncated, index too large ...]' ELSE x END AS text FROM l""",
)
def _(t: Tables):
    return t.documents.select("doc_id", "text").select("doc_id", text.cap_index(F.col("text"), 5, 2500).alias("text"))


@query(
    "text_stats",
    f"""SELECT doc_id, {_lines('text')} AS lines, CAST(strlen(text) AS BIGINT) AS bytes,
      CAST(CAST(round(CAST(strlen(text) AS DECIMAL(20,4)) * CAST(0.0009765625 AS DECIMAL(11,10)), 1) AS DECIMAL(20,1)) AS VARCHAR) AS kb FROM documents""",
)
def _(t: Tables):
    col = F.col("text")
    return t.documents.select(
        "doc_id", text.line_count(col).alias("lines"), F.octet_length(col).cast("bigint").alias("bytes"), text.size_kb(col).alias("kb")
    )


@query(
    "count_occurrences",
    "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents",
)
def _(t: Tables):
    return t.documents.select("doc_id", "text").select("doc_id", text.count_occurrences(F.col("text"), F.lit("the")).alias("n"))


@query(
    "number_lines",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (CASE WHEN i > 9999 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 4, ' ') END) || ' | ' || x), chr(10)) AS text FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", "text").select("doc_id", text.numbered(F.col("text")).alias("text"))


_ASKED = "CASE lang WHEN 'de' THEN '漢字' WHEN 'fr' THEN replace(replace(text, ' ', ''), chr(10), '') WHEN 'es' THEN ' あ ' ELSE text END"


@query(
    "is_substantial",
    f"""WITH a AS (SELECT doc_id, {_trim(_ASKED)} AS x FROM documents)
    SELECT doc_id, len(regexp_extract_all(x, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]')) >= 2 OR regexp_matches(x, '\\s') AS substantial FROM a""",
)
def _(t: Tables):
    return t.documents.select("doc_id", "text", "lang").select("doc_id", text.is_substantial(F.expr(_ASKED)).alias("substantial"))


@query("only_http", "SELECT page_id, url, regexp_matches(url, '^(?i)https?://') AS ok FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", "url", predicates.is_http(F.col("url")).alias("ok"))


_SPACED = "CASE lang WHEN 'de' THEN concat('mcp__', source) WHEN 'fr' THEN concat('mcp__', source, '__get__', lang) ELSE concat('mcp__', source, '__', lang) END"


@query(
    "split_namespace",
    """SELECT doc_id, CASE WHEN lang <> 'de' THEN source END AS server, CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN 'get__fr' ELSE lang END AS tool FROM documents""",
)
def _(t: Tables):
    made = text.split_namespace(F.expr(_SPACED))
    return t.documents.select("doc_id", made["server"].alias("server"), made["tool"].alias("tool"))


@query(
    "valid_type_or_default",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '5-LOW' END AS listed,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS scanned FROM orders""",
)
def _(t: Tables):
    col, allowed = F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]
    return t.orders.select(
        "o_orderkey", frontmatter.valid_type(col, allowed, "5-LOW").alias("listed"), frontmatter.valid_type(col, allowed, None).alias("scanned")
    )


@query(
    "render_frontmatter",
    ctes("files") + """SELECT doc_id, kind || '_' || left(regexp_replace(regexp_replace(lower(source || ' ' || file), '[^a-z0-9]+', '_', 'g'), '^_|_\\z', '', 'g'), 40) || '.md' AS file,
      '---' || chr(10) || 'name: ' || source || ' ' || file || chr(10) || 'description: in ' || lang || chr(10) || 'type: ' || kind || chr(10) || '---' || chr(10) || chr(10) || text AS text
    FROM (SELECT *, CASE WHEN lang = 'en' THEN 'user' ELSE 'project' END AS kind FROM files)""",
)
def _(t: Tables):
    entries = files(t).select(
        "doc_id", F.concat_ws(" ", "source", "file").alias("name"), F.concat(F.lit("in "), "lang").alias("description"),
        F.when(F.col("lang") == "en", "user").otherwise("project").alias("type"), F.col("text").alias("body"),
    )
    return note_files(entries).select("doc_id", "file", "text")
