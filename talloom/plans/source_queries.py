"""Queries that write derived documents, read them back, or run caller functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talloom import plugins
from talloom.functions.text import manifest_line
from talloom.operators import logs as log_ops
from talloom.operators import policy, transcript
from talloom.operators import usage as use
from talloom.plans.registry import ORACLES, Tables, query
from talloom.plans.session_queries import _RULED, _rules, _valued
from talloom.plans.standins import calls, ctes, files
from talloom.plans.text_queries import _html
from talloom.session import scratch_path
from talloom.sources import definitions, logs, session_store, sessions

# -- session documents --------------------------------------------------------------

# One document per conversation, as a session file is. Conversations that open with a system
# message use the shape with tool_calls, the others the shape with blocks.
_DOC_ID = "CAST(conv_id AS STRING)"


def _documents(t: Tables):
    """Session documents as JSON lines; every turn also has a call and its result."""
    rows = t.spark.sql(f"SELECT {_DOC_ID} AS id, conv_id, turn, role, text FROM {{c}}", c=t.conversations)
    call = F.concat(F.lit("c"), F.col("turn").cast("string"))
    args = F.to_json(F.struct(F.col("turn").alias("n")))
    text_block = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    use_block = F.to_json(F.struct(
        F.lit("tool_use").alias("type"), call.alias("id"), F.lit("read_file").alias("name"), F.struct(F.col("turn").alias("n")).alias("input")
    ))
    result_block = F.to_json(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), F.concat(F.lit("r"), call).alias("content")))
    role = F.to_json(F.struct("role", F.lit(0).alias("z")))
    role = F.substring_index(role, ',"z"', 1)
    block_shape = F.concat(role, F.lit(',"content":['), text_block, F.lit(","), use_block, F.lit(']},{"role":"user","content":['), result_block, F.lit("]}"))
    asked = F.to_json(F.array(F.struct(
        call.alias("id"), F.lit("function").alias("type"),
        F.struct(F.lit("read_file").alias("name"), F.when(F.col("role") == "user", F.lit("{broken")).otherwise(args).alias("arguments")).alias("function"),
    )))
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    plain = F.substr(plain, F.lit(1), F.length(plain) - 1)
    reply = F.to_json(F.struct(F.lit("tool").alias("role"), call.alias("tool_call_id"), F.concat(F.lit("r"), call).alias("content")))
    call_shape = F.concat(plain, F.lit(',"tool_calls":'), asked, F.lit("},"), reply)
    opens = t.conversations.filter("role = 'system'").select(F.col("conv_id").alias("_c")).distinct()
    rows = rows.join(opens, F.col("conv_id") == F.col("_c"), "left")
    second = F.col("_c").isNotNull()
    rows = rows.select("id", "conv_id", "turn", second.alias("second"), F.when(second, call_shape).otherwise(block_shape).alias("m"))
    docs = rows.groupBy("id", "conv_id", "second").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), ",").alias("ms"),
        (F.count(F.lit(1)) * 2).alias("n"),
    )
    head = F.to_json(F.struct(
        "id", F.lit("m1").alias("model"), F.concat(F.lit("/home/"), F.col("conv_id").cast("string")).alias("cwd"),
        F.concat(F.lit("2024-01-01T00:00:00."), F.lpad(F.pmod("conv_id", F.lit(1000)).cast("string"), 3, "0"), F.lit("Z")).alias("startTime"),
        F.col("n").alias("messageCount"),
    ))
    name = F.when(F.col("second"), "messagesB").otherwise("messagesA")
    return docs.select("id", F.concat(F.lit('{"metadata":'), head, F.lit(',"'), name, F.lit('":['), "ms", F.lit("]}")).alias("value"))


def _read_back(t: Tables, documents):
    path = scratch_path(t.spark, "sessions")
    documents.select("value").write.text(path)
    return sessions.read_sessions(t.spark, path)


_MARKED = f"c AS (SELECT {_DOC_ID} AS id, *, conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AS second, row_number() OVER (PARTITION BY {_DOC_ID} ORDER BY turn) - 1 AS i FROM conversations)"


@query(
    "read_sessions_messages",
    f"""WITH {_MARKED} SELECT id AS session_id, 2 * i AS msg_idx, role, CASE WHEN second THEN text END AS text FROM c
    UNION ALL SELECT id, 2 * i + 1, CASE WHEN second THEN 'tool' ELSE 'user' END, CASE WHEN second THEN 'rc' || turn END FROM c""",
)
def _(t: Tables):
    return _read_back(t, _documents(t)).messages


@query(
    "read_sessions_blocks",
    f"""WITH {_MARKED} SELECT id AS session_id, 2 * i AS msg_idx, CAST(0 AS BIGINT) AS block_idx, 'text' AS type, text, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS VARCHAR) AS input, CAST(NULL AS VARCHAR) AS result FROM c
    UNION ALL SELECT id, 2 * i, 1, 'tool_use', NULL, 'c' || turn, 'read_file', CASE WHEN second AND role = 'user' THEN '{{}}' ELSE '{{"n":' || turn || '}}' END, NULL FROM c
    UNION ALL SELECT id, 2 * i + 1, 0, 'tool_result', NULL, 'c' || turn, NULL, NULL, 'rc' || turn FROM c""",
)
def _(t: Tables):
    return _read_back(t, _documents(t)).blocks


@query(
    "session_catalog",
    f"""WITH {_MARKED} SELECT id, 'm1' AS model, '/home/' || conv_id AS cwd, '2024-01-01 00:00:00.' || lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') AS start_time, 2 * count(*) AS message_count
    FROM c WHERE NOT second GROUP BY id, conv_id""",
)
def _(t: Tables):
    # Documents of the second shape lose their end and no longer parse.
    broken = F.col("value").contains("messagesB")
    cut = F.when(broken, F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    found = _read_back(t, _documents(t).withColumn("value", cut)).metadata
    return found.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSS"))


@query("session_quarantine", f"WITH {_MARKED} SELECT count(DISTINCT id) AS corrupt FROM c WHERE second")
def _(t: Tables):
    broken = F.col("value").contains("messagesB")
    cut = F.when(broken, F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return _read_back(t, _documents(t).withColumn("value", cut)).corrupt.agg(F.count(F.lit(1)).alias("corrupt"))


@query(
    "pair_calls_in_sessions",
    f"""WITH {_MARKED} SELECT id AS session_id, 'c' || turn AS call_id, 'read_file' AS tool, 'rc' || turn AS result FROM c""",
)
def _(t: Tables):
    blocks = _read_back(t, _documents(t)).blocks
    made = blocks.filter("type = 'tool_use'").select("session_id", "call_id", "tool")
    results = blocks.filter("type = 'tool_result'").select("session_id", "call_id", "result")
    return transcript.pair_calls(results, made, ["session_id", "call_id"]).select("session_id", "call_id", "tool", "result")


@query(
    "write_sessions",
    """WITH s AS (SELECT user_id AS id, ts AS saved_at, event_type AS model FROM events UNION ALL SELECT user_id, ts + INTERVAL 1 YEAR, 'saved ' || event_type FROM events WHERE event_type = 'view')
    SELECT id, arg_max(model, saved_at) AS model, strftime(max(saved_at), '%Y-%m-%d %H:%M:%S.%f') AS saved_at FROM s GROUP BY id""",
)
def _(t: Tables):
    """Saves of many rows, of some again, and of one hour late; read as they are."""
    path = scratch_path(t.spark, "saved")
    for rows in _saves(t):
        session_store.write_sessions(rows, path)
    return _saved_rows(session_store.stored_sessions(t.spark, path))


def _saves(t: Tables):
    first = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("saved_at"), F.col("event_type").alias("model"))
    again = t.events.filter("event_type = 'view'").select(
        F.col("user_id").alias("id"), (F.col("ts") + F.expr("INTERVAL 1 YEAR")).alias("saved_at"), F.concat(F.lit("saved "), "event_type").alias("model")
    )
    stale = first.withColumns({"saved_at": F.col("saved_at") - F.expr("INTERVAL 1 YEAR"), "model": F.lit("stale")})
    return [first, again, stale]


def _saved_rows(stored):
    return stored.select("id", "model", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("saved_at"))


@query("compact_sessions", ORACLES["write_sessions"])
def _(t: Tables):
    """The same saves with compactions between them, in buckets of two kilobytes."""
    path = scratch_path(t.spark, "compacted")
    for rows in _saves(t):
        session_store.write_sessions(rows, path)
        session_store.compact_sessions(t.spark, path, bucket_bytes=2048)
    return _saved_rows(session_store.stored_sessions(t.spark, path))


# -- line logs ------------------------------------------------------------------------


def _served_log(t: Tables):
    """Every event as a log line; calls to the shell leave lines that do not parse."""
    good = F.to_json(F.struct(
        F.col("tool").alias("category"), F.col("seq"), F.array(F.concat(F.lit("out "), "path"), F.col("command")).alias("toolResults")
    ))
    line = F.when(F.col("tool") == "run_shell", F.concat(F.lit("server: {"), "command")).otherwise(good)
    path = scratch_path(t.spark, "served")
    calls(t).select(line.alias("value")).write.text(path)
    return path


@query(
    "read_event_log_keep",
    ctes("calls") + "SELECT CASE WHEN tool = 'run_shell' THEN 'PARSE_ERROR' ELSE tool END AS category, CASE WHEN tool = 'run_shell' THEN 'server: {' || command END AS raw, CASE WHEN tool <> 'run_shell' THEN seq END AS seq FROM calls",
)
def _(t: Tables):
    log = logs.read_event_log(t.spark, _served_log(t), "keep")
    return log.select("category", "raw", F.try_variant_get("event", "$.seq", "bigint").alias("seq"))


@query(
    "read_event_log_drop",
    ctes("calls") + "SELECT tool AS category, count(*) AS events FROM calls WHERE tool <> 'run_shell' GROUP BY 1",
)
def _(t: Tables):
    return log_ops.category_counts(logs.read_event_log(t.spark, _served_log(t), "drop"), "category")


@query(
    "result_texts",
    ctes("calls") + "SELECT tool AS category, unnest(['out ' || path, command]) AS result FROM calls WHERE tool <> 'run_shell'",
)
def _(t: Tables):
    return logs.result_texts(logs.read_event_log(t.spark, _served_log(t), "keep"))


@query(
    "read_pages",
    f"""WITH p AS (SELECT page_id, page_id % 10 <> 3 AS http, url, {_html('html')} AS x FROM pages)
    SELECT page_id, CASE WHEN http THEN url ELSE 'ftp' || substr(url, 5) END AS url, http AS ok,
      CASE WHEN length(x) > 5000 THEN left(x, 5000) || chr(10) || chr(10) || '[... truncated at 5000 characters]' WHEN x = '' THEN '(empty response)' ELSE x END AS text FROM p""",
)
def _(t: Tables):
    """Pages with readable text; every tenth one has an address of another kind."""
    url = F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("ftp"), F.substr("url", F.lit(5)))).otherwise(F.col("url"))
    return logs.read_pages(t.pages.withColumn("url", url), 5000).select("page_id", "url", "ok", "text")


# -- definitions ------------------------------------------------------------------------

_DEFINED = """SELECT 0 AS layer, concat('user/skills/', p_partkey) AS folder, p_partkey, p_name, p_brand, p_type, p_size FROM part
 UNION ALL SELECT 1 AS layer, concat('project/skills/', p_partkey) AS folder, p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_size > 25"""


@query(
    "parse_definitions",
    """WITH d AS (SELECT *, p_size > 25 AS own FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(CASE WHEN own THEN 1 ELSE 0 END AS INTEGER) AS layer, p_type AS description, p_brand AS when_to_use, CASE WHEN p_size > 10 THEN 'read_file|' || p_type END AS allowed_tools,
      p_size <> 7 AS user_invocable, CASE WHEN p_type = 'SMALL' THEN 'fork' ELSE 'inline' END AS context, 'Do ' || p_name || CASE WHEN own THEN ' now' ELSE '' END AS template FROM d""",
)
def _(t: Tables):
    rows = t.spark.sql(_DEFINED.replace("FROM part", "FROM {p}"), p=t.part)
    note = F.expr(
        """concat('---\nname: ', CASE WHEN p_brand = 'Brand#2' THEN '' ELSE CAST(p_partkey AS STRING) END, '\ndescription: ', p_type, '\n',
           CASE WHEN p_type = 'LARGE' THEN 'when_to_use: ' ELSE 'when-to-use: ' END, p_brand, '\n',
           CASE WHEN p_size > 40 THEN concat('allowed-tools: ["read_file", "', p_type, '"]\n') WHEN p_size > 10 THEN concat('allowed-tools: read_file, ', p_type, '\n') ELSE '' END,
           CASE WHEN p_size = 7 THEN 'user_invocable: false\n' ELSE '' END, 'context: ', CASE WHEN p_type = 'SMALL' THEN 'fork' ELSE 'other' END,
           '\n---\n\nDo ', p_name, CASE WHEN layer = 1 THEN ' now' ELSE '' END, '\n')"""
    )
    found = definitions.parse_definitions(rows.select("layer", "folder", note.alias("text")))
    return found.withColumn("allowed_tools", F.array_join("allowed_tools", "|")).drop("folder")


# -- caller functions ---------------------------------------------------------------------


def _select_english(manifests: list[str]) -> list[str]:
    """A stand-in selector: names the English files of a manifest, as prose around JSON."""
    import json
    import re

    answers = []
    for m in manifests:
        names = re.findall(r"\] (\S+\.en) \(", m)
        answers.append("Sure:\n```json\n" + json.dumps({"selected": names}) + "\n```")
    return answers


@query(
    "select_with_function",
    ctes("files") + "SELECT source, file, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank FROM files WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5",
)
def _(t: Tables):
    line = manifest_line(F.lit("user"), F.col("file"), F.lit("2024-01-01").cast("timestamp"), F.col("lang"))
    rows = files(t).select("source", "doc_id", "file", line.alias("line"))
    return plugins.select_with(rows, ["source"], "file", ["doc_id"], "line", _select_english).select("source", "file", "rank")


def _count_lines(transcripts: list[str]) -> list[str]:
    return [f"{len(x.splitlines())} lines, {len(x)} characters" for x in transcripts]


@query(
    "summarise_with_function",
    """WITH s AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id)
    SELECT conv_id, len(string_split(x, chr(10))) || ' lines, ' || length(x) || ' characters' AS summary FROM s""",
)
def _(t: Tables):
    return plugins.summarise_with(t.conversations, "conv_id", "turn", _count_lines)


class _SplitWords:
    """An external tool: the words of a text with their places."""

    def eval(self, text: str):
        for i, word in enumerate(text.split(" ")):
            yield i, word


@query(
    "external_tool",
    "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)",
)
def _(t: Tables):
    plugins.register_tool(t.spark, "ext__text__words", _SplitWords, "place int, word string")
    return t.spark.sql("SELECT p_partkey, place, word FROM {part}, LATERAL ext__text__words(p_name)", part=t.part)


@query(
    "apply_approvals",
    ctes("calls", more=_RULED) + """, x AS (SELECT DISTINCT path FROM calls WHERE tool = 'read_file'),
    d AS (SELECT seq, session, CASE WHEN rule = 'deny' THEN 'deny' WHEN rule = 'allow' OR tool IN ('read_file', 'grep_search') THEN 'allow'
      WHEN (tool = 'run_shell' AND NOT starts_with(value, 'echo')) OR (tool IN ('write_file', 'edit_file') AND (value IS NULL OR value NOT IN (SELECT path FROM x))) THEN 'confirm' ELSE 'allow' END AS action FROM u)
    SELECT seq, action, CASE WHEN action <> 'confirm' THEN action WHEN session IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'allow' WHEN session IN (SELECT c_custkey FROM customer) THEN 'deny' ELSE 'confirm' END AS final FROM d""",
)
def _(t: Tables):
    existing = calls(t).filter("tool = 'read_file'").select("path")
    decided = policy.decide(_valued(t).withColumn("mode", F.lit("default")), _rules(t), existing)
    decided = decided.select("seq", "session", F.col("decision.action").alias("action"))
    approvals = t.customer.select(F.col("c_custkey").alias("session"), (F.col("c_acctbal") > 0).alias("approved"))
    return plugins.apply_approvals(decided, approvals, ["session"]).select("seq", "action", "final")


def _word_count_task(prompt: str) -> tuple[str, int, int]:
    return prompt.upper(), len(prompt), prompt.count(" ") + 1


@query(
    "run_tasks",
    "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 10 END AS parent_id, upper(o_orderpriority || ' of ' || o_custkey) AS text FROM orders",
)
def _(t: Tables):
    return plugins.run_tasks(_tasks(t), _word_count_task).select("task_id", "parent_id", "text")


def _tasks(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("task_id"),
        F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 10).cast("bigint")).alias("parent_id"),
        F.concat("o_orderpriority", F.lit(" of "), F.col("o_custkey").cast("string")).alias("prompt"),
    )


@query(
    "run_tasks_rollup",
    """WITH RECURSIVE r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 10 END AS parent_id, length(o_orderpriority || ' of ' || o_custkey) AS i, len(string_split(o_orderpriority || ' of ' || o_custkey, ' ')) AS o FROM orders),
    c AS (SELECT run_id AS anc, parent_id, i, o FROM r UNION ALL SELECT r.run_id, r.parent_id, c.i, c.o FROM c JOIN r ON r.run_id = c.parent_id)
    SELECT anc AS run_id, CAST(sum(i) AS BIGINT) AS in_tok, CAST(sum(o) AS BIGINT) AS out_tok FROM c GROUP BY anc""",
)
def _(t: Tables):
    done = plugins.run_tasks(_tasks(t), _word_count_task)
    return use.tree_rollup(done.select(F.col("task_id").alias("run_id"), "parent_id", "in_tok", "out_tok")).drop("on_cycle")
