"""Whole flows: several operators as one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from talloom.functions import text
from talloom.operators import catalog, compress, corpus, logs, policy, transcript
from talloom.operators import usage as use
from talloom.plans.registry import Tables, query
from talloom.plans.session_queries import _COST, _RULED, _prices, _rules, _valued
from talloom.plans.source_queries import _MARKED, _documents, _read_back
from talloom.plans.standins import calls, ctes, files, usage
from talloom.session import reliable, small_side

_NOW = "2024-03-01"


@query(
    "recall_context",
    ctes("files", more="""q AS (SELECT item_id AS query_id, text FROM benchmark WHERE regexp_matches(regexp_replace(text, '^\\s+|\\s+\\z', '', 'g'), '\\s')),
      c AS (SELECT * FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
      qw AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM q) WHERE length(w) > 2),
      dw AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM c)),
      s AS (SELECT query_id, doc_id, count(*) AS score FROM qw JOIN dw USING (w) GROUP BY ALL),
      k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5),
      b AS (SELECT query_id, score, doc_id, path, CASE WHEN strlen(text) > 4096 THEN left(text, 4096) || chr(10) || chr(10) || '[... truncated, memory file too large ...]' ELSE text END AS body FROM k JOIN c USING (doc_id)),
      r AS (SELECT *, coalesce(sum(strlen(body)) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)""")
    + """SELECT query_id, string_agg('<note>' || chr(10) || 'Memory (saved 60 days ago): ' || path || ':' || chr(10) || chr(10) || body || chr(10) || '</note>', chr(10) || chr(10) ORDER BY score DESC, doc_id) AS context, count(*) AS notes
    FROM r WHERE before < 8000 GROUP BY query_id""",
)
def _(t: Tables):
    """Gate, leave out seen notes, score, pick, cut, budget, render."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text").filter(text.is_substantial(F.col("text")))
    candidates = catalog.without(files(t), t.labels.filter("toxic = 1"), ["doc_id"])
    # a few rows per query, stored: later steps read them more than once, and texts are not moved to meet them
    best = reliable(corpus.recall_by_overlap(asked, candidates.select("doc_id", "text"), k=5), "best")
    body = text.cap_note(F.col("text"))
    chosen = reliable(candidates.select("doc_id", "path", body.alias("body")).join(small_side(best), "doc_id"), "chosen")
    sized = chosen.withColumns({"size": F.octet_length("body").cast("bigint"), "back": -F.col("score")})
    fits = corpus.byte_budget(sized, ["query_id"], ["back", "doc_id"], "size", 8000).filter("starts")
    age = text.age_label(F.lit("2024-01-01").cast("timestamp"), F.lit(_NOW).cast("timestamp"))
    header = F.concat(F.lit("Memory (saved "), age, F.lit("): "), "path", F.lit(":"))
    block = text.wrap_block("note", header, F.col("body"))
    parts = corpus.concat_parts(fits, ["query_id"], ["back", "doc_id"], block, "\n\n", 1 << 24, "context")
    return parts.select("query_id", "context", F.col("items").alias("notes"))


@query(
    "session_report",
    ctes("usage", "calls", more=_COST + ", " + _RULED + """, d AS (SELECT session, count(*) AS calls, count(*) FILTER (WHERE rule = 'deny') AS denied FROM u GROUP BY 1),
      m AS (SELECT session, CAST(sum(cost) AS VARCHAR) AS cost, arg_max(in_tok + out_tok + cache_read + cache_write, seq) AS context_tokens FROM priced GROUP BY 1),
      b AS (SELECT session, tool IN ('read_file', 'grep_search') AS safe, lag(tool IN ('read_file', 'grep_search')) OVER (PARTITION BY session ORDER BY ts, seq) AS before FROM calls)""")
    + """SELECT session, calls, denied, cost, context_tokens, CAST(batches AS BIGINT) AS batches FROM d JOIN m USING (session)
      JOIN (SELECT session, sum(CASE WHEN safe AND coalesce(before, FALSE) THEN 0 ELSE 1 END) AS batches FROM b GROUP BY 1) USING (session)""",
)
def _(t: Tables):
    """Per session: calls, denials by rule, cost, last context and batches."""
    ruled = policy.match_rules(_valued(t), _rules(t)).groupBy("session").agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("rule") == "deny", 1)).alias("denied")
    )
    size = sum((F.col(c) for c in use.TOKEN_CLASSES[1:]), F.col(use.TOKEN_CLASSES[0]))
    spent = use.cost(usage(t), _prices(t), "model").groupBy("session").agg(
        F.sum("cost").cast("decimal(28,6)").cast("string").alias("cost"), F.max_by(size, "seq").alias("context_tokens")
    )
    safe = F.col("tool").isin("read_file", "grep_search")
    batches = transcript.parallel_batches(calls(t).select("session", "ts", "seq", "tool"), ["session"], ["ts", "seq"], safe)
    batches = batches.groupBy("session").agg(F.max("batch").alias("batches"))
    return ruled.join(spent, "session").join(batches, "session")


@query(
    "compress_sessions",
    f"""WITH {_MARKED}, n AS (SELECT id, count(*) AS n FROM c GROUP BY 1)
    SELECT id AS session_id, 2 * i + 1 AS msg_idx, CASE WHEN n - i > 3 THEN '[Old result cleared]' ELSE 'rc' || turn END AS result FROM c JOIN n USING (id)""",
)
def _(t: Tables):
    """Read documents, pair results with calls, clear old results of idle sessions."""
    blocks = _read_back(t, _documents(t)).blocks
    made = blocks.filter("type = 'tool_use'").select("session_id", "call_id", "tool", F.get_json_object("input", "$.path").alias("path"))
    results = blocks.filter("type = 'tool_result'").select("session_id", "msg_idx", "block_idx", "call_id", "result")
    paired = transcript.pair_calls(results, made, ["session_id", "call_id"])
    gauge = paired.select("session_id").distinct().select("session_id", F.lit(0.1).alias("utilisation"), F.lit(3600).alias("idle_seconds"))
    short = compress.compress(paired, gauge, "session_id", ["msg_idx", "block_idx"], value="result")
    return short.select("session_id", "msg_idx", "result")


@query(
    "compare_saved_runs",
    "SELECT event_type, status, count(*) AS steps FROM (SELECT event_type, CASE WHEN user_id < 10 THEN 'only_a' WHEN value > 100 THEN 'differs' ELSE 'same' END AS status FROM events) GROUP BY ALL",
)
def _(t: Tables):
    """Two versions of one log: users are missing and large values changed in the second."""
    a = t.events.select("event_id", "event_type", "value")
    b = t.events.filter("user_id >= 10").select("event_id", "event_type", F.when(F.col("value") > 100, -1.0).otherwise(F.col("value")).alias("value"))
    compared = logs.compare_runs(a, b, ["event_id"], ["event_type", "value"])
    return compared.join(t.events.select("event_id", "event_type"), "event_id").groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("steps"))
