"""Queries over messages, calls, results, usage and per-session state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talloom.functions import predicates
from talloom.operators import compress, logs, policy, transcript
from talloom.operators import usage as use
from talloom.operators.corpus import first_per_group
from talloom.operators.ordered import Ordered, running_count, running_sum
from talloom.plans.corpus_queries import parts_sql
from talloom.plans.registry import Tables, query
from talloom.plans.standins import calls, ctes, usage
from talloom.session import literal_rows

ORDER = ["ts", "seq"]

# -- calls and results ------------------------------------------------------------


@query(
    "pair_calls",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus AS tool, o_orderpriority AS path, l_returnflag AS result
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""",
)
def _(t: Tables):
    results = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("result"))
    made = t.orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("tool"), F.col("o_orderpriority").alias("path")
    )
    return transcript.pair_calls(results, made, ["l_orderkey"])


@query(
    "duplicate_calls",
    "SELECT l_orderkey, l_linenumber, count(*) AS calls FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t: Tables):
    return transcript.duplicate_calls(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "first_calls",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1""",
)
def _(t: Tables):
    calls_ = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    first = transcript.first_calls(calls_, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])
    return first.drop("l_shipdate")


@query(
    "orphans",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def _(t: Tables):
    results = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return transcript.orphans(t.orders.select("o_orderkey", "o_orderstatus"), results, ["o_orderkey"])


@query(
    "repair_orphans",
    """SELECT l_orderkey AS o_orderkey, l_linestatus AS result, FALSE AS synthetic FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT o_orderkey, 'not executed: limit', TRUE FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _(t: Tables):
    results = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("result"))
    return transcript.repair_orphans(t.orders, results, ["o_orderkey"], "not executed: limit")


@query(
    "drop_block_types",
    "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'",
)
def _(t: Tables):
    return transcript.drop_block_types(t.conversations.select("conv_id", "turn", "role"), ["system"], "role")


@query(
    "flatten_text",
    "SELECT conv_id, turn, replace(text, chr(10), '') AS text FROM conversations",
)
def _(t: Tables):
    # Each line of a turn is a text block, with a block of another type after it.
    blocks = F.flatten(F.transform(
        F.split("text", "\n", -1),
        lambda x: F.array(
            F.struct(F.lit("text").alias("type"), x.alias("text")), F.struct(F.lit("tool_use").alias("type"), x.alias("text"))
        ),
    ))
    return t.conversations.select("conv_id", "turn", transcript.flatten_text(blocks).alias("text"))


# -- whole sessions ---------------------------------------------------------------


@query("message_counts", "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id")
def _(t: Tables):
    return transcript.message_counts(t.conversations, "conv_id")


@query(
    "latest_session",
    "SELECT session, strftime(first, '%Y-%m-%d %H:%M:%S.%f') AS first FROM (SELECT user_id AS session, min(ts) AS first FROM events GROUP BY 1) ORDER BY first DESC, session DESC LIMIT 1",
)
def _(t: Tables):
    starts = transcript.session_catalog(t.events.select(F.col("user_id").alias("session"), "ts"), "session", "ts")
    return transcript.latest_session(starts, "first", "session").select("session", F.date_format("first", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first"))


@query("last_text", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(t: Tables):
    return transcript.last_text(t.conversations, "conv_id", "turn", "assistant")


@query(
    "render_transcript",
    parts_sql("SELECT conv_id, turn, role || ': ' || CASE WHEN role = 'system' THEN '[tool call / result]' ELSE text END AS x FROM conversations", "conv_id", "turn", "chr(10)", 1, 1500, "transcript"),
)
def _(t: Tables):
    messages = t.conversations.withColumn("text", F.when(F.col("role") != "system", F.col("text")))
    return transcript.render_transcript(messages, "conv_id", "turn", 1500).drop("items")


@query(
    "tool_sequence",
    ctes("calls") + parts_sql("SELECT session, seq, tool AS x FROM calls", "session", "seq", "','", 1, 400, "tools", ", count(*) AS items"),
)
def _(t: Tables):
    return transcript.tool_sequence(calls(t), ["session"], ["seq"], 400)


@query(
    "compare_sequences",
    ctes("calls") + """, g AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS place, tool FROM calls),
    e AS (SELECT session, place, CASE WHEN session % 3 = 0 AND place = 2 THEN 'other' ELSE tool END AS tool FROM g WHERE session % 3 <> 1 OR place > 1),
    b AS (SELECT session, place, g.tool IS DISTINCT FROM e.tool AS differs FROM g FULL JOIN e USING (session, place))
    SELECT session, min(CASE WHEN differs THEN place END) AS first_difference, NOT bool_or(differs) AS matches FROM b GROUP BY 1""",
)
def _(t: Tables):
    """Tools against a list in which every third session has another second tool, and every third lacks the first."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    expected = calls(t).select("session", place.alias("place"), "tool").filter("session % 3 <> 1 OR place > 1")
    other = F.when((F.col("session") % 3 == 0) & (F.col("place") == 2), "other").otherwise(F.col("tool"))
    return transcript.compare_sequences(calls(t), expected.withColumn("tool", other), "session", "seq")


@query(
    "compact",
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    h AS (SELECT conv_id, '[Previous conversation summary]' || chr(10) || count(*) || ' messages, ' || sum(length(text)) || ' characters' AS text FROM m WHERE n >= 4 AND rn < n GROUP BY 1)
    SELECT conv_id, CAST(-1 AS BIGINT) AS turn, 'user' AS role, text FROM h
    UNION ALL SELECT conv_id, turn, role, text FROM m WHERE n < 4 OR (rn = n AND role = 'user')""",
)
def _(t: Tables):
    return transcript.compact(t.conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query(
    "keep_recent",
    "SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 THEN '[Old result cleared]' ELSE text END AS text FROM conversations",
)
def _(t: Tables):
    rows = transcript.keep_recent(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], ["turn"], F.lit(True), 3)
    return rows.select("conv_id", "turn", F.when(F.col("old"), compress.CLEARED).otherwise(F.col("text")).alias("text"))


@query(
    "superseded_reads",
    ctes("calls") + """SELECT seq, session, path, tool = 'read_file' AND row_number() OVER (PARTITION BY session, path, tool = 'read_file' ORDER BY ts DESC, seq DESC) > 1 AS superseded FROM calls""",
)
def _(t: Tables):
    rows = transcript.superseded_reads(calls(t), ["session"], "path", ORDER, F.col("tool") == "read_file")
    return rows.select("seq", "session", "path", "superseded")


_BATCHES = ctes("calls", more="""b AS (SELECT *, tool IN ('read_file', 'grep_search') AS safe, lag(tool IN ('read_file', 'grep_search')) OVER w AS before FROM calls WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
  n AS (SELECT *, CAST(sum(CASE WHEN safe AND coalesce(before, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ts, seq) AS BIGINT) AS batch FROM b)""")


@query("parallel_batches", _BATCHES + "SELECT seq, session, safe, batch FROM n")
def _(t: Tables):
    rows = transcript.parallel_batches(calls(t), ["session"], ORDER, F.col("tool").isin(*predicates.PARALLEL_TOOLS))
    return rows.select("seq", "session", "safe", "batch")


_PRICES = {"view": (3, 15, 0.3, 3.75), "click": (1, 5, 0.1, 1.25), "purchase": (5, 25, 0.5, 6.25), "signup": (3, 15, 0.3, 3.75), "error": (2, 8, 0.2, 2.5)}


def _prices(t: Tables):
    names = [f"{c}_price" for c in use.TOKEN_CLASSES]
    rows = [{"model": m, **dict(zip(names, map(str, ps)))} for m, ps in _PRICES.items()]
    return literal_rows(t.spark, rows, "model string, " + ", ".join(f"{n} decimal(8,4)" for n in names))


_PRICE_ROWS = ", ".join(f"('{m}', {a}, {b}, {c}, {d})" for m, (a, b, c, d) in _PRICES.items())
_COST = f"""p(model, a, b, c, d) AS (SELECT model, CAST(a AS DECIMAL(8,4)), CAST(b AS DECIMAL(8,4)), CAST(c AS DECIMAL(8,4)), CAST(d AS DECIMAL(8,4)) FROM (VALUES {_PRICE_ROWS}) v(model, a, b, c, d)),
  priced AS (SELECT u.*, CAST(round((in_tok * a + out_tok * b + cache_read * c + cache_write * d) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DECIMAL(18,6)) AS cost FROM usage u LEFT JOIN p USING (model))"""


@query(
    "parallel_batches_cost",
    ctes("usage", more=_COST)
    + """, b AS (SELECT *, tool IN ('read_file', 'grep_search') AS safe, lag(tool IN ('read_file', 'grep_search')) OVER w AS before FROM calls WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
    n AS (SELECT session, sum(CASE WHEN safe AND coalesce(before, FALSE) THEN 0 ELSE 1 END) AS batches, count(*) AS calls FROM b GROUP BY 1)
    SELECT session, CAST(batches AS BIGINT) AS batches, calls, CAST(cost AS VARCHAR) AS cost FROM n JOIN (SELECT session, sum(cost) AS cost FROM priced GROUP BY 1) USING (session)""",
)
def _(t: Tables):
    batches = transcript.parallel_batches(
        calls(t).select("session", "seq", "ts", "tool"), ["session"], ORDER, F.col("tool").isin(*predicates.PARALLEL_TOOLS)
    )
    per_session = batches.groupBy("session").agg(F.max("batch").alias("batches"), F.count(F.lit(1)).alias("calls"))
    priced = use.cost(usage(t), _prices(t), "model").groupBy("session").agg(F.sum("cost").cast("decimal(28,6)").cast("string").alias("cost"))
    return per_session.join(priced, "session")


# -- usage ------------------------------------------------------------------------


@query(
    "usage_rollup",
    ctes("usage") + "SELECT session, model, CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write FROM usage GROUP BY ALL",
)
def _(t: Tables):
    return use.usage_rollup(usage(t), ["session", "model"])


@query(
    "usage_cube",
    ctes("usage") + "SELECT session, model, CAST(sum(in_tok) AS BIGINT) AS in_tok, CAST(sum(out_tok) AS BIGINT) AS out_tok, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write FROM usage GROUP BY CUBE (session, model)",
)
def _(t: Tables):
    return use.usage_rollup(usage(t), ["session", "model"], "cube")


@query("cost", ctes("usage", more=_COST) + "SELECT seq, model, CAST(cost AS VARCHAR) AS cost FROM priced")
def _(t: Tables):
    return use.cost(usage(t), _prices(t), "model").select("seq", "model", F.col("cost").cast("string").alias("cost"))


@query(
    "cache_hit_rate",
    ctes("usage") + """SELECT session, CAST(CASE WHEN sum(cache_read + in_tok + cache_write) = 0 THEN 0 ELSE (200 * sum(cache_read) + sum(cache_read + in_tok + cache_write)) // (2 * sum(cache_read + in_tok + cache_write)) END AS BIGINT) AS rate FROM usage GROUP BY session""",
)
def _(t: Tables):
    sums = use.usage_rollup(usage(t), ["session"])
    return sums.select("session", use.cache_hit_rate(F.col("cache_read"), F.col("in_tok"), F.col("cache_write")).alias("rate"))


@query(
    "split_cached",
    ctes("calls") + """SELECT seq, tokens - least(greatest(k * 100 - 1000, 0), tokens) AS in_tok, least(greatest(k * 100 - 1000, 0), tokens) AS cache_read FROM calls""",
)
def _(t: Tables):
    parts = use.split_cached(F.col("tokens"), F.col("k") * 100 - 1000)
    return calls(t).select("seq", parts["in_tok"].alias("in_tok"), parts["cache_read"].alias("cache_read"))


@query(
    "context_gauge",
    ctes("usage") + """SELECT session, c AS context_tokens, c / 19000 AS utilisation, c * 100 > 19000 * 85 AS full
    FROM (SELECT session, arg_max(in_tok + out_tok + cache_read + cache_write, seq) AS c FROM usage GROUP BY 1)""",
)
def _(t: Tables):
    return use.context_gauge(usage(t), "session", ORDER, 20000, 1000, 85)


@query(
    "budget_crossing",
    ctes("usage", more=_COST) + """, r AS (SELECT *, sum(cost) OVER w AS total, sum(CASE WHEN model <> 'view' THEN 1 ELSE 0 END) OVER w AS turns FROM priced WINDOW w AS (PARTITION BY session ORDER BY ts, seq))
    SELECT session, seq, CAST(total AS VARCHAR) AS total, CAST(turns AS BIGINT) AS turns, CASE WHEN total >= 0.4 THEN 'cost' ELSE 'turns' END AS reason FROM r
    WHERE model <> 'view' AND (total >= 0.4 OR turns >= 40) QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts, seq) = 1""",
)
def _(t: Tables):
    priced = use.cost(usage(t), _prices(t), "model")
    crossed = use.budget_crossing(
        priced, "session", ORDER, F.col("cost"), F.col("model") != "view", F.lit("0.4").cast("decimal(8,2)"), 40
    )
    return crossed.select("session", "seq", F.col("total").cast("decimal(28,6)").cast("string").alias("total"), "turns", "reason")


@query(
    "tree_rollup",
    """WITH RECURSIVE r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 7 END AS parent_id, o_custkey AS i, CAST(floor(o_totalprice) AS BIGINT) AS o FROM orders),
    c AS (SELECT run_id AS anc, parent_id, i, o FROM r UNION ALL SELECT r.run_id, r.parent_id, c.i, c.o FROM c JOIN r ON r.run_id = c.parent_id)
    SELECT anc AS run_id, CAST(sum(i) AS BIGINT) AS in_tok, CAST(sum(o) AS BIGINT) AS out_tok FROM c GROUP BY anc""",
)
def _(t: Tables):
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 7).cast("bigint")).alias("parent_id"),
        F.col("o_custkey").alias("in_tok"),
        F.floor("o_totalprice").cast("bigint").alias("out_tok"),
    )
    return use.tree_rollup(runs).drop("on_cycle")


_BROKEN = "CASE WHEN o_orderkey % 10 = 3 THEN -o_orderkey - 1 WHEN o_orderkey % 50 = 4 THEN o_orderkey + 1 WHEN o_orderkey % 50 = 5 THEN o_orderkey - 1 WHEN o_orderkey > 0 THEN CAST(floor(o_orderkey / 7) AS BIGINT) END"


@query(
    "tree_rollup_broken",
    f"""WITH RECURSIVE r AS (SELECT o_orderkey AS run_id, {_BROKEN} AS p, o_custkey AS i, CAST(floor(o_totalprice) AS BIGINT) AS o FROM orders),
    v AS (SELECT run_id, CASE WHEN p IN (SELECT run_id FROM r) THEN p END AS p, i, o FROM r),
    c(node, anc) AS (SELECT run_id, p FROM v WHERE p IS NOT NULL UNION SELECT c.node, v.p FROM c JOIN v ON v.run_id = c.anc WHERE v.p IS NOT NULL),
    loops AS (SELECT node FROM c WHERE node = anc), bad AS (SELECT node FROM c WHERE anc IN (SELECT node FROM loops) UNION SELECT node FROM loops),
    below AS (SELECT c.anc, sum(v.i) AS i, sum(v.o) AS o FROM c JOIN v ON v.run_id = c.node GROUP BY 1)
    SELECT v.run_id, CAST(v.i + CASE WHEN b.node IS NULL THEN coalesce(d.i, 0) ELSE 0 END AS BIGINT) AS in_tok,
      CAST(v.o + CASE WHEN b.node IS NULL THEN coalesce(d.o, 0) ELSE 0 END AS BIGINT) AS out_tok, b.node IS NOT NULL AS on_cycle
    FROM v LEFT JOIN bad b ON b.node = v.run_id LEFT JOIN below d ON d.anc = v.run_id""",
)
def _(t: Tables):
    """Parents that are no runs, and cycles of two."""
    return use.tree_rollup(t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.expr(_BROKEN).alias("parent_id"), F.col("o_custkey").alias("in_tok"),
        F.floor("o_totalprice").cast("bigint").alias("out_tok"),
    ))


# -- tiers ------------------------------------------------------------------------

# Gauge: utilisation and idle time per session, from its own calls.
_GAUGE = """g AS (SELECT session, count(*) / 70 AS utilisation, CAST(arg_max(k, seq) * 10 AS BIGINT) AS idle_seconds FROM calls GROUP BY session)"""
_RESULTS = """r AS (SELECT session, seq, ts, tool, path, repeat(command, CAST(k AS INTEGER)) AS text FROM calls)"""


def _gauge(t: Tables):
    return calls(t).groupBy("session").agg(
        (F.count(F.lit(1)) / 70).alias("utilisation"), (F.max_by("k", F.struct(*ORDER)) * 10).alias("idle_seconds")
    )


def _results(t: Tables):
    return calls(t).select("session", "seq", "ts", "tool", "path", F.expr("repeat(command, CAST(k AS INT))").alias("text"))


def _budget_sql(source: str, wide: int, tight: int) -> str:
    def cut(limit: int) -> str:
        keep = (limit - 80) // 2
        return (
            f"CASE WHEN length(text) > {limit} THEN left(text, {keep}) || chr(10) || chr(10) || '[... budgeted: ' || (length(text) - {2 * keep}) || "
            f"' chars truncated ...]' || chr(10) || chr(10) || right(text, {keep}) ELSE text END"
        )
    return f"""t1 AS (SELECT r.* REPLACE (CASE WHEN utilisation < 0.5 THEN text WHEN utilisation > 0.7 THEN {cut(tight)} ELSE {cut(wide)} END AS text), utilisation, idle_seconds FROM {source} r JOIN g USING (session))"""


_SNIP_SQL = """e AS (SELECT *, tool <> 'write_file' AND tool <> 'edit_file' AND text <> '[Content snipped - re-read if needed]' AS el FROM t1),
  s AS (SELECT *, sum(CASE WHEN el THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts DESC, seq DESC) AS back, sum(CASE WHEN el THEN 1 ELSE 0 END) OVER (PARTITION BY session) AS n,
    row_number() OVER (PARTITION BY session, path, el AND tool = 'read_file' ORDER BY ts DESC, seq DESC) AS again FROM e),
  t2 AS (SELECT * REPLACE (CASE WHEN utilisation >= 0.6 AND NOT (idle_seconds < 300 AND utilisation < 0.75) AND n > 3 AND el AND (back > 3 OR (tool = 'read_file' AND again > 1))
    THEN '[Content snipped - re-read if needed]' ELSE text END AS text) FROM s)"""
_CLEAR_SQL = """q AS (SELECT *, sum(CASE WHEN text NOT IN ('[Content snipped - re-read if needed]', '[Old result cleared]') THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts DESC, seq DESC) AS b2 FROM {src}),
  t3 AS (SELECT * REPLACE (CASE WHEN idle_seconds >= 300 AND b2 > 3 AND text NOT IN ('[Content snipped - re-read if needed]', '[Old result cleared]') THEN '[Old result cleared]' ELSE text END AS text) FROM q)"""
_PLAIN = "t1 AS (SELECT r.*, utilisation, idle_seconds FROM r JOIN g USING (session))"


@query("budget_tier", ctes("calls", more=f"{_GAUGE}, {_RESULTS}, {_budget_sql('r', 900, 400)}") + "SELECT session, seq, text FROM t1")
def _(t: Tables):
    return compress.budget_tier(_results(t), _gauge(t), "session", wide=900, tight=400).select("session", "seq", "text")


@query("snip_tier", ctes("calls", more=f"{_GAUGE}, {_RESULTS}, {_PLAIN}, {_SNIP_SQL}") + "SELECT session, seq, text FROM t2")
def _(t: Tables):
    return compress.snip_tier(_results(t), _gauge(t), "session", ORDER).select("session", "seq", "text")


@query("microcompact_tier", ctes("calls", more=f"{_GAUGE}, {_RESULTS}, {_PLAIN}, {_CLEAR_SQL.format(src='t1')}") + "SELECT session, seq, text FROM t3")
def _(t: Tables):
    return compress.microcompact_tier(_results(t), _gauge(t), "session", ORDER).select("session", "seq", "text")


@query(
    "compress",
    ctes("calls", more=f"{_GAUGE}, {_RESULTS}, {_budget_sql('r', 900, 400)}, {_SNIP_SQL}, {_CLEAR_SQL.format(src='t2')}") + "SELECT session, seq, text FROM t3",
)
def _(t: Tables):
    return compress.compress(_results(t), _gauge(t), "session", ORDER, wide=900, tight=400).select("session", "seq", "text")


# -- running state ----------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY session ORDER BY ts, seq)"


@query(
    "streaks",
    ctes("calls", more=f"""a AS (SELECT *, tool = 'run_shell' OR k > 60 AS denied FROM calls), b AS (SELECT *, sum(CASE WHEN denied THEN 0 ELSE 1 END) OVER w AS island, CAST(sum(CASE WHEN denied THEN 1 ELSE 0 END) OVER w AS BIGINT) AS total FROM a {_W}),
      c AS (SELECT *, CAST(sum(CASE WHEN denied THEN 1 ELSE 0 END) OVER (PARTITION BY session, island ORDER BY ts, seq) AS BIGINT) AS run FROM b)""")
    + "SELECT session, seq, total, CASE WHEN denied THEN run ELSE 0 END AS run, denied AND (run >= 4 OR total >= 30) AS limit_reached FROM c",
)
def _(t: Tables):
    rows = transcript.streaks(calls(t), ["session"], ORDER, (F.col("tool") == "run_shell") | (F.col("k") > 60), 4, 30)
    return rows.select("session", "seq", "total", "run", "limit_reached")


@query(
    "confirm_once",
    ctes("calls") + """SELECT session, seq, command, NOT coalesce(bool_or(k > 40) OVER (PARTITION BY session, command ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ask FROM calls""",
)
def _(t: Tables):
    rows = transcript.confirm_once(calls(t), ["session", "command"], ORDER, F.col("k") > 40)
    return rows.select("session", "seq", "command", "ask")


@query(
    "epochs",
    ctes("calls", more=f"""a AS (SELECT *, event_type = 'signup' AS c, event_type = 'error' AS z FROM calls), b AS (SELECT *, CAST(sum(CASE WHEN c OR z THEN 1 ELSE 0 END) OVER w AS BIGINT) AS epoch, sum(CASE WHEN z THEN 1 ELSE 0 END) OVER w AS bill FROM a {_W})""")
    + "SELECT session, seq, epoch, CAST(sum(CASE WHEN c OR z THEN 0 ELSE tokens END) OVER (PARTITION BY session, bill ORDER BY ts, seq) AS BIGINT) AS usage FROM b",
)
def _(t: Tables):
    rows = transcript.epochs(
        calls(t), ["session"], ORDER, F.col("event_type") == "signup", F.col("event_type") == "error", F.col("tokens")
    )
    return rows.select("session", "seq", "epoch", "usage")


@query(
    "first_user_flag",
    ctes("calls", more=f"e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS epoch FROM calls {_W})")
    + "SELECT session, seq, event_type = 'signup' AND row_number() OVER (PARTITION BY session, epoch, event_type = 'signup' ORDER BY ts, seq) = 1 AS gets_context FROM e",
)
def _(t: Tables):
    rows = transcript.first_user_flag(calls(t), ["session"], ORDER, F.col("event_type") == "signup", F.col("event_type") == "error")
    return rows.select("session", "seq", "gets_context")


@query(
    "mode_as_of",
    ctes("calls", more=f"""a AS (SELECT *, CASE event_type WHEN 'signup' THEN 'enter' WHEN 'error' THEN 'leave' END AS sw FROM calls),
      b AS (SELECT *, last_value(sw IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, last_value(sw IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS now FROM a),
      c AS (SELECT *, last_value(CASE WHEN sw = 'leave' AND prior = 'enter' AND k < 50 THEN 'acceptEdits' END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS base FROM b)""")
    + "SELECT session, seq, CASE WHEN now = 'enter' THEN 'plan' ELSE coalesce(base, 'default') END AS mode FROM c",
)
def _(t: Tables):
    rows = transcript.mode_as_of(
        calls(t), ["session"], ORDER, F.col("event_type") == "signup", F.col("event_type") == "error",
        F.when(F.col("k") < 50, "acceptEdits"), "default",
    )
    return rows.select("session", "seq", "mode")


def _versions(t: Tables):
    """Version of each path before each call: the number of writes so far by anyone."""
    wrote = F.when(F.col("tool") == "write_file", 1).otherwise(0).cast("bigint")
    rows = Ordered(calls(t), ["path"], ORDER).with_running(_n=running_sum(wrote, inclusive=False)).frame()
    return rows.withColumn("version", F.nullif("_n", F.lit(0))).drop("_n")


@query(
    "stale_writes",
    ctes("calls", more="""v AS (SELECT *, nullif(CAST(coalesce(sum(CASE WHEN tool = 'write_file' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT), 0) AS version FROM calls),
      s AS (SELECT *, last_value(CASE WHEN tool = 'read_file' THEN version WHEN tool = 'write_file' THEN coalesce(version, 0) + 1 END IGNORE NULLS) OVER (PARTITION BY session, path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v)""")
    + "SELECT session, seq, path, version, CASE WHEN version IS NULL THEN 'new' WHEN seen IS NULL THEN 'unread' WHEN seen <> version THEN 'changed' ELSE 'ok' END AS status FROM s WHERE tool = 'write_file'",
)
def _(t: Tables):
    seen = F.when(F.col("tool") == "read_file", F.col("version")).when(
        F.col("tool") == "write_file", F.coalesce("version", F.lit(0)) + 1
    )
    rows = transcript.stale_writes(_versions(t), "session", "path", ORDER, F.col("tool") == "write_file", "version", seen)
    return rows.select("session", "seq", "path", "version", "status")


# -- policy -----------------------------------------------------------------------

_RULES = [("allow", "run_shell(echo v*)"), ("deny", "run_shell(git push*)"), ("deny", "read_file(dir/f7)"), ("allow", "write_file(dir/f1*)"), ("deny", "edit_file(dir/f2*)"), ("allow", "edit_file"), ("deny", "grep_search(dir/f99)")]


def _rules(t: Tables):
    return policy.parse_rules(literal_rows(t.spark, [{"effect": e, "rule": r} for e, r in _RULES], "effect string, rule string"))


_VALUED = "SELECT seq, session, tool, CASE WHEN tool = 'run_shell' THEN CASE WHEN k <> 29 THEN command END WHEN k = 7 THEN '' WHEN k <> 13 THEN path END AS value, k FROM calls"
_RULED = f"""v AS ({_VALUED}), w AS (SELECT *, coalesce(value, '') AS given FROM v), u AS (SELECT *, CASE WHEN (tool = 'run_shell' AND starts_with(given, 'git push')) OR (tool = 'read_file' AND given IN ('', 'dir/f7')) OR (tool = 'edit_file' AND (given = '' OR starts_with(given, 'dir/f2'))) OR (tool = 'grep_search' AND given IN ('', 'dir/f99')) THEN 'deny'
  WHEN (tool = 'run_shell' AND starts_with(given, 'echo v')) OR (tool = 'write_file' AND (given = '' OR starts_with(given, 'dir/f1'))) OR tool = 'edit_file' THEN 'allow' END AS rule FROM w)"""


def _valued(t: Tables):
    return t.spark.sql(_VALUED.replace("FROM calls", "FROM {c}"), c=calls(t))


@query("match_rules", ctes("calls", more=_RULED) + "SELECT seq, tool, value, rule FROM u")
def _(t: Tables):
    return policy.match_rules(_valued(t), _rules(t)).select("seq", "tool", "value", "rule")


@query(
    "decide",
    ctes("calls", more=_RULED) + """, m(mode) AS (VALUES ('default'), ('plan'), ('acceptEdits'), ('bypassPermissions'), ('dontAsk')), x AS (SELECT DISTINCT path FROM calls WHERE tool = 'read_file' AND k < 60),
    d AS (SELECT u.*, mode, CASE WHEN tool = 'run_shell' AND regexp_matches(value, '\\b(sudo|git\\s+push)\\b') THEN value WHEN tool = 'write_file' AND (value IS NULL OR value NOT IN (SELECT path FROM x)) THEN 'write new file: ' || coalesce(value, 'undefined') WHEN tool = 'edit_file' AND (value IS NULL OR value NOT IN (SELECT path FROM x)) THEN 'edit non-existent file: ' || coalesce(value, 'undefined') END AS q FROM u, m),
    a AS (SELECT *, CASE WHEN rule = 'deny' THEN 'deny rule' WHEN mode = 'plan' AND tool IN ('write_file', 'edit_file') AND value = 'dir/f5' THEN 'allow' WHEN mode = 'plan' AND tool IN ('write_file', 'edit_file') THEN 'deny plan' WHEN mode = 'plan' AND tool = 'run_shell' THEN 'deny shell'
      WHEN mode = 'bypassPermissions' OR rule = 'allow' OR tool IN ('read_file', 'grep_search') THEN 'allow' WHEN mode = 'acceptEdits' AND tool IN ('write_file', 'edit_file') THEN 'allow' WHEN q IS NULL THEN 'allow' WHEN mode = 'dontAsk' THEN 'deny auto' ELSE 'confirm' END AS how FROM d)
    SELECT seq, mode, split_part(how, ' ', 1) AS action, CASE how WHEN 'deny rule' THEN 'Denied by permission rule for ' || tool WHEN 'deny plan' THEN 'Blocked in plan mode: ' || tool WHEN 'deny shell' THEN 'Shell commands blocked in plan mode'
      WHEN 'deny auto' THEN 'Auto-denied (dontAsk mode): ' || q WHEN 'confirm' THEN q END AS message FROM a""",
)
def _(t: Tables):
    modes = F.array(*[F.lit(m) for m in ("default", "plan", "acceptEdits", "bypassPermissions", "dontAsk")])
    rows = _valued(t).withColumn("mode", F.explode(modes))
    existing = calls(t).filter("tool = 'read_file' AND k < 60").select("path")
    decided = policy.decide(rows, _rules(t), existing, plan_file="dir/f5")
    return decided.select("seq", "mode", F.col("decision.action").alias("action"), F.col("decision.message").alias("message"))


@query(
    "match_patterns",
    ctes("calls") + """SELECT seq, CASE WHEN starts_with(command, 'git') THEN 'git' WHEN starts_with(command, 'sudo') THEN 'rm,sudo' ELSE '' END AS patterns, NOT starts_with(command, 'echo') AS dangerous FROM calls""",
)
def _(t: Tables):
    col = F.col("command")
    return calls(t).select(
        "seq", F.array_join(predicates.matching_patterns(col), ",").alias("patterns"), predicates.matches_any(col).alias("dangerous")
    )


@query(
    "match_patterns_text",
    """SELECT conv_id, turn, regexp_matches(text, '[0-9]{3}') AS digits, regexp_matches(text, '(?i)\\bthe\\b') AS the FROM conversations""",
)
def _(t: Tables):
    found = predicates.matching_patterns(F.col("text"), {"digits": "[0-9]{3}", "the": r"(?i)\bthe\b"})
    rows = t.conversations.select("conv_id", "turn", found.alias("f"))
    return rows.select("conv_id", "turn", F.array_contains("f", "digits").alias("digits"), F.array_contains("f", "the").alias("the"))


@query(
    "is_retryable",
    ctes("calls") + "SELECT seq, k = 29 OR event_type = 'signup' OR (event_type = 'error' AND k < 20) AS retryable FROM calls",
)
def _(t: Tables):
    code = F.expr("CASE WHEN event_type = 'signup' THEN 'ECONNRESET' WHEN event_type = 'view' THEN 'EPIPE' END")
    message = F.expr("CASE WHEN event_type = 'error' AND k < 20 THEN concat('server overloaded ', k) WHEN event_type = 'click' THEN 'bad' END")
    return calls(t).select("seq", predicates.is_retryable(400 + F.col("k"), code, message).alias("retryable"))


@query(
    "route",
    """WITH r AS (SELECT conv_id, turn, role, text FROM conversations), h AS (SELECT *, contains(text, 'the') AS a, contains(text, 'and') AND role = 'assistant' AS b FROM r)
    SELECT conv_id, turn, CASE WHEN a AND b THEN 'ambiguous' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'main' END AS track FROM h""",
)
def _(t: Tables):
    requests = t.conversations.select(
        "conv_id", "turn", F.col("text").alias("system"), F.col("text").alias("first_user"), F.array("role").alias("tools")
    )
    tracks = [{"name": "first", "match": "the"}, {"name": "second", "match": "and", "first_user": "and", "tools": ["assistant"]}]
    return policy.route(requests, tracks).select("conv_id", "turn", "track")


# -- logs -------------------------------------------------------------------------


@query(
    "lookup_default",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 200000 WHEN 'MACHINERY' THEN 128000 ELSE 64000 END AS room FROM customer",
)
def _(t: Tables):
    dim = literal_rows(
        t.spark, [{"c_mktsegment": "BUILDING", "room": 200000}, {"c_mktsegment": "MACHINERY", "room": 128000}], "c_mktsegment string, room int"
    )
    return logs.lookup_default(t.customer.select("c_custkey", "c_mktsegment"), dim, "c_mktsegment", "room", 64000).select("c_custkey", "room")


@query(
    "correlate_rpc",
    """SELECT o_orderkey, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag IS NULL THEN 'timeout' WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY""",
)
def _(t: Tables):
    requests = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate")
    responses = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_shipdate", "l_returnflag", "l_partkey", "l_suppkey", "l_quantity")
    within = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    paired = logs.correlate(requests, responses, ["id"], within, F.col("l_returnflag") == "R")
    return paired.select(F.col("id").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_quantity", "status")


@query(
    "correlate_rpc_exits",
    """WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN l_returnflag IS NULL THEN 'timeout' WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY),
    x AS (SELECT o_custkey, o_orderdate AS exited FROM orders WHERE o_orderkey % 5 = 0),
    f AS (SELECT o_orderkey, min(exited) AS exit_at FROM p JOIN x USING (o_custkey) WHERE status = 'timeout' AND exited >= o_orderdate GROUP BY 1)
    SELECT o_orderkey, CASE WHEN status = 'timeout' AND exit_at IS NOT NULL THEN 'server exited' ELSE status END AS status, exit_at FROM p LEFT JOIN f USING (o_orderkey)""",
)
def _(t: Tables):
    """Customers as servers that exit at every order whose key is a multiple of five."""
    requests = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    responses = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), "l_shipdate", "l_returnflag")
    exits = t.orders.filter("o_orderkey % 5 = 0").select("o_custkey", F.col("o_orderdate").alias("exited"))
    within = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    paired = logs.correlate_with_exits(
        requests, responses, exits, ["id"], "o_custkey", "o_orderdate", "exited", within, F.col("l_returnflag") == "R"
    )
    return paired.select(F.col("id").alias("o_orderkey"), "status", "exit_at")


@query(
    "absent_report",
    "SELECT DISTINCT o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS exists FROM orders",
)
def _(t: Tables):
    """Names that must not be there: customers of orders, against those with money."""
    present = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return logs.absent_report(present, t.orders.select("o_custkey"), "o_custkey")


@query(
    "compare_runs",
    ctes("calls") + """, a AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS step, tool, path FROM calls),
    b AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS step, tool, path FROM calls WHERE tokens > 100)
    SELECT session, step, CASE WHEN b.tool IS NULL THEN 'only_a' WHEN a.tool IS NULL THEN 'only_b' WHEN a.tool = b.tool AND a.path = b.path THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b USING (session, step)""",
)
def _(t: Tables):
    def steps(rows):
        return Ordered(rows, ["session"], ORDER).with_running(step=running_count()).frame()

    return logs.compare_runs(steps(calls(t)), steps(calls(t).filter("tokens > 100")), ["session", "step"], ["tool", "path"])


@query("category_counts", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def _(t: Tables):
    return logs.category_counts(t.events, "event_type")


@query(
    "expectation_report",
    """WITH e(event_type, expected) AS (VALUES ('view', CAST(1 AS BIGINT)), ('click', CAST(1000000000000 AS BIGINT)), ('never', CAST(0 AS BIGINT)), ('absent', CAST(3 AS BIGINT)))
    SELECT event_type, expected, coalesce(n, 0) AS events, CASE WHEN expected IS NULL THEN 'unexpected' WHEN coalesce(n, 0) > expected THEN 'exhausted' WHEN coalesce(n, 0) < expected THEN 'short' ELSE 'met' END AS status
    FROM e FULL JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)""",
)
def _(t: Tables):
    rows = [("view", 1), ("click", 1000000000000), ("never", 0), ("absent", 3)]
    expected = literal_rows(
        t.spark, [{"event_type": e, "expected": n} for e, n in rows], "event_type string, expected bigint"
    )
    return logs.expectation_report(logs.category_counts(t.events, "event_type"), expected, "event_type")


@query(
    "track_report",
    ctes("calls") + """, l AS (SELECT CASE WHEN session % 3 = 0 THEN 'main' ELSE 'side' || session % 3 END AS track, tool AS item, command AS text, path FROM calls),
    c(track, item, expected) AS (SELECT 'main', 'read_file', count(*) FROM l WHERE track = 'main' AND item = 'read_file' UNION ALL VALUES ('side1', 'read_file', 3), ('side9', 'edit_file', 1)),
    n(track, needle) AS (VALUES ('main', 'sudo'), ('side1', 'no such text'), ('side9', 'x')),
    f(track, path) AS (VALUES ('main', 'dir/f5'), ('side2', 'dir/none'))
    SELECT track, 'count' AS test, item, CAST(coalesce(expected, 0) AS BIGINT) AS expected, coalesce(n, 0) AS found, coalesce(expected, 0) = coalesce(n, 0) AS met FROM c FULL JOIN (SELECT track, item, count(*) AS n FROM l GROUP BY ALL) USING (track, item)
    UNION ALL SELECT track, 'text', needle, 1, x, x = 1 FROM (SELECT n.track, needle, CAST(coalesce(bool_or(contains(text, needle)), FALSE) AS BIGINT) AS x FROM n LEFT JOIN l ON l.track = n.track GROUP BY ALL)
    UNION ALL SELECT track, 'absent', path, 0, x, x = 0 FROM (SELECT track, path, CAST(path IN (SELECT path FROM l) AS BIGINT) AS x FROM f)""",
)
def _(t: Tables):
    """Three tracks against counts of their calls, texts they must have used, and paths that must not be there."""
    third = F.col("session") % 3
    track = F.when(third == 0, "main").otherwise(F.concat(F.lit("side"), third))
    log = calls(t).select(track.alias("track"), F.col("tool").alias("item"), F.col("command").alias("text"), "path")
    met = log.where("track = 'main' AND item = 'read_file'").groupBy("track", "item").agg(F.count(F.lit(1)).alias("expected"))
    table = lambda schema, *rows: literal_rows(t.spark, [dict(zip([c.split()[0] for c in schema.split(", ")], r)) for r in rows], schema)
    counts = met.unionByName(table("track string, item string, expected bigint", ("side1", "read_file", 3), ("side9", "edit_file", 1)))
    texts = table("track string, needle string", ("main", "sudo"), ("side1", "no such text"), ("side9", "x"))
    forbidden = table("track string, path string", ("main", "dir/f5"), ("side2", "dir/none"))
    return logs.track_report(log, counts, texts, log.select("path"), forbidden)


@query(
    "missing_substrings",
    """SELECT needle, (SELECT bool_or(contains(text, needle)) FROM conversations) AS found FROM (VALUES ('the'), ('no such words here'), ('que')) v(needle)""",
)
def _(t: Tables):
    return logs.missing_substrings(t.conversations, ["the", "no such words here", "que"])


_RETRY_SQL = ctes("calls", more="""a AS (SELECT session, seq, ts, event_type IN ('error', 'signup', 'purchase') AS bad, event_type IN ('error', 'signup', 'purchase') AND k < 90 AS again FROM calls),
  b AS (SELECT *, CASE WHEN coalesce(lag(again) OVER (PARTITION BY session ORDER BY ts, seq), FALSE) THEN 0 ELSE 1 END AS starts FROM a),
  c AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY session ORDER BY ts, seq) AS BIGINT) AS chain FROM b),
  d AS (SELECT *, (row_number() OVER (PARTITION BY session, chain ORDER BY ts, seq) - 1) // 4 AS block FROM c)""")


@query(
    "retry_chains",
    _RETRY_SQL + """SELECT session, chain, block, count(*) AS attempts, CASE WHEN arg_max(again, seq) AND count(*) > 3 THEN 'exhausted' WHEN arg_max(again, seq) THEN 'open' WHEN arg_max(bad, seq) THEN 'fatal' WHEN count(*) > 1 THEN 'recovered' ELSE 'ok' END AS outcome FROM d GROUP BY session, chain, block""",
)
def _(t: Tables):
    bad = F.col("event_type").isin("error", "signup", "purchase")
    return logs.retry_chains(calls(t), ["session"], ORDER, bad, F.col("k") < 90)


@query(
    "late_results",
    ctes("calls") + """SELECT r.session, r.seq, min(t.seq) AS turn FROM (SELECT *, ts + to_microseconds(k * 60000000) AS arrival FROM calls WHERE tool <> 'read_file') r
    LEFT JOIN (SELECT * FROM calls WHERE tool = 'read_file') t ON t.session = r.session AND t.ts >= r.arrival GROUP BY r.session, r.seq""",
)
def _(t: Tables):
    rows = calls(t).select("session", F.col("ts").cast("timestamp").alias("at"), "seq", "tool", "k")
    arrivals = rows.filter("tool <> 'read_file'").withColumn("at", F.timestamp_micros(F.unix_micros("at") + F.col("k") * 60000000))
    return logs.late_results(arrivals, rows.filter("tool = 'read_file'"), "session", "at", "seq").select("session", "seq", "turn")


@query(
    "idle_sessions",
    ctes("calls") + """, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 36000000000 THEN 0 ELSE 1 END AS starts FROM calls WINDOW w AS (PARTITION BY session ORDER BY ts, seq))
    SELECT session, seq, CAST(sum(starts) OVER (PARTITION BY session ORDER BY ts, seq) AS BIGINT) AS visit FROM g""",
)
def _(t: Tables):
    return logs.idle_gaps(calls(t), ["session"], ORDER, F.col("ts"), 36000).select("session", "seq", "visit")


@query(
    "largest_calls",
    ctes("calls") + "SELECT session, seq, CAST(row_number() OVER (PARTITION BY session ORDER BY tokens DESC, seq) AS INTEGER) AS rank FROM calls QUALIFY row_number() OVER (PARTITION BY session ORDER BY tokens DESC, seq) <= 3",
)
def _(t: Tables):
    return first_per_group(calls(t), ["session"], [F.desc("tokens"), F.asc("seq")], 3).select("session", "seq", "rank")
