"""Streaming queries and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from talloom.plans.registry import ORACLES, Tables, query
from talloom.plans.standins import ctes
from talloom.session import freed_shuffles, hand_over, input_bytes, literal_rows, reliable, remove, scratch_path, small_side
from talloom.streaming import deltas, live, replies
from talloom.streaming.reorder import done, late
from talloom.streaming.run import end_input, run_available, run_to_end, table_stream, use_rocksdb, waiting_rows, with_end

# -- replies in fragments -------------------------------------------------------------

# Each document is one reply: a text block, a call whose input is cut every five
# characters, and a thinking block. Spanish documents send input that does not parse.
_PIECES = "transform(sequence(0, CAST(greatest(ceil(length({x}) / {n}) - 1, 0) AS INT)), i -> substr({x}, i * {n} + 1, {n}))"
_ARGS = """concat('{"path":"', source, '","n":', n_chars, CASE WHEN lang = 'es' THEN '' ELSE '}' END)"""
_BLOCK_ARRAY = f"""concat(
  array('event: message_start', 'data: {{"type":"message_start"}}',
    'data: {{"type":"content_block_start","index":0,"content_block":{{"type":"text"}}}}'),
  transform({_PIECES.format(x='text', n=300)}, p -> concat('data: ', to_json(named_struct('type', 'content_block_delta', 'index', 0, 'delta', named_struct('type', 'text_delta', 'text', p))))),
  array('data: {{"type":"content_block_stop","index":0}}',
    concat('data: ', to_json(named_struct('type', 'content_block_start', 'index', 1, 'content_block', named_struct('type', 'tool_use', 'id', concat('call', doc_id), 'name', CASE WHEN lang = 'de' THEN 'write_file' ELSE 'read_file' END))))),
  transform({_PIECES.format(x='args', n=5)}, p -> concat('data: ', to_json(named_struct('type', 'content_block_delta', 'index', 1, 'delta', named_struct('type', 'input_json_delta', 'partial_json', p))))),
  array('data: {{"type":"content_block_stop","index":1}}', 'data: {{"type":"content_block_start","index":2,"content_block":{{"type":"thinking"}}}}',
    'data: {{"type":"content_block_delta","index":2,"delta":{{"type":"thinking_delta","thinking":"hm"}}}}', 'data: {{"type":"content_block_stop","index":2}}', 'event: message_stop', 'data: {{"type":"message_stop"}}')
)"""
_BLOCK_LINES = f"posexplode({_BLOCK_ARRAY}) AS (seq, line)"

_TEXT_BLOCKS = "SELECT 'd' || doc_id AS stream_id, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS part, 'text' AS type, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool, text, CAST(NULL AS VARCHAR) AS input FROM documents"
_CALL_BLOCKS = """SELECT 'd' || doc_id AS stream_id, CAST(1 AS BIGINT) AS block, CAST(0 AS BIGINT) AS part, 'tool_use' AS type, 'call' || doc_id AS call_id, CASE WHEN lang = 'de' THEN 'write_file' ELSE 'read_file' END AS tool, NULL AS text,
 CASE WHEN lang = 'es' THEN '{}' ELSE '{"n":' || n_chars || ',"path":"' || source || '"}' END AS input FROM documents"""


_CUT = "2024-01-01 20:05:00"
# The closing row of a stream must look like an event up to where the watermark is.
_END_LINE = 'data: {"type":"end","index":0}'


def _stamped(rows):
    """Replies start hours apart; their lines arrive every two seconds."""
    hour = F.pmod(F.xxhash64("stream_id"), F.lit(40))
    arrived = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + 3600 * hour + 2 * F.col("seq"))
    return rows.select("stream_id", arrived.alias("arrived"), F.col("seq").cast("bigint").alias("seq"), "line")


def _block_rows(t: Tables):
    rows = t.documents.withColumn("args", F.expr(_ARGS)).selectExpr("concat('d', doc_id) AS stream_id", _BLOCK_LINES)
    return _stamped(rows)


#: Bytes of the read tables for one written file; lines take two to three times that, and a compressed file is one task's.
_FILE_BYTES = 16 << 20
#: Files of a micro-batch: all that are there, as the watermark moves between two. Files are dealt by hash, so lines that
#: belong together would come before and after it, and replies be given up in between.
_ALL_FILES = (1 << 31) - 1


def _files(rows, least: int) -> int:
    """How many files rows are written to: more for larger tables, so that no task writes or reads one of any size."""
    return max(least, (input_bytes(rows) or 0) // _FILE_BYTES + 1)


def _dealt(rows, files: int):
    return rows.repartition(files, "stream_id", "seq")


def _folder(rows, name: str) -> str:
    """Rows as JSON lines."""
    path = scratch_path(rows.sparkSession, name)
    _dealt(rows, _files(rows, 4)).write.json(path)
    return path


def _streamed(t: Tables, rows, make, name: str, each=None):
    """Runs `make` over the lines that arrive before an instant, then over the rest, and closes the stream."""
    made, path, state = (scratch_path(t.spark, f"{name}{x}") for x in ("-made", "", "-state"))
    step = F.when(F.col("arrived") < F.lit(_CUT).cast("timestamp"), "early").otherwise("rest")
    with freed_shuffles(t.spark):
        dealt = _dealt(rows.where("arrived IS NOT NULL"), _files(rows, 4)).withColumn("step", step)
        dealt.write.partitionBy("step").option("compression", "snappy").json(made)
    hand_over(t.spark, f"{made}/step=early", f"{path}/early")

    def rest():
        remove(t.spark, f"{path}/early")
        hand_over(t.spark, f"{made}/step=rest", f"{path}/rest")

    lines, end = with_end(deltas.read_lines(use_rocksdb(t.spark), f"{path}/*", files_per_batch=_ALL_FILES), name)
    close = lambda: end_input(t.spark, end, "arrived", line=_END_LINE)
    found = run_available(make(deltas.data_lines(lines)), name, state=state, each=each, more=[rest, close])
    for folder in (made, path, state):
        remove(t.spark, folder)
    return found


@query("assemble_blocks", f"{_TEXT_BLOCKS} UNION ALL {_CALL_BLOCKS}")
def _(t: Tables):
    raw = t.spark.read.schema(deltas.DELTA_SCHEMA).json(_folder(_block_rows(t), "blocks"))
    return deltas.assemble_blocks(deltas.block_events(deltas.data_lines(raw)))


@query("assemble_blocks_stream", f"{_TEXT_BLOCKS} UNION ALL {_CALL_BLOCKS}")
def _(t: Tables):
    return _streamed(t, _block_rows(t), lambda lines: deltas.assemble_blocks_stream(deltas.block_events(lines)), "assemble")


def _damaged(t: Tables):
    """Replies of which some lose their fifth line, some come twice."""
    rows = _block_rows(t).withColumn("n", F.substr("stream_id", F.lit(2)).cast("bigint"))
    kept = rows.where("NOT (n % 7 = 3 AND seq = 4)")
    return kept.unionByName(kept.where("n % 7 = 1")).drop("n")


_LOST = "doc_id % 7 = 3"


@query(
    "lost_replies",
    f"""SELECT 'd' || doc_id AS stream_id, CAST(0 AS BIGINT) AS block, 'text' AS type, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || substr(text, 601) ELSE text END AS text,
    CASE WHEN length(text) > 300 THEN CAST(1 AS BIGINT) END AS missing FROM documents WHERE {_LOST}""",
)
def _(t: Tables):
    """Blocks that lost a line, with what came of them, once their reply has fallen silent."""
    found = _streamed(t, _damaged(t), lambda lines: deltas.complete_blocks_stream(deltas.block_events(lines)), "lost")
    return deltas.lost_blocks(found).select("stream_id", "block", "type", "text", "missing")


@query("kept_replies", f"SELECT stream_id, block, text, input FROM ({_TEXT_BLOCKS} WHERE NOT {_LOST} UNION ALL {_CALL_BLOCKS})")
def _(t: Tables):
    """The blocks beside them: whole ones, each once, however often its lines came."""
    found = _streamed(t, _damaged(t), lambda lines: deltas.assemble_blocks_stream(deltas.block_events(lines)), "kept")
    return found.select("stream_id", "block", "text", "input")


@query(
    "early_complete_stream",
    f"SELECT stream_id, block, call_id, tool, input FROM ({_CALL_BLOCKS}) WHERE tool = 'read_file'",
)
def _(t: Tables):
    return _streamed(t, _block_rows(t), lambda lines: deltas.early_complete(deltas.block_events(lines)), "early").drop("stop_seq")


@query(
    "early_permitted_stream",
    f"SELECT stream_id, block, call_id, tool, input FROM ({_CALL_BLOCKS}), documents WHERE tool = 'read_file' AND 'd' || doc_id = stream_id AND doc_id % 3 <> 0 AND source <> 'src0'",
)
def _(t: Tables):
    """Early calls that the rules let start: reading is refused for one source by a prefix rule, and for some files by name."""
    denied = t.documents.where("doc_id % 3 = 0").select(F.lit("deny").alias("effect"), F.lit("read_file").alias("tool"), F.concat("source", F.lit("/"), "doc_id").alias("pattern"))
    rules = denied.unionByName(literal_rows(t.spark, [{"effect": "deny", "tool": "read_file", "pattern": "src0/*"}], "effect string, tool string, pattern string"))
    none = t.documents.select(F.col("source").alias("path")).limit(0)
    paths = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("stream_id"), F.concat("source", F.lit("/"), "doc_id").alias("_path"))

    def judged(calls):
        # the stand-in names the source only; each call gets the path of its document
        named = calls.join(paths, "stream_id").withColumn("input", F.to_json(F.struct(F.col("_path").alias("file_path")))).drop("_path")
        return calls.join(deltas.permitted(named, rules, none).select("stream_id", "block"), ["stream_id", "block"], "left_semi")

    found = _streamed(t, _block_rows(t), lambda lines: deltas.early_complete(deltas.block_events(lines)), "permitted", judged)
    return found.drop("stop_seq")


def _captured(t: Tables):
    """Whole replies as bytes. Documents of one id are one reply; only these are brought together."""
    docs = t.documents.withColumn("args", F.expr(_ARGS)).withColumn("stream_id", F.concat(F.lit("d"), "doc_id"))
    shared = reliable(docs.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("stream_id").alias("_id")), "shared")
    lines = docs.selectExpr("stream_id", f"{_BLOCK_ARRAY} AS l")
    if not shared.isEmpty():
        same = F.col("stream_id").eqNullSafe(F.col("_id"))
        rows = docs.join(small_side(shared), same, "left_semi").selectExpr("stream_id", _BLOCK_LINES)
        together = rows.groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("l"))
        lines = docs.join(small_side(shared), same, "left_anti").selectExpr("stream_id", f"{_BLOCK_ARRAY} AS l").unionByName(together)
    ends = F.array_join(F.transform("l", lambda x: F.concat(x, F.when(F.startswith(x, F.lit("event:")), "\r\n").otherwise("\n\n"))), "")
    return lines.select("stream_id", F.encode(ends, "utf-8").alias("all"))


#: Micro-batches over which the pieces of captured replies are dealt.
_PORTIONS = 3


@query("captured_replies", f"{_TEXT_BLOCKS} UNION ALL {_CALL_BLOCKS}")
def _(t: Tables):
    """Replies as raw bytes, cut anywhere and out of order: framed, then put together."""
    spark = use_rocksdb(t.spark)
    whole, path, state, out, last = (scratch_path(spark, n) for n in ("whole", "raw", "frame-state", "framed", "captured-state"))
    texts = _captured(t)
    files = _files(texts, 2)
    with freed_shuffles(spark):
        texts.write.option("compression", "zstd").parquet(whole)
    size = (37 + F.pmod(F.xxhash64("stream_id"), F.lit(200))).cast("int")
    raw = spark.read.schema(texts.schema).parquet(whole).withColumn("size", size)
    ks = F.sequence(F.lit(0), F.floor((F.octet_length("all") - 1) / F.col("size")).cast("int"))

    def pieces(portion: int):
        own = F.filter(ks, lambda k: F.pmod(F.xxhash64("stream_id", k), F.lit(_PORTIONS)) == portion)
        # cut inside the array, so that no piece carries the whole reply
        cut = F.inline(F.transform(own, lambda k: F.struct(k.alias("k"), F.substr("all", k * F.col("size") + 1, F.col("size")).alias("bytes"))))
        arrived = F.timestamp_seconds(F.unix_timestamp(F.lit(_CUT).cast("timestamp")) + F.pmod("k", F.lit(3000)))
        return raw.select("stream_id", cut).select("stream_id", arrived.alias("arrived"), F.col("k").cast("bigint").alias("piece"), "bytes")

    for portion in range(_PORTIONS):
        with freed_shuffles(spark):
            pieces(portion).repartition(files, "stream_id", "piece").write.mode("append").option("compression", "zstd").parquet(path)
    remove(spark, whole)
    written = len(spark.read.schema(pieces(0).schema).parquet(path).inputFiles())
    # files that a micro-batch has read go
    source = spark.readStream.schema(pieces(0).schema).option("maxFilesPerTrigger", max(1, -(-written // _PORTIONS))).option("cleanSource", "delete")
    events = lambda p: replies.framed(p, "1 hour").where("kind = 'event'").drop("kind")
    run_to_end(source.parquet(path), events, "frame", state, at="arrived", out=out)
    for folder in (path, state):
        remove(spark, folder)
    framed = spark.readStream.schema("stream_id string, arrived timestamp, seq bigint, payload string").parquet(out)
    found = run_to_end(framed, lambda e: deltas.assemble_blocks_stream(deltas.block_events(e), "1 hour"), "captured", last, at="arrived")
    for folder in (out, last):
        remove(spark, folder)
    return found


# Each turn of a conversation is one reply in the chunk shape with two calls.
_CHUNK_LINES = f"""posexplode(concat(
  array('data: {{"choices":[{{"delta":{{"role":"assistant"}}}}]}}'),
  transform({_PIECES.format(x='text', n=50)}, p -> concat('data: ', to_json(named_struct('choices', array(named_struct('delta', named_struct('content', p))))))),
  array(concat('data: ', to_json(named_struct('choices', array(named_struct('delta', named_struct('tool_calls', array(named_struct('index', 0, 'id', concat('a', turn), 'function', named_struct('name', 'read_file', 'arguments', '')), named_struct('index', 1, 'id', 'b', 'function', named_struct('name', role, 'arguments', '{{bad'))))))))),
    concat('data: ', to_json(named_struct('choices', array(named_struct('delta', named_struct('tool_calls', array(named_struct('index', 0, 'function', named_struct('arguments', concat('{{"c":', conv_id)))))))))),
    'data: {{"choices":[{{"delta":{{"tool_calls":[{{"index":0,"function":{{"arguments":"}}"}}}}]}}}}]}}',
    CASE WHEN role = 'user' THEN 'data: {{"choices":[{{"delta":{{}},"finish_reason":"tool_calls"}}]}}' ELSE 'data: {{"choices":[]}}' END,
    concat('data: ', to_json(named_struct('choices', array(), 'usage', named_struct('prompt_tokens', length(text), 'completion_tokens', turn)))),
    'data: [DONE]')
)) AS (seq, line)"""


def _chunk_rows(t: Tables):
    return _stamped(t.conversations.selectExpr("concat(conv_id, '-', turn) AS stream_id", _CHUNK_LINES))


_REPLIES = """SELECT conv_id || '-' || turn AS stream_id, text, CASE WHEN role = 'user' THEN 'tool_calls' ELSE 'stop' END AS finish, CAST(length(text) AS BIGINT) AS prompt_tokens, turn AS completion_tokens FROM conversations"""
_REPLY_CALLS = """SELECT conv_id || '-' || turn AS stream_id, CAST(0 AS BIGINT) AS index, 'a' || turn AS id, 'read_file' AS tool, '{"c":' || conv_id || '}' AS input FROM conversations
 UNION ALL SELECT conv_id || '-' || turn, 1, 'b', role, '{}' FROM conversations"""
# Turn 2 loses its first line of text, turn 3 the end; turn 1 comes twice.
_DAMAGED_REPLIES = """SELECT conv_id || '-' || turn AS stream_id, CAST(0 AS BIGINT) AS part, CASE WHEN turn = 2 THEN substr(text, 51) ELSE text END AS text, CASE WHEN role = 'user' THEN 'tool_calls' ELSE 'stop' END AS finish,
  CAST(length(text) AS BIGINT) AS prompt_tokens, turn AS completion_tokens, CAST(CASE turn WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS BIGINT) AS missing FROM conversations"""


def _damaged_chunks(t: Tables):
    rows = _chunk_rows(t).withColumn("turn", F.substring_index("stream_id", "-", -1))
    kept = rows.where("NOT (turn = '2' AND seq = 1) AND NOT (turn = '3' AND line = 'data: [DONE]')")
    return kept.unionByName(kept.where("turn = '1'")).drop("turn")


@query("assemble_chunks_messages", _DAMAGED_REPLIES)
def _(t: Tables):
    raw = t.spark.read.schema(deltas.DELTA_SCHEMA).json(_folder(_damaged_chunks(t), "chunks"))
    messages, _ = deltas.assemble_chunks(deltas.chunk_events(deltas.data_lines(raw)))
    return messages


@query("assemble_chunks_calls", _REPLY_CALLS)
def _(t: Tables):
    raw = t.spark.read.schema(deltas.DELTA_SCHEMA).json(_folder(_chunk_rows(t), "chunks"))
    _, made = deltas.assemble_chunks(deltas.chunk_events(deltas.data_lines(raw)))
    return made.drop("part")


def _chunks_streamed(t: Tables, rows, name: str):
    return _streamed(t, rows, lambda lines: deltas.assemble_chunks_stream(deltas.chunk_events(lines)), name)


@query("assemble_chunks_calls_stream", _REPLY_CALLS)
def _(t: Tables):
    return _chunks_streamed(t, _chunk_rows(t), "chunk-calls").select("stream_id", F.inline("calls"))


@query("assemble_chunks_stream", _REPLIES)
def _(t: Tables):
    return _chunks_streamed(t, _chunk_rows(t), "chunks").drop("calls", "kind", "missing")


@query("assemble_chunks_damaged_stream", _DAMAGED_REPLIES)
def _(t: Tables):
    """The damaged replies of the batch form, in the stream form: the same rows."""
    return _chunks_streamed(t, _damaged_chunks(t), "damaged").withColumn("part", F.lit(0).cast("bigint")).drop("calls", "kind")


# -- events as streams ------------------------------------------------------------------


def _events(t: Tables):
    rows = table_stream(t.spark, t.folder, "events")
    return rows.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("tokens"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )


def _text(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


@query(
    "idle_sessions_stream",
    ctes("calls") + f""", g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 36000000000 THEN 0 ELSE 1 END AS starts FROM calls WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
    v AS (SELECT *, sum(starts) OVER (PARTITION BY session ORDER BY ts, seq) AS visit FROM g)
    SELECT session, strftime(min(ts), {_STAMP}) AS start, strftime(max(ts) + INTERVAL 10 HOUR, {_STAMP}) AS end, count(*) AS calls FROM v GROUP BY session, visit
    HAVING max(ts) + INTERVAL 10 HOUR <= (SELECT max(ts) FROM calls) - INTERVAL 10 MINUTE""",
)
def _(t: Tables):
    visits = live.idle_sessions(_events(t), "session", "ts", "10 hours", "10 minutes")
    return run_available(visits, "idle").select("session", _text("start"), _text("end"), "calls")


@query(
    "ticks_stream",
    ctes("calls") + f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {_STAMP}) AS start, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS amount FROM calls GROUP BY time_bucket(INTERVAL 1 HOUR, ts)
    HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM calls) - INTERVAL 10 MINUTE""",
)
def _(t: Tables):
    closed = live.ticks(_events(t), "ts", "1 hour", F.col("tokens"), "10 minutes")
    return run_available(closed, "ticks").select(_text("start"), "calls", "amount")


@query(
    "idle_sessions_open",
    ctes("calls") + f""", g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 36000000000 THEN 0 ELSE 1 END AS starts FROM calls WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
    v AS (SELECT *, sum(starts) OVER (PARTITION BY session ORDER BY ts, seq) AS visit FROM g)
    SELECT session, strftime(min(ts), {_STAMP}) AS start, strftime(max(ts) + INTERVAL 10 HOUR, {_STAMP}) AS end, count(*) AS calls FROM v GROUP BY session, visit
    HAVING max(ts) + INTERVAL 10 HOUR > (SELECT max(ts) FROM calls) - INTERVAL 10 MINUTE""",
)
def _(t: Tables):
    """Visits still open when the stream stops; with the closed ones they are all visits."""
    state = scratch_path(t.spark, "idle-state")
    run_available(live.idle_sessions(_events(t), "session", "ts", "10 hours", "10 minutes"), "idle", state=state)
    return live.open_windows(t.spark, state, "calls").select("session", _text("start"), _text("end"), "calls")


@query(
    "ticks_open",
    ctes("calls") + f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {_STAMP}) AS start, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS amount FROM calls GROUP BY time_bucket(INTERVAL 1 HOUR, ts)
    HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM calls) - INTERVAL 10 MINUTE""",
)
def _(t: Tables):
    state = scratch_path(t.spark, "ticks-state")
    run_available(live.ticks(_events(t), "ts", "1 hour", F.col("tokens"), "10 minutes"), "ticks", state=state)
    return live.open_windows(t.spark, state, "calls", "amount").select(_text("start"), "calls", "amount")


@query(
    "bounded_ticks",
    ctes("calls") + f""", h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS amount FROM calls GROUP BY 1 ORDER BY 1 LIMIT 100),
    r AS (SELECT *, CAST(sum(amount) OVER (ORDER BY b) AS BIGINT) AS total FROM h) SELECT strftime(b, {_STAMP}) AS start, calls, amount, total FROM r WHERE total - amount < 900000""",
)
def _(t: Tables):
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    closed = live.ticks(rows, "ts", "1 hour", F.col("tokens"), "10 minutes").drop("end")
    return live.bounded_ticks(closed, 100, 900000).select(_text("start"), "calls", "amount", "total")


@query(
    "correlate_rpc_stream",
    f"""SELECT o_orderkey AS id, strftime(l_shipdate, {_STAMP}) AS l_shipdate, l_partkey, l_suppkey, l_quantity
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY""",
)
def _(t: Tables):
    asked, end_asked = with_end(
        table_stream(t.spark, t.folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts")), "asked"
    )
    answers, end_answers = with_end(table_stream(t.spark, t.folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_partkey", "l_suppkey", "l_quantity"
    ), "answers")
    paired = live.correlate_rpc_stream(
        asked.withColumnRenamed("ts", "o_orderdate"), answers.withColumnRenamed("ts", "l_shipdate"), "id", "o_orderdate", "l_shipdate", "30 days", "1 hour"
    )

    def end():
        end_input(t.spark, end_asked)
        end_input(t.spark, end_answers, id=-1)  # the join drops rows without a key before they move the watermark

    return run_available(paired, "rpc", more=[end]).select("id", _text("l_shipdate"), "l_partkey", "l_suppkey", "l_quantity")


def _rpc_rows(t: Tables):
    """Customers as servers that exit at every order whose key is a multiple of five; first line items as responses."""
    order = [F.col("o_custkey").alias("server"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts")]
    orders = table_stream(t.spark, t.folder, "orders")
    # responses name their request only; its server comes from a table of requests
    known = t.orders.select(F.col("o_custkey").alias("server"), F.col("o_orderkey").alias("id"))
    told = table_stream(t.spark, t.folder, "lineitem").filter("l_linenumber = 1").select(
        F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_returnflag") == "R").alias("failed")
    ).join(known, "id")
    return live.rpc_rows(orders.select(*order), told, orders.filter("o_orderkey % 5 = 0").select(*order))


@query("correlate_rpc_exits_stream", ORACLES["correlate_rpc_exits"])
def _(t: Tables):
    """What the closed stream gave, and as timeouts what no exit came for: all requests, as in the batch form."""
    state = scratch_path(t.spark, "rpc-state")
    settled = done(run_to_end(_rpc_rows(t), lambda rows: live.correlate_rpc_exits_stream(rows, 30 * 86_400_000, "1 hour"), "rpc", state))
    over = live.unanswered(t.spark, state).select(F.col("id").alias("o_orderkey"), "status", F.lit(None).cast("timestamp_ntz").alias("exit_at"))
    exit_at = F.timestamp_micros("exit_us").cast("timestamp_ntz").alias("exit_at")
    return settled.select(F.col("id").alias("o_orderkey"), "status", exit_at).unionByName(over)


@query(
    "usage_stream",
    ctes("calls") + """, r AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS total, CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS turns FROM calls WINDOW w AS (PARTITION BY session ORDER BY ts, seq))
    SELECT session, seq, total, turns, CASE WHEN total >= 200000 THEN 'cost' ELSE 'turns' END AS reason FROM r WHERE event_type <> 'view' AND (total >= 200000 OR turns >= 50) QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts, seq) = 1""",
)
def _(t: Tables):
    rows = _events(t).select("session", "ts", "seq", F.col("tokens").alias("amount"), (F.col("event_type") != "view").alias("turn"))
    return done(run_to_end(rows, lambda r: live.usage_stream(r, 200000, 50), "usage"))


@query(
    "streaks_stream",
    ctes("calls", more="""a AS (SELECT *, event_type = 'error' OR k > 60 AS denied FROM calls), b AS (SELECT *, sum(CASE WHEN denied THEN 0 ELSE 1 END) OVER w AS island, CAST(sum(CASE WHEN denied THEN 1 ELSE 0 END) OVER w AS BIGINT) AS total FROM a WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
      c AS (SELECT *, CAST(sum(CASE WHEN denied THEN 1 ELSE 0 END) OVER (PARTITION BY session, island ORDER BY ts, seq) AS BIGINT) AS run FROM b)""")
    + "SELECT session, seq, total, CASE WHEN denied THEN run ELSE 0 END AS run, denied AND (run >= 4 OR total >= 30) AS limit_reached FROM c",
)
def _(t: Tables):
    rows = _events(t).select("session", "ts", "seq", ((F.col("event_type") == "error") | (F.col("k") > 60)).alias("denied"))
    return done(run_to_end(rows, lambda r: live.streaks_stream(r, 4, 30), "streaks"))


@query(
    "streaks_pending",
    ctes("calls") + "SELECT session, seq FROM calls WHERE ts >= (SELECT date_trunc('minute', date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR) FROM calls)",
)
def _(t: Tables):
    """Rows that the watermark has not passed when the stream stops without an end of its input."""
    state = scratch_path(t.spark, "streaks-state")
    rows = _events(t).select("session", "ts", "seq", (F.col("event_type") == "error").alias("denied"))
    run_available(live.streaks_stream(rows, 4, 30), "streaks", state=state)
    return waiting_rows(t.spark, state).select("session", "seq")


_RETRIES = ctes("calls", more="""a AS (SELECT session, seq, ts, event_type IN ('error', 'signup', 'purchase') AS bad, event_type IN ('error', 'signup', 'purchase') AND k < 90 AS again FROM calls),
      b AS (SELECT *, CASE WHEN coalesce(lag(again) OVER (PARTITION BY session ORDER BY ts, seq), FALSE) THEN 0 ELSE 1 END AS starts FROM a),
      c AS (SELECT *, sum(starts) OVER (PARTITION BY session ORDER BY ts, seq) AS chain FROM b),
      d AS (SELECT *, (row_number() OVER (PARTITION BY session, chain ORDER BY ts, seq) - 1) // 4 AS block FROM c),
      e AS (SELECT session, chain, block, min(seq) AS first, max(seq) AS seq, count(*) AS attempts, arg_max(again, seq) AS again, arg_max(bad, seq) AS bad FROM d GROUP BY ALL)""")


def _attempts(t: Tables):
    bad = F.col("event_type").isin("error", "signup", "purchase")
    return _events(t).select("session", "ts", "seq", bad.alias("bad"), (bad & (F.col("k") < 90)).alias("again"))


@query(
    "retry_stream",
    _RETRIES + """SELECT session, seq, first, attempts, CASE WHEN again THEN 'exhausted' WHEN bad THEN 'fatal' WHEN attempts > 1 THEN 'recovered' ELSE 'ok' END AS outcome FROM e WHERE NOT again OR attempts > 3""",
)
def _(t: Tables):
    return done(run_to_end(_attempts(t), live.retry_stream, "retry"))


@query("retry_open", _RETRIES + "SELECT session, first, attempts FROM e WHERE again AND attempts <= 3")
def _(t: Tables):
    """Chains that were begun and not ended when the input ends."""
    state = scratch_path(t.spark, "retry-state")
    run_to_end(_attempts(t), live.retry_stream, "retry", state)
    return live.open_chains(t.spark, state)


# Results and turns arrive in two parts: the second has the stragglers, one row of fifty, once the watermark of the
# first stands. What lies behind it then is late.
_LATE = ctes("calls", more="""x AS (SELECT session, seq, tool = 'read_file' AS is_turn, CASE WHEN tool = 'read_file' THEN ts ELSE ts + to_microseconds(k * 60000000) END AS due, seq % 50 = 7 AS straggler FROM calls),
  p AS (SELECT date_trunc('minute', date_trunc('millisecond', max(due) FILTER (WHERE NOT straggler)) - INTERVAL 2 HOUR) AS one, date_trunc('minute', date_trunc('millisecond', max(due)) - INTERVAL 2 HOUR) AS two FROM x),
  y AS (SELECT x.*, straggler AND due < one AS late, two FROM x, p),
  r AS (SELECT * FROM y WHERE NOT is_turn AND NOT late), tn AS (SELECT * FROM y WHERE is_turn AND NOT late),
  j AS (SELECT r.session, r.seq, arg_min(tn.seq, (tn.due, tn.seq)) AS turn, coalesce(min(tn.due) < any_value(r.two), FALSE) AS settled FROM r LEFT JOIN tn ON tn.session = r.session AND tn.due >= r.due GROUP BY r.session, r.seq)""")


def _late_results(t: Tables, state: str | None = None):
    folder = scratch_path(t.spark, "arrivals")
    turn = F.col("event_type") == "view"
    minutes = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    at = F.when(turn, F.col("ts").cast("timestamp")).otherwise(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + minutes * 60000000))
    rows = t.events.select(F.col("user_id").alias("session"), at.alias("ts"), F.col("event_id").alias("seq"), turn.alias("is_turn"))
    straggler = F.col("seq") % 50 == 7
    rows.where(~straggler).write.parquet(folder)
    use_rocksdb(t.spark)
    stream = t.spark.readStream.schema(rows.schema).parquet(folder)
    stragglers = lambda: rows.where(straggler).write.mode("append").parquet(folder)
    return run_available(live.late_results_stream(stream, "2 hours"), "late", state=state, more=[stragglers])


@query("late_results_stream", _LATE + "SELECT session, seq, turn FROM j WHERE settled")
def _(t: Tables):
    return done(_late_results(t))


@query("late_results_pending", _LATE + "SELECT session, seq FROM j WHERE NOT settled")
def _(t: Tables):
    """Results that no settled turn follows yet, read from the state of the stopped stream."""
    state = scratch_path(t.spark, "late-state")
    _late_results(t, state)
    return live.unsettled_results(t.spark, state)


@query("late_results_late", _LATE + "SELECT session, seq FROM y WHERE late")
def _(t: Tables):
    """Results and turns that came behind the watermark."""
    return late(_late_results(t))
