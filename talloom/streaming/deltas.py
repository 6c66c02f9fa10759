"""Replies that arrive as fragments: reading, assembling, acting early.

Rows of a delta stream are (stream_id, arrived, seq, line): a line of a
server-sent event stream, its place in the stream, and when it arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talloom.functions.predicates import PARALLEL_TOOLS
from talloom.operators.ordered import Ordered, concat_parts, last_upto, running_sum
from talloom.operators.policy import decide
from talloom.sources.sessions import parsed_or_empty
from talloom.streaming.replies import FIRST, LAST, QUIET, assembled

DELTA_SCHEMA = "stream_id string, arrived timestamp, seq bigint, line string"
DONE = "[DONE]"  # fixed value
PART_BYTES = 16 << 20

# Fields of the two payload shapes; others are skipped while parsing.
_BLOCK_PAYLOAD = (
    "type string, index bigint, delta struct<text string, partial_json string, thinking string>, "
    "content_block struct<type string, id string, name string>"
)
_CHUNK_PAYLOAD = (
    "choices array<struct<delta struct<content string, tool_calls array<struct<index bigint, id string, "
    "`function` struct<name string, arguments string>>>>, finish_reason string>>, "
    "usage struct<prompt_tokens bigint, completion_tokens bigint>"
)


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines (stream_id, arrived, seq, line) as a stream."""
    return spark.readStream.schema(DELTA_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_delta_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The data lines of `read_lines`."""
    return data_lines(read_lines(spark, path, files_per_batch))


def read_captured_replies(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Captured replies, one file each, as a stream of data lines. The file gives name and arrival."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return captured_lines(files.select(
        F.col("_metadata.file_name").alias("stream_id"), F.col("_metadata.file_modification_time").alias("arrived"), "value"
    ))


def captured_lines(replies: DataFrame) -> DataFrame:
    """Whole replies (stream_id, arrived, value) as data lines, counted from 0."""
    kept = F.filter(F.split("value", r"\r?\n", -1), lambda x: F.startswith(x, F.lit("data:")))
    lines = replies.select("stream_id", "arrived", F.posexplode(kept).alias("seq", "line"))
    return data_lines(lines.withColumn("seq", F.col("seq").cast("bigint")))


def data_lines(raw: DataFrame) -> DataFrame:
    """The payload of `data:` lines; event names, comments and blanks carry none."""
    payload = F.regexp_extract("line", r"(?s)^data:\s*(.*)\z", 1)
    return raw.filter(F.startswith("line", F.lit("data:"))).select("stream_id", "arrived", "seq", payload.alias("payload"))


def block_events(rows: DataFrame) -> DataFrame:
    """Payloads of the block shape as (stream_id, arrived, seq, event, block, fragment, type, call_id, tool)."""
    def event(v):
        return F.struct(
            v["type"].alias("event"),
            v["index"].alias("block"),
            F.coalesce(v["delta"]["text"], v["delta"]["partial_json"], v["delta"]["thinking"]).alias("fragment"),
            v["content_block"]["type"].alias("type"),
            v["content_block"]["id"].alias("call_id"),
            v["content_block"]["name"].alias("tool"),
        )

    # Filtered inside the array, so that each payload is parsed once.
    parsed = F.transform(F.array(F.from_json("payload", _BLOCK_PAYLOAD)), event)
    return rows.select("stream_id", "arrived", "seq", F.inline(F.filter(parsed, lambda e: e["block"].isNotNull())))


def assemble_blocks(events: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Batch form: blocks (stream_id, block, part) with text or parsed input.

    A block counts as complete when its start, its stop and every row between them are there; repeated rows count
    once. A long text comes in parts. The input of a call is one JSON value, so it always stays whole and is parsed.
    """
    # The start row comes first in a block, so its fields reach every row; one
    # exchange on (stream, block) serves the running values and the parts.
    size = F.coalesce(F.octet_length("fragment"), F.lit(0)).cast("bigint")
    at = F.col("event")
    rows = Ordered(events.dropDuplicates(["stream_id", "block", "seq"]), ["stream_id", "block"], ["seq"]).with_running(
        _before=running_sum(size, inclusive=False),
        _type=last_upto(F.col("type")), _call_id=last_upto(F.col("call_id")), _tool=last_upto(F.col("tool")),
    ).with_total(
        _stops=F.when(at == "content_block_stop", 1), _starts=F.when(at == "content_block_start", 1), _rows=F.lit(1),
        _span=F.when(at == "content_block_stop", F.col("seq")).when(at == "content_block_start", -F.col("seq")),
    )
    delta = F.when(at == "content_block_delta", F.struct("seq", "fragment"))
    # A part exists for its fragments; a block without any still has part 0.
    part = F.when(F.col("_type") == "tool_use", F.lit(0)).otherwise(F.floor(F.col("_before") / part_bytes))
    parts = rows.frame().withColumn("part", part.cast("bigint"))
    complete = (F.max("_stops") == 1) & (F.max("_starts") == 1) & (F.max("_rows") == F.max("_span") + 1)
    joined = parts.groupBy("stream_id", "block", "part").agg(
        F.max("_type").alias("type"), F.max("_call_id").alias("call_id"), F.max("_tool").alias("tool"),
        F.coalesce(complete, F.lit(False)).alias("complete"), F.array_sort(F.collect_list(delta)).alias("_deltas"),
    ).filter((F.col("part") == 0) | (F.size("_deltas") > 0))
    text = F.array_join(F.transform("_deltas", lambda d: d["fragment"]), "")
    return _finished(joined.withColumn("text", text))


def _finished(blocks: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    call = F.col("type") == "tool_use"
    return blocks.filter("complete AND type <> 'thinking'").select(
        "stream_id", "block", "part", "type", "call_id", "tool",
        F.when(~call, body).alias("text"), F.when(call, parsed_or_empty(body)).alias("input"),
    )


def complete_blocks_stream(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """Stream form, append mode: every block once, as soon as it is whole, or as `lost` when its reply fell silent.

    See `assembled`. A lost block has the text of the rows that came, and how many of them are known to be missing.
    """
    at = F.col("event")
    head = F.to_json(F.struct("type", "call_id", "tool"))
    rows = events.select(
        "stream_id", "arrived", "seq", "block",
        F.when(at == "content_block_start", FIRST).when(at == "content_block_stop", LAST).otherwise(0).alias("edge"),
        F.when(at == "content_block_start", head).when(at == "content_block_delta", F.col("fragment")).alias("item"),
    )
    found = assembled(rows, quiet)
    zipped = F.arrays_zip("edges", "items")
    starts = F.filter(zipped, lambda x: x["edges"] == FIRST)
    known = F.from_json(F.get(starts, F.lit(0))["items"], "type string, call_id string, tool string")
    text = F.array_join(F.transform(F.filter(zipped, lambda x: x["edges"] == 0), lambda x: x["items"]), "")
    return found.withColumn("_h", known).select(
        "kind", "stream_id", "block", F.lit(0).cast("bigint").alias("part"), "_h.type", "_h.call_id", "_h.tool", text.alias("text"),
        (F.col("kind") == "whole").alias("complete"), F.get("seqs", F.size("seqs") - 1).alias("stop_seq"), F.col("missing"),
    )


def assemble_blocks_stream(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """Blocks as they become whole, input parsed, thinking left out."""
    return _finished(complete_blocks_stream(events, quiet))


def lost_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of `complete_blocks_stream` whose reply fell silent before they were whole."""
    return blocks.filter("kind = 'lost'").select("stream_id", "block", "type", "call_id", "tool", "text", "missing")


def early_complete(events: DataFrame, allowed: list[str] = PARALLEL_TOOLS, quiet: str = QUIET) -> DataFrame:
    """Calls that may start before their message ends: whole, and of a tool that is safe beside others."""
    calls = complete_blocks_stream(events, quiet).filter((F.col("kind") == "whole") & (F.col("type") == "tool_use") & F.col("tool").isin(*allowed))
    return calls.select("stream_id", "block", "call_id", "tool", parsed_or_empty(F.col("text")).alias("input"), "stop_seq")


def permitted(calls: DataFrame, rules: DataFrame, existing: DataFrame, mode: str = "default") -> DataFrame:
    """Of early calls those that the rules allow without a question; a batch operator, for each micro-batch."""
    given = F.parse_json("input")
    value = F.when(F.col("tool") == "run_shell", F.try_variant_get(given, "$.command", "string")).otherwise(
        F.try_variant_get(given, "$.file_path", "string")
    )
    judged = decide(calls.withColumns({"value": value, "mode": F.lit(mode)}), rules, existing)
    return judged.filter("decision.action = 'allow'").select(*calls.columns)


# -- chunk shape --------------------------------------------------------------------


def chunk_events(rows: DataFrame) -> DataFrame:
    """Payloads of the chunk shape as (stream_id, arrived, seq, done, content, calls, finish, tokens)."""
    done = F.col("payload") == DONE
    parsed = rows.select("stream_id", "arrived", "seq", done.alias("done"), F.from_json("payload", _CHUNK_PAYLOAD).alias("v"))
    first = F.get("v.choices", F.lit(0))
    return parsed.select(
        "stream_id", "arrived", "seq", "done",
        first["delta"]["content"].alias("content"),
        F.transform(first["delta"]["tool_calls"], lambda c: F.struct(
            c["index"].alias("index"), c["id"].alias("id"),
            c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments"),
        )).alias("calls"),
        first["finish_reason"].alias("finish"),
        F.col("v.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("v.usage.completion_tokens").alias("completion_tokens"),
    )


def assemble_chunks(events: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Messages (stream_id, part, text, finish, tokens, missing) and calls (stream_id, index, id, tool, part, input).

    As in the stream form a repeated row counts once. missing is 0 for a whole reply, the number of rows that did not
    come before the done line, or null where that line itself did not come; calls are those of whole replies.
    finish and usage are the last ones sent, with `stop` and 0 when none came.
    A long text comes in parts; an input is one JSON value and stays whole.
    """
    events = events.dropDuplicates(["stream_id", "seq"])
    ends = events.groupBy("stream_id").agg(
        F.max_by("finish", F.when(F.col("finish") != "", F.col("seq"))).alias("finish"),
        F.max_by("prompt_tokens", F.when(F.col("prompt_tokens").isNotNull(), F.col("seq"))).alias("prompt_tokens"),
        F.max_by("completion_tokens", F.when(F.col("completion_tokens").isNotNull(), F.col("seq"))).alias("completion_tokens"),
        (F.max(F.when(F.col("done"), F.col("seq"))) + 1 - F.count(F.lit(1))).alias("missing"),
    )
    texts = concat_parts(events.filter("content <> ''"), ["stream_id"], ["seq"], F.col("content"), "", part_bytes).drop("items")
    messages = ends.join(texts, "stream_id", "left").select(
        "stream_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("finish", F.lit("stop")).alias("finish"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"), "missing",
    )
    pieces = events.select("stream_id", "seq", F.inline("calls")).join(ends.filter("missing = 0").select("stream_id"), "stream_id", "left_semi")
    heads = pieces.groupBy("stream_id", "index").agg(
        F.min_by(F.struct("id", "name"), F.col("seq")).alias("h"),
        F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("piece")))).alias("pieces"),
    )
    body = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    calls = heads.select(
        "stream_id", "index", F.coalesce("h.id", F.lit("")).alias("id"), F.coalesce("h.name", F.lit("")).alias("tool"),
        F.lit(0).cast("bigint").alias("part"), parsed_or_empty(body).alias("input"),
    )
    return messages, calls


_CHUNK_ITEM = (
    "content string, calls array<struct<index bigint, id string, name string, arguments string>>, finish string, "
    "prompt_tokens bigint, completion_tokens bigint"
)


def assemble_chunks_stream(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """Stream form, append mode: a row per reply as soon as it is whole, or as `lost` when it fell silent.

    seq counts the data lines of a reply from 0; the done line is the last.
    """
    item = F.to_json(F.struct("content", "calls", "finish", "prompt_tokens", "completion_tokens"))
    edge = F.when(F.col("seq") == 0, FIRST).otherwise(0) + F.when(F.col("done"), LAST).otherwise(0)
    rows = events.select("stream_id", "arrived", "seq", F.lit(0).cast("bigint").alias("block"), edge.alias("edge"), F.when(~F.col("done"), item).alias("item"))
    parsed = F.transform(F.array_compact("items"), lambda x: F.from_json(x, _CHUNK_ITEM))
    return _replies(assembled(rows, quiet).withColumn("r", parsed), F.col("kind"), F.col("missing"))


def _replies(replies: DataFrame, *more: Column) -> DataFrame:
    """Replies (stream_id, r: their rows in order) as text, end, usage and calls."""

    def last(name: str, default, keep):
        values = F.filter(F.transform("r", lambda x: x[name]), keep)
        return F.coalesce(F.get(values, F.size(values) - 1), F.lit(default))

    pieces = F.flatten(F.array_compact(F.transform("r", lambda x: x["calls"])))
    whole = replies.select(
        "stream_id",
        F.array_join(F.transform("r", lambda x: x["content"]), "").alias("text"),
        last("finish", "stop", lambda v: v != "").alias("finish"),
        last("prompt_tokens", 0, lambda v: v.isNotNull()).alias("prompt_tokens"),
        last("completion_tokens", 0, lambda v: v.isNotNull()).alias("completion_tokens"),
        pieces.alias("pieces"), *more,
    )
    made = F.transform(
        F.array_sort(F.array_distinct(F.transform("pieces", lambda c: c["index"]))), lambda i: _call(F.col("pieces"), i)
    )
    return whole.withColumn("calls", made).drop("pieces")


def _call(pieces, index):
    own = F.filter(pieces, lambda c: c["index"] == index)
    return F.struct(
        index.alias("index"),
        F.coalesce(F.get(own, F.lit(0))["id"], F.lit("")).alias("id"),
        F.coalesce(F.get(own, F.lit(0))["name"], F.lit("")).alias("tool"),
        parsed_or_empty(F.array_join(F.transform(own, lambda c: c["arguments"]), "")).alias("input"),
    )
