"""Session documents: reading both message shapes, listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_FIELDS = {  # fixed values: field in the document and its type
    "id": "string", "model": "string", "cwd": "string", "startTime": "timestamp", "messageCount": "bigint",
}
METADATA_NAMES = {"startTime": "start_time", "messageCount": "message_count"}


@dataclass(frozen=True)
class Sessions:
    """metadata one row per session, messages, blocks, and what did not parse."""

    metadata: DataFrame
    messages: DataFrame
    blocks: DataFrame
    corrupt: DataFrame


def read_sessions(spark: SparkSession, path: str, whole_files: bool = False) -> Sessions:
    """Documents as JSON lines, or one file each with whole_files.

    Every list in a document next to its metadata is taken as messages, so both
    wire shapes load. Each of the four frames reads only what it needs.
    """
    raw = spark.read.text(path, wholetext=whole_files)
    return parse_sessions(raw)


def parse_sessions(raw: DataFrame) -> Sessions:
    def ident_of(v: Column) -> Column:
        return F.try_variant_get(v, "$.metadata.id", "string")

    # The test runs inside the array, as a filter on the parsed column would
    # move below it and parse every document twice.
    readable = F.filter(F.array(F.try_parse_json("value")), lambda v: ident_of(v).isNotNull())
    good = raw.select(F.explode(readable).alias("v"))
    ident = ident_of(F.col("v"))
    metadata = good.select(*[
        F.try_variant_get("v", f"$.metadata.{field}", kind).alias(METADATA_NAMES.get(field, field))
        for field, kind in METADATA_FIELDS.items()
    ])
    lists = F.map_values(
        F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: k != "metadata")
    )
    arrays = F.transform(lists, lambda x: F.try_variant_get(x, "$", "array<variant>"))
    messages = good.select(
        ident.alias("session_id"), F.posexplode(F.flatten(F.array_compact(arrays))).alias("msg_idx", "m")
    )
    return Sessions(
        metadata,
        _message_rows(messages),
        _block_rows(messages),
        raw.filter(ident_of(F.try_parse_json("value")).isNull()).select("value"),
    )


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _message_rows(messages: DataFrame) -> DataFrame:
    content = F.try_variant_get("m", "$.content", "variant")
    return messages.select(
        "session_id",
        F.col("msg_idx").cast("bigint").alias("msg_idx"),
        F.try_variant_get("m", "$.role", "string").alias("role"),
        F.when(_kind(content) == "STRING", F.try_variant_get(content, "$", "string")).alias("text"),
    )


def _block(kind: Column, text=None, call_id=None, tool=None, given=None, result=None) -> Column:
    none = F.lit(None).cast("string")
    fields = {"type": kind, "text": text, "call_id": call_id, "tool": tool, "input": given, "result": result}
    return F.struct(*[(none if c is None else c).alias(n) for n, c in fields.items()])


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _block_rows(messages: DataFrame) -> DataFrame:
    """Both shapes as (type, text, call_id, tool, input JSON, result)."""
    m = F.col("m")
    content = F.try_variant_get(m, "$.content", "variant")
    is_text = _kind(content) == "STRING"
    role = _get(m, "$.role")

    listed = F.transform(
        F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>")),
        lambda b: _block(
            _get(b, "$.type"),
            _get(b, "$.text"),
            F.coalesce(_get(b, "$.id"), _get(b, "$.tool_use_id")),
            _get(b, "$.name"),
            F.to_json(F.try_variant_get(b, "$.input", "variant")),
            _get(b, "$.content"),
        ),
    )
    reply = F.array(_block(F.lit("tool_result"), call_id=_get(m, "$.tool_call_id"), result=_get(m, "$.content")))
    said = F.array(_block(F.lit("text"), text=_get(m, "$.content")))
    asked = F.transform(
        F.coalesce(F.try_variant_get(m, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: _block(
            F.lit("tool_use"),
            call_id=_get(c, "$.id"),
            tool=_get(c, "$.function.name"),
            given=parsed_or_empty(_get(c, "$.function.arguments")),
        ),
    )
    first = F.when(role == "tool", reply).when(is_text, said).otherwise(listed)
    rows = messages.select("session_id", "msg_idx", F.posexplode(F.concat(first, asked)).alias("block_idx", "b"))
    return rows.select(
        "session_id", F.col("msg_idx").cast("bigint").alias("msg_idx"), F.col("block_idx").cast("bigint").alias("block_idx"), "b.*"
    )


def parsed_or_empty(text: Column) -> Column:
    """JSON text in canonical form; anything that does not parse is {}."""
    return F.coalesce(F.to_json(F.try_parse_json(F.coalesce(text, F.lit("")))), F.lit("{}"))
