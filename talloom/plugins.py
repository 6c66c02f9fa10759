"""Places where a caller's own functions run: selectors, summarisers, tools, sub-tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talloom.functions.text import first_json_object
from talloom.operators.corpus import first_per_group
from talloom.operators.ordered import concat_parts
from talloom.session import reliable

TextFunction = Callable[[list[str]], list[str]]


def apply_text_function(rows: DataFrame, column: str, fn: TextFunction, out: str) -> DataFrame:
    """Adds fn's answer for each text. fn gets a batch of texts and returns as many.

    Filters belong before this call: the optimizer does not move them past it.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: fn(pdf[column].tolist())})

    return rows.mapInPandas(run, schema)


def select_with(
    candidates: DataFrame, keys: list[str], file: str, order: list[str], line: str, fn: TextFunction,
    part_bytes: int = 1 << 20, n: int = 5, field: str = "selected",
) -> DataFrame:
    """Candidates a selector names, at most n per key in candidate order.

    The selector sees the lines of a key joined and answers with a JSON object that lists file names; other answers
    select none. Lines beyond part_bytes are asked in parts, and what the parts name is asked again until one answer
    covers the key, so a key of any size has one selection.
    """
    left = candidates
    while True:
        manifest = concat_parts(left, keys, order, F.col(line), "\n", part_bytes, "manifest").drop("items")
        answered = apply_text_function(manifest, "manifest", fn, "answer")
        names = F.try_variant_get(first_json_object(F.col("answer")), f"$.{field}", "array<string>")
        named = reliable(answered.select(*keys, "part", F.explode(names).alias(file)).distinct(), "named")
        split = named.filter("part > 0").select(*keys).distinct()
        kept = candidates.join(named.drop("part").distinct(), [*keys, file], "left_semi")
        if split.isEmpty():
            return first_per_group(kept, keys, order, n)
        fewer = reliable(kept, "candidates")
        if fewer.count() >= left.count():
            raise ValueError("the selector names all it is shown; its answers never fit one part")
        left = fewer


def summarise_with(
    messages: DataFrame, key: str, order: str, fn: TextFunction, part_bytes: int = 1 << 20
) -> DataFrame:
    """One summary per session. A session beyond part_bytes is summarised in parts, and the summaries again."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    parts = concat_parts(messages, [key], [order], line, "\n", part_bytes, "transcript").drop("items")
    done = apply_text_function(parts, "transcript", fn, "summary").select(key, "part", "summary")
    before = None
    while True:
        done = reliable(done, "summaries")
        rows = done.count()
        if done.filter("part > 0").isEmpty():
            return done.drop("part")
        if before is not None and rows >= before:
            raise ValueError("summaries do not get shorter, so they never fit one part")
        before = rows
        joined = concat_parts(done, [key], ["part"], F.col("summary"), "\n", part_bytes, "transcript")
        again = apply_text_function(joined.filter("items > 1").drop("items"), "transcript", fn, "summary")
        alone = joined.filter("items = 1").withColumn("summary", F.col("transcript"))
        done = again.select(key, "part", "summary").unionByName(alone.select(key, "part", "summary"))


def register_tool(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """An external tool as a table function callable by name in SQL."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def apply_approvals(decided: DataFrame, approvals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final action of calls once their questions were answered.

    decided(keys, action, message), approvals(keys, approved); a question
    without an answer stays open.
    """
    joined = decided.join(approvals.select(*keys, "approved"), list(keys), "left")
    asked = F.col("action") == "confirm"
    final = (
        F.when(~asked, F.col("action"))
        .when(F.col("approved"), "allow")
        .when(~F.col("approved"), "deny")
        .otherwise("confirm")
    )
    return joined.withColumn("final", final).drop("approved")


def run_tasks(tasks: DataFrame, fn: Callable[[str], tuple[str, int, int]]) -> DataFrame:
    """Runs a sub-task per row (task_id, parent_id, prompt): text and token counts come back."""
    schema = "task_id bigint, parent_id bigint, text string, in_tok bigint, out_tok bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [fn(p) for p in pdf["prompt"]]
            out = pd.DataFrame(done, columns=["text", "in_tok", "out_tok"], index=pdf.index)
            yield pd.concat([pdf[["task_id", "parent_id"]].astype("Int64"), out], axis=1)

    return tasks.select("task_id", "parent_id", "prompt").mapInPandas(run, schema)
