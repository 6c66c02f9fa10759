"""Rules and named entries from layered JSON settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talloom.operators.catalog import layered_override
from talloom.operators.policy import parse_rules


def read_rules(documents: DataFrame) -> DataFrame:
    """Settings documents (value JSON text) as rules (layer, effect, tool, pattern).

    `layer` comes from the document itself; documents that do not parse, and
    lists that are not arrays, give nothing.
    """
    parsed = documents.select(F.try_parse_json("value").alias("v"))
    lists = parsed.select(
        F.try_variant_get("v", "$.layer", "bigint").alias("layer"),
        F.explode(
            F.array(*[
                F.struct(F.lit(e).alias("effect"), F.try_variant_get("v", f"$.permissions.{e}", "array<string>").alias("rules"))
                for e in ("allow", "deny")
            ])
        ).alias("l"),
    )
    rules = lists.select("layer", F.col("l.effect").alias("effect"), F.explode("l.rules").alias("rule"))
    return parse_rules(rules)


def read_layered_config(documents: DataFrame) -> DataFrame:
    """Documents (layer, value) as entries (name, layer, command, entry): the highest layer wins.

    Entries stand under `mcpServers` or at the top; only those whose command is
    a string count.
    """
    parsed = documents.select("layer", F.try_parse_json("value").alias("v"))
    block = F.coalesce(F.try_variant_get("v", "$.mcpServers", "map<string,variant>"), F.try_variant_get("v", "$", "map<string,variant>"))
    entries = parsed.select("layer", F.explode(block).alias("name", "entry"))
    kind = F.schema_of_variant(F.try_variant_get("entry", "$.command", "variant"))
    valid = entries.filter(kind == "STRING").select(
        "name", "layer",
        F.try_variant_get("entry", "$.command", "string").alias("command"),
        F.to_json("entry").alias("entry"),
    )
    return layered_override(valid, ["name"], "layer")
