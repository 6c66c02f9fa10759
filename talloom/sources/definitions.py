"""Skills and agent types defined by notes, in layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talloom.functions.frontmatter import parse_frontmatter
from talloom.functions.text import flag_default_true, parse_list
from talloom.operators.catalog import layered_override


def parse_definitions(raw: DataFrame) -> DataFrame:
    """Notes (layer, folder, text) as definitions, the highest layer per name.

    The name falls back to the last part of the folder. Both spellings of the
    two-word keys are read.
    """
    parsed = raw.withColumn("_p", parse_frontmatter(F.col("text")))
    meta = F.col("_p.meta")
    folder_name = F.element_at(F.split("folder", "/"), -1)
    tools = F.nullif(F.coalesce(meta["allowed-tools"], meta["allowed_tools"]), F.lit(""))
    rows = parsed.select(
        "layer",
        "folder",
        F.coalesce(F.nullif(meta["name"], F.lit("")), F.nullif(folder_name, F.lit("")), F.lit("unknown")).alias("name"),
        F.coalesce(meta["description"], F.lit("")).alias("description"),
        F.coalesce(F.nullif(meta["when_to_use"], F.lit("")), meta["when-to-use"]).alias("when_to_use"),
        F.when(tools.isNotNull(), parse_list(tools)).alias("allowed_tools"),
        flag_default_true(F.coalesce(meta["user-invocable"], meta["user_invocable"])).alias("user_invocable"),
        F.when(meta["context"] == "fork", "fork").otherwise("inline").alias("context"),
        F.col("_p.body").alias("template"),
    )
    return layered_override(rows, ["name"], "layer")
