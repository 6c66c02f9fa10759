"""Line logs of JSON, and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talloom.functions.predicates import is_http
from talloom.functions.text import html_to_text, truncate_chars

PARSE_ERROR = "PARSE_ERROR"  # fixed value


def read_event_log(spark: SparkSession, path: str, on_bad: str = "keep") -> DataFrame:
    """JSON lines as (category, event variant, raw).

    keep: a line that does not parse stays, with its own category and its raw
    text; drop: such lines are left out. Blank lines never count.
    """
    if on_bad not in ("keep", "drop"):
        raise ValueError("on_bad is keep or drop")
    lines = spark.read.text(path).filter("value <> ''")
    event = F.array(F.try_parse_json("value"))
    if on_bad == "drop":
        event = F.filter(event, lambda v: v.isNotNull())
    rows = lines.select(F.explode(event).alias("event"), F.col("value").alias("_line"))
    bad = F.col("event").isNull()
    return rows.select(
        F.when(bad, PARSE_ERROR).otherwise(F.try_variant_get("event", "$.category", "string")).alias("category"),
        "event",
        F.when(bad, F.col("_line")).alias("raw"),
    )


def result_texts(log: DataFrame, key: str = "$.toolResults") -> DataFrame:
    """Every tool-result text of a log, one row each."""
    return log.select("category", F.explode(F.try_variant_get("event", key, "array<string>")).alias("result"))


def read_pages(pages: DataFrame, limit: int = 50000) -> DataFrame:
    """pages(url, html, ...) with readable text; other URL schemes are flagged, not fetched."""
    body = truncate_chars(html_to_text(F.col("html")), limit)
    return pages.withColumns({"ok": is_http(F.col("url")), "text": body}).drop("html")
