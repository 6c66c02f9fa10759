"""Notes: a header of `key: value` lines between `---` lines, then a body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talloom.functions.text import trim_ws

NOTE_TYPES = ["user", "feedback", "project", "reference"]  # fixed values
DEFAULT_TYPE = "project"


# A first line and a later line that are --- apart from blanks. The flags make
# only \n end a line. The lazy dot runs without recursion on any length.
HEADER = r"(?dms)\A[^\S\n]*---[^\S\n]*\n.*?^[^\S\n]*---[^\S\n]*$"


def parse_frontmatter(text: Column) -> Column:
    """struct(meta map<string,string>, body). Without a closed header: empty map, whole text."""
    # A one-element transform binds the matched header, so the search runs once.
    found = F.transform(F.array(F.regexp_extract(text, HEADER, 0)), lambda h: _parsed(text, h))
    return F.get(found, F.lit(0))


def _parsed(text: Column, head: Column) -> Column:
    lines = F.split(head, "\n", -1)
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    pairs = F.filter(
        F.transform(
            F.filter(inner, lambda x: F.contains(x, F.lit(":"))),
            lambda x: F.struct(
                trim_ws(F.substring_index(x, ":", 1)).alias("key"),
                trim_ws(F.substr(x, F.instr(x, F.lit(":")) + 1)).alias("value"),
            ),
        ),
        lambda p: p["key"] != "",
    )
    # The last of several equal keys wins. The pairs are bound like the header, or every one of them would make them all.
    last_only = F.get(F.transform(F.array(pairs), lambda all_: F.filter(
        all_,
        lambda p, i: ~F.exists(
            F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == p["key"]
        ),
    )), F.lit(0))
    body = trim_ws(F.substr(text, F.length(head) + 1))
    return F.struct(
        F.map_from_entries(last_only).alias("meta"), F.when(head == "", text).otherwise(body).alias("body")
    )


def render_frontmatter(fields: Sequence[tuple[str, Column]], body: Column) -> Column:
    lines = [F.concat(F.lit(f"{key}: "), value) for key, value in fields]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), body)


def valid_type(value: Column, allowed: Sequence[str], default: str | None) -> Column:
    """The value if allowed, else the default (null for a header scan)."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))
