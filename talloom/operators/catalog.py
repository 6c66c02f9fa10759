"""Catalogues of tools, skills and other named definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.operators.ordered import concat_parts
from talloom.session import small_side


def catalog_search(rows: DataFrame, query: str, name: str, description: str, deferred: Column) -> DataFrame:
    needle = F.lit(query.lower())
    hit = F.contains(F.lower(name), needle) | F.contains(F.lower(F.coalesce(description, F.lit(""))), needle)
    return rows.filter(deferred & hit)


def active_catalog(rows: DataFrame, activated: DataFrame, key: str, deferred: Column) -> DataFrame:
    """Adds `active`: not deferred, or activated."""
    seen = activated.select(key).distinct().withColumn("_on", F.lit(True))
    joined = rows.join(seen, key, "left")
    return joined.withColumn("active", ~deferred | F.col("_on").isNotNull()).drop("_on")


def restrict(rows: DataFrame, allowed: DataFrame | None, key: str, never: str) -> DataFrame:
    """Rows named by the allow-list; without a list all but one name."""
    if allowed is None:
        return rows.filter(F.col(key) != never)
    return rows.join(small_side(allowed.select(key)), key, "left_semi")


def without(rows: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(small_side(removed.select(*keys)), keys, "left_anti")


def pick(candidates: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(selected.select(*keys), keys, "left_semi")


def layered_override(layers: DataFrame, keys: list[str], layer: str) -> DataFrame:
    """The row of the highest layer per key.

    A plain max_by: tasks keep one row per key before the shuffle.
    """
    rest = [c for c in layers.columns if c not in keys]
    best = layers.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(layer)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merged_catalogue(own: DataFrame, external: DataFrame, prefix: str) -> DataFrame:
    """Own rows and external rows named prefix__server__name.

    own(name, description), external(server, name, description).
    """
    named = external.select(
        F.concat_ws("__", F.lit(prefix), "server", "name").alias("name"),
        F.coalesce(
            F.nullif("description", F.lit("")),
            F.concat(F.lit("MCP tool "), "name", F.lit(" from "), "server"),
        ).alias("description"),
    )
    return own.select("name", "description").unionByName(named)


def catalog_sections(rows: DataFrame, flag: str, part_bytes: int) -> DataFrame:
    """Listing per flag value, a second line where `hint` is given.

    rows(name, description, hint, flag).
    """
    shown = F.when(F.col(flag), F.concat(F.lit("/"), "name")).otherwise(F.col("name"))
    first = F.concat(F.lit("- **"), shown, F.lit("**: "), F.coalesce("description", F.lit("")))
    hint = F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit("\n  When to use: "), "hint"))
    return concat_parts(
        rows, [flag], ["name"], F.concat(first, F.coalesce(hint, F.lit(""))), "\n", part_bytes, "listing"
    )


def reshape_def(rows: DataFrame, name: str, description: str, parameters: Column) -> DataFrame:
    """Catalogue rows as nested function definitions in JSON."""
    inner = F.struct(F.col(name).alias("name"), F.col(description).alias("description"), parameters.alias("parameters"))
    return rows.withColumn("definition", F.to_json(F.struct(F.lit("function").alias("type"), inner.alias("function"))))
