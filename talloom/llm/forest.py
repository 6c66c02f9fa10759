"""Nearest neighbours by largest inner product, through a forest of hash prefixes.

Each tree gives every vector a long hash string (signs of random projections); a tree is the vectors in order of their
strings. A query descends in all trees to its longest matching prefixes: its neighbours in the sorted arrays. Their
scores bound how near the wanted neighbours are at least, and that tells how far the query has to ascend, in all trees
at once, until a vector of that nearness has been met with probability `TARGET` in some tree. All vectors under the prefixes
of that level are scored exactly. Clustered vectors stop at long prefixes; vectors without structure ascend to
short ones, whatever the cost: no candidate is capped.

The trees lie in cells: one tree, one leading part of the string, one block of bounded size. A cell that holds many
vectors is cut into blocks, and its queries visit each. Vectors shorter than the longest get one more component, which
makes the nearest angle the largest inner product.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so more copies are never indexed, and equal
queries are searched once.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; rows that repeat an id count as copies; fewer candidates than k give shorter lists; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talloom.llm.common import prepared, stored

K = 20
TREES = 16
BITS = 32
SEED = 7
#: Neighbours on each side in the sorted array, for the first look.
NEAR = 12
TARGET = 0.97
CELL_ROWS = 4096
BLOCK_ROWS = 16_384


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and vec of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{column}`").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec").isNotNull() & F.col("id").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))
    return rows


def _hashes(rows: DataFrame, dim: int, kind: str, longest: float | None) -> DataFrame:
    """id, vec as bytes, norm, and a hash string per tree. longest: of all vectors, for candidates; None for queries."""

    def project(batches):
        planes = np.random.default_rng(SEED).standard_normal((dim + 1, TREES * BITS))
        places = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["vec"]).astype(kind)
            exact = vectors.astype(np.float64)
            norm = np.sqrt((exact * exact).sum(axis=1))
            scale = norm if longest is None else np.full(len(norm), longest)
            unit = exact / scale[:, None]
            rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1))) if longest is not None else np.zeros(len(norm))
            signs = np.hstack([unit, rest[:, None]]) @ planes > 0
            strings = (signs.reshape(len(norm), TREES, BITS) * places).sum(axis=2, dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"id": batch["id"], "vec": [v.tobytes() for v in vectors], "norm": norm, "strings": list(strings)})

    return rows.mapInPandas(project, "id long, vec binary, norm double, strings array<long>")


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _best(query: int, vector: np.ndarray, ids: np.ndarray, matrix: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    """The k best of some candidates, ties to the smaller id, with scores that don't depend on the candidates beside them."""
    if len(scores) > 2 * k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bound - 1e-9 * max(1.0, abs(bound)))
    else:
        near = np.arange(len(scores))
    exact = (matrix[near] * vector).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:k]
    return np.full(len(order), query), ids[near][order], exact[order]


def _frame(found: list[tuple]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return pd.DataFrame({n: np.concatenate([x[i] for x in found]) for i, n in enumerate(("query", "id", "score"))})


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every query, without the query's own row."""
    prepared(vectors.sparkSession)
    kind = "<f4" if "float" in dict(vectors.dtypes)[column] else "<f8"
    rows, asked = usable(vectors, id_col, column), usable(queries, id_col, column)
    found = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = found["dim"]
    rows, asked = rows.where(F.size("vec") == dim), asked.where(F.size("vec") == dim)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(square))).first()
    copies = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    items = stored(_hashes(rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy"), dim, kind, float(longest)), "items")
    owners = asked.groupBy("vec").agg(F.min("id").alias("id"))
    seekers = stored(_hashes(owners.select("id", "vec"), dim, kind, None), "seekers")
    lead = min(BITS, max(0, int(math.log2(max(1, n / CELL_ROWS)))))
    tail = BITS - lead

    def by_tree(table: DataFrame) -> DataFrame:
        return table.select("*", F.posexplode("strings").alias("tree", "string")).drop("strings")

    def cell(string: str):
        return F.shiftright(string, tail) if tail < 64 else F.lit(0).cast("long")

    placed = by_tree(items).withColumn("cell", cell("string"))
    sizes = stored(placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks")), "cells")
    placed = placed.join(sizes, ["tree", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.select("tree", "cell", "block", "id", "vec", "string").groupBy("tree", "cell", "block")

    def visit(table: DataFrame):
        """Queries in every block of their cells."""
        blocks = table.join(sizes, ["tree", "cell"])
        return blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks").groupBy("tree", "cell", "block")

    def descend(group: pd.DataFrame, seeking: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(seeking):
            return _frame([])
        group = group.sort_values("string", kind="stable")
        strings, ids, matrix = group["string"].to_numpy(), group["id"].to_numpy(), _matrix(group["vec"], kind)
        at = np.searchsorted(strings, seeking["string"].to_numpy())
        out = []
        for query, vector, p in zip(seeking["id"].tolist(), _matrix(seeking["vec"], kind), at.tolist()):
            a, b = max(0, p - NEAR), min(len(ids), p + NEAR)
            out.append(_best(query, vector, ids[a:b], matrix[a:b], matrix[a:b] @ vector, k + 1))
        return _frame(out)

    def ascend(group: pd.DataFrame, seeking: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(seeking):
            return _frame([])
        group = group.sort_values("string", kind="stable")
        strings, ids, matrix = group["string"].to_numpy(), group["id"].to_numpy(), _matrix(group["vec"], kind)
        seeking = seeking.sort_values(["low", "high"], kind="stable")
        wanted = _matrix(seeking["vec"], kind)
        low, high = np.searchsorted(strings, seeking["low"].to_numpy()), np.searchsorted(strings, seeking["high"].to_numpy(), "right")
        number = seeking["id"].to_numpy()
        out, at = [], 0
        while at < len(number):
            to = at + 1
            while to < len(number) and to - at < 128 and low[to] == low[at] and high[to] == high[at]:
                to += 1
            a, b = low[at], high[at]
            if a < b:
                scores = wanted[at:to] @ matrix[a:b].T
                for query, vector, row in zip(number[at:to].tolist(), wanted[at:to], scores):
                    out.append(_best(query, vector, ids[a:b], matrix[a:b], row, k + 1))
            at = to
        return _frame(out)

    schema = "query long, id long, score double"
    first = placed.cogroup(visit(by_tree(seekers).withColumn("cell", cell("string")))).applyInPandas(descend, schema)
    seen = first.groupBy("query").agg(F.sort_array(F.collect_set(F.struct("score", "id")), asc=False).alias("best"))
    bound = F.get("best", k - 1)["score"]  # null while fewer than k candidates are known
    levels = stored(seen.select(F.col("query").alias("id"), bound.alias("bound")), "bounds")
    meet = 1.0 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("bound") / (F.col("norm") * float(longest))))) / math.pi
    need = math.log(1.0 - (1.0 - TARGET) ** (1.0 / TREES))
    level = F.when(F.col("bound").isNull(), F.lit(0)).when(meet >= 1.0, F.lit(BITS)).otherwise(F.least(F.lit(BITS), F.greatest(F.lit(0), F.floor(F.lit(need) / F.log(meet))))).cast("int")
    ready = seekers.join(levels, "id", "left").withColumn("level", F.coalesce(level, F.lit(0)))
    span = F.expr(f"shiftleft(1L, {BITS} - level)")
    ranges = by_tree(ready).where((F.col("level") > 0) | (F.col("tree") == 0))  # at level 0 one tree holds everything
    ranges = ranges.withColumn("low", F.col("string") - F.pmod(F.col("string"), span)).withColumn("high", F.col("low") + span - 1)
    ranges = ranges.select("tree", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"), "id", "vec", "low", "high")
    second = placed.cogroup(visit(ranges)).applyInPandas(ascend, schema)
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = second.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("place", ranked).where(F.col("place") <= k + 1)
    best = stored(best.select(F.col("query").alias("owner"), F.col("id").alias("vec_id"), "score"), "best")
    names = owners.select("vec", F.col("id").alias("owner"))
    each = asked.join(names, "vec").select(F.col("id").alias("query_id"), "owner").distinct().join(best, "owner").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
