"""Near-duplicate vectors through learnt binary codes and multi-index Hamming tables.

Iterative quantisation learns rotations on a bounded sample: alternately the signs of the rotated vectors, and the
rotation that brings the vectors closest to these signs. The signs, cut into substrings of a few bits, are the keys of
the tables; vectors that share a key in any table meet, and the original vectors decide.

How many tables there are follows from the data: vectors of the sample are turned by exactly the threshold angle, and
tables are added until `RECALL` of these pairs share a key. Pairs closer than that share more keys. The width of a key
follows from the number of distinct vectors, so that a bucket holds some `BUCKET` of them at any size.

Equal vectors are one row until the end. No pairs are emitted: a task takes a bucket (or two blocks of a large bucket,
cut at `BLOCK` rows) as a matrix, counts the links of each row, and gives one edge per row towards the smallest row it
is connected with there. A pair that shares several keys is counted where it shares the first one only.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component, as are vectors whose length is not the most frequent one; rows with equal ids are separate rows; a null id
names a component only where there is no other id; repeated vectors link with each other; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import prepared, stored
from talloom.llm.simhash import components

#: Vectors that the rotations are learnt on, those of smallest hash.
SAMPLE = 20_000
#: Share of pairs at exactly the threshold that must meet in a table.
RECALL = 0.998
BUCKET = 256
BLOCK = 1_024
MIN_WIDTH = 4
ROUNDS = 20
SALTS = 8
_SEED = 7


def usable(vector: Column) -> Column:
    """True for vectors that have a direction."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    matrix = np.asarray(matrix, np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def rotation(sample: np.ndarray, seed: int) -> np.ndarray:
    """An orthogonal matrix whose signs fit the centred sample best, from a random start."""
    turn = np.linalg.qr(np.random.default_rng([_SEED, seed]).normal(size=(sample.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        signs = np.where(sample @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(sample.T @ signs)
        turn = u @ v
    return turn


class Tables:
    """Centre, rotations and the substrings of signs that are the keys of the tables."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float):
        sample = unit(sample)
        self.width = min(max(MIN_WIDTH, math.ceil(math.log2(max(rows, 1) / BUCKET))), sample.shape[1], 24)
        side = np.random.default_rng(_SEED).normal(size=sample.shape)
        side -= (side * sample).sum(axis=1, keepdims=True) * sample
        length = np.sqrt((side * side).sum(axis=1, keepdims=True))
        turned = cosine * sample + math.sqrt(1 - cosine * cosine) * side / np.where(length > 0, length, 1)
        # signs around the mean are balanced. Where all vectors lie so close that they are finer than the threshold, too
        # many tables would be needed, and signs around the origin serve: the flips of those follow from the angle alone.
        shared = (1 - math.acos(cosine) / math.pi) ** self.width
        most = 8 + 2 * math.ceil(math.log(1 - RECALL) / math.log(1 - shared))
        if not self._learn(sample.mean(axis=0), sample, turned, most):
            self._learn(np.zeros(sample.shape[1]), sample, turned, None)

    def _learn(self, centre: np.ndarray, sample: np.ndarray, turned: np.ndarray, most: int | None) -> bool:
        self.centre, self.turns, self.count = centre, [], 0
        missed = np.ones(len(sample), bool)
        while missed.mean() > 1 - RECALL:
            if most is not None and self.count > most:
                return False
            self.turns.append(rotation(sample - centre, len(self.turns)))
            a, b = self._signs(sample, self.turns[-1]), self._signs(turned, self.turns[-1])
            for k in range(sample.shape[1] // self.width):
                if missed.mean() <= 1 - RECALL:
                    break
                own = slice(k * self.width, (k + 1) * self.width)
                missed &= (a[:, own] != b[:, own]).any(axis=1)
                self.count += 1
        return True

    def _signs(self, vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return (vectors - self.centre) @ turn > 0

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """The key of each vector in each table."""
        per_turn = len(self.centre) // self.width
        power = 1 << np.arange(self.width, dtype=np.int32)
        out = []
        for turn in self.turns:
            signs = self._signs(unit(vectors), turn)
            out += [signs[:, k * self.width : (k + 1) * self.width] @ power for k in range(per_turn)]
        return np.stack(out[: self.count], axis=1).astype(np.int32)


def _distinct(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id, h1, h2), and the distinct usable vectors as (node, name, copies, h1, h2, vector)."""
    value = F.col(f"`{vector}`")
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    # zero has two signs; as one vector they are one row
    value = F.transform(value.cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.when(usable(value), value).alias("vector"))
    rows = rows.withColumns({"h1": F.when(F.col("vector").isNotNull(), F.xxhash64("vector")), "h2": F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector"))})
    seen = rows.where("vector IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("name"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    return rows.select("vec_id", "h1", "h2"), stored(seen.withColumn("node", F.monotonically_increasing_id()), "vectors")


def _adjacent(pdf: pd.DataFrame, cosine: float, two: bool) -> pd.DataFrame:
    """Links inside one bucket, or between its two blocks: per node the copies it links to, and an edge."""
    pdf = pdf.sort_values("node", ignore_index=True)
    table = int(pdf["tab"].iloc[0])
    vectors = unit(np.stack(pdf["vector"].to_numpy()))
    near = vectors @ vectors.T >= cosine
    if two:
        side = pdf["blk"].to_numpy()
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    near |= near.T  # rounding must not make a link one-sided
    node = pdf["node"].to_numpy()
    i, j = np.nonzero(near)
    # a pair counts in the first table that it shares a key in
    keys = np.stack(pdf["keys"].to_numpy())[:, :table]
    counted = np.ones(len(i), bool)
    for a in range(0, len(i), 1 << 18):
        b = slice(a, a + (1 << 18))
        counted[b] = ~(keys[i[b]] == keys[j[b]]).any(axis=1)
    linked = np.bincount(i[counted], pdf["copies"].to_numpy()[j[counted]], len(node)).astype(np.int64)
    root = np.arange(len(node))
    while True:  # the smallest row that each is connected with
        least = root.copy()
        np.minimum.at(least, i, root[j])
        least = least[least]
        if (least == root).all():
            break
        root = least
    some = near.any(axis=1)
    return pd.DataFrame({"a": node[some], "b": node[root[some]], "n": linked[some]})


def links(nodes: DataFrame, tables: Tables, cosine: float) -> DataFrame:
    """a, b, n per node with a link and place where it has one: an edge to another node or itself, and linked copies."""
    schema = "a long, b long, n long"

    @F.pandas_udf("array<int>")
    def keys(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(tables.keys(np.stack(vectors.to_numpy()))) if len(vectors) else [], dtype=object)

    coded = stored(nodes.select("node", "copies", "vector", keys("vector").alias("keys")), "codes")
    pos = coded.select("node", F.posexplode("keys").alias("tab", "key"))
    sizes = pos.groupBy("tab", "key").agg(F.count("*").alias("rows"))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")
    sizes = stored(sizes.where("rows > 1").select("tab", "key", blocks), "buckets")
    met = coded.select("*", F.posexplode("keys").alias("tab", "key")).join(sizes, ["tab", "key"])
    met = met.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets itself and, in a group of two blocks, each other one
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y")]
    rows = met.select("tab", "key", *pair, "blk", "node", "copies", "vector", "keys")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        two = pdf["x"].iloc[0] != pdf["y"].iloc[0]
        return _adjacent(pdf, cosine, two) if len(pdf) > 1 else pd.DataFrame({c: np.empty(0, np.int64) for c in "abn"})

    return stored(rows.groupBy("tab", "key", "x", "y").applyInPandas(inside, schema), "near")


def learnt(nodes: DataFrame, cosine: float) -> tuple[DataFrame, Tables] | None:
    """The nodes of the most frequent length, and tables learnt on a bounded sample of them."""
    lengths = nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    if most is None:
        return None
    same = nodes.where(F.size("vector") == most["d"])
    sample = same.select("h1", "h2", "vector").orderBy("h1", "h2").limit(SAMPLE).collect()
    return same, Tables(np.array([r["vector"] for r in sample]), most["n"], cosine)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = prepared(vectors.sparkSession)
    rows, nodes = _distinct(vectors, id_col, vector)
    fit = learnt(nodes, cosine)
    if fit is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    else:
        found = links(fit[0], fit[1], cosine)
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    edges = found.where("a != b").select("a", "b").distinct()
    roots = components(edges, nodes.select(F.col("node").alias("fp"), "name")).withColumnRenamed("fp", "node")
    classes = nodes.join(linked, "node", "left").join(roots, "node", "left").select(
        "h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "name").alias("component_id"),
    )
    # copies of one vector may be many: they are dealt over a few copies of its class
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = rows.withColumn("salt", salt).join(classes, ["h1", "h2", "salt"], "left")
    named = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return named.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
