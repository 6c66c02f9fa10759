"""SimHash near-duplicates, found through a table of Hamming distances to reference fingerprints.

Every distinct fingerprint gets its distances to many reference fingerprints (pivots). By the triangle inequality two
fingerprints within `max_bits` differ by at most `max_bits` in every coordinate, so a pair with a larger coordinate
difference is discarded; what survives is verified by counting differing bits.

The references come in families: a base reference, and the same with one block of bits inverted. The difference of
those two coordinates depends on that block alone. With `max_bits` changed bits at least `blocks - max_bits` blocks are
untouched, and all their coordinate differences agree exactly. Those agreeing differences are the join key, so no
pairs are formed that the table would discard on them, and no link is lost.

Copies share one fingerprint and are one row here; links are only between different fingerprints. Components come from
alternating star contraction over the link table, in rounds stored in the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows with equal ids are separate
rows; a null id never names a component unless its whole component has no other id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import prepared, stored

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BLOCKS = 5
#: Base references; with the inverted blocks there are BASES * (BLOCKS + 1) pivots.
BASES = 8


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text as a signed number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.dtype("<u8"))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for long texts
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and signed fingerprint `fp` of every row."""
    prepared(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x) for x in texts], dtype="int64")

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), of(F.col(f"`{text}`").cast("string")).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(blocks: int = BLOCKS, bases: int = BASES) -> tuple[list[int], list[int]]:
    """Base references and the masks of the blocks, as unsigned numbers."""
    borders = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(borders, borders[1:])]
    return [xxhash.xxh64_intdigest(f"reference {k}", SEED) for k in range(bases)], masks


def pivot_table(prints: DataFrame, blocks: int = BLOCKS, bases: int = BASES) -> DataFrame:
    """fp, `pivots`: distances to the base references, and `steps`: per block the differences to the inverted ones."""
    starts, masks = references(blocks, bases)

    def distance(reference: int) -> Column:
        return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(reference)).cast("long")))

    near = prints.withColumn("pivots", F.array(*[distance(r) for r in starts]))
    steps = [F.array(*[distance(r ^ m) - F.get("pivots", k) for k, r in enumerate(starts)]) for m in masks]
    return near.withColumn("steps", F.array(*steps))


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bases: int = BASES) -> DataFrame:
    """Pairs a < b of distinct fingerprints with at most `max_bits` differing bits."""
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    table = pivot_table(prints, blocks, bases)
    keys = F.array(*[
        F.xxhash64(F.lit(k), *[F.get("steps", b) for b in chosen])
        for k, chosen in enumerate(combinations(range(blocks), blocks - max_bits))
    ])
    # the distances of the base references travel in one number, eight bits each
    packed = None
    for k in range(min(bases, 8)):
        part = F.shiftleft(F.get("pivots", k).cast("long"), 8 * k)
        packed = part if packed is None else packed.bitwiseOR(part)
    rows = table.select(F.explode(keys).alias("key"), "fp", packed.alias("near"))
    a, b = rows.alias("a"), rows.alias("b")

    def coordinate(k: int) -> Column:
        part = [F.shiftrightunsigned(F.col(f"{s}.near"), 8 * k).bitwiseAND(F.lit(255).cast("long")) for s in "ab"]
        return F.abs(part[0] - part[1])

    apart = F.greatest(*[coordinate(k) for k in range(min(bases, 8))])
    differ = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (apart <= max_bits) & (differ <= max_bits)
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """fp, component_id and root for every fingerprint that has a link: name and fp of the node of smallest `name`.

    Alternating star contraction: each node hands its larger neighbours, then its smaller ones, to the smallest node
    it knows. The number of rounds grows with the logarithm of the component size; degrees are aggregated before any
    row is moved, so that no neighbourhood is ever collected.
    """
    # nodes are ordered by (name, fp): `rank` pairs make the smallest node the right representative
    first = names.select(F.col("fp").alias("a"), F.col("name").alias("na"))
    second = names.select(F.col("fp").alias("b"), F.col("name").alias("nb"))
    named = edges.join(first, "a").join(second, "b")
    node = lambda name, fp: F.struct(F.col(name).isNull().alias("null"), F.col(name).alias("name"), F.col(fp).alias("fp"))
    pairs = named.select(F.greatest(node("na", "a"), node("nb", "b")).alias("u"), F.least(node("na", "a"), node("nb", "b")).alias("v"))
    pairs = stored(pairs, "star")
    seen = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = stored(small.where(F.col("u") != F.col("v")).distinct(), "star")
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return pairs.select(F.col("u.fp").alias("fp"), F.col("v.name").alias("component_id"), F.col("v.fp").alias("root"))
        seen = state


def _linked(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints with their smallest doc_id, the links between them, and the components of those that have one."""
    names = prints.groupBy("fp").agg(F.min("doc_id").alias("name"))
    edges = stored(links(names.select("fp")), "links")
    return names, edges, components(edges, names)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row, and its number of linked fingerprints."""
    prints = stored(fingerprints(docs, id_col, text), "fingerprints")
    names, edges, roots = _linked(prints)
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    classes = names.join(roots, "fp", "left").join(degree, "fp", "left")
    classes = classes.select("fp", F.coalesce("component_id", "name").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def near_prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and component of every row, as `keep_one` takes them: groups of linked fingerprints.

    component is the fingerprint that represents its group, as two groups may share their smallest id.
    """
    prints = fingerprints(docs.withColumn("_hash", F.xxhash64("text")).select(F.struct("doc_id", "_hash").alias("doc_id"), "text"))
    prints = stored(prints.select("doc_id.doc_id", F.col("doc_id._hash").alias("text_hash"), "fp"), "fingerprints")
    names, _, roots = _linked(prints)
    classes = names.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"))
    return prints.join(classes, "fp").select("doc_id", "text_hash", "component")


def keep_one(docs: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exactly one row of each group of near duplicates: that with the smallest id, then the smallest text hash.

    near: gives doc_id, text_hash (xxhash64 of the text) and component of every row: a key of its group, as two groups may
    share their smallest id. Ids that are null come last; of rows equal in id and text one stays; rows of a group are
    counted before any moves. Own columns only.
    """
    rows = near(docs).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")
    best = stored(rows.groupBy("component").agg(F.min(place).alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.text_hash").alias("_hash"), F.col("b.n").alias("_n")), "kept")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"))

    def of(keys: DataFrame) -> DataFrame:
        return packed.join(keys.select("_id", "_hash"), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_hash")))

    # only rows that repeat in id and text must meet, once more
    single = of(best.where("_n = 1")).select("_row")
    repeated = of(best.where("_n > 1")).groupBy("_d", "_t").agg(F.first("_row").alias("_row")).select("_row")
    return single.unionByName(repeated).select(*[F.col(f"_row.`{c}`") for c in docs.columns])
