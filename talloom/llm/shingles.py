"""Near copies of texts: rows whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from MinHash band keys, links from the exact similarity of the shingle sets (64-bit hashes stand for
the shingles). A 64-bit SimHash cannot give the candidates: at similarity 0.8 about one bit in seven differs, with a
spread of three bits, and a bound on the bits that loses none of them no longer tells unrelated texts apart.

A pair of similarity s shares none of the keys with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above.

1. Every text gives a `node` (a hash of its shingle set, so that copies are one node) and its band keys; only these
   narrow rows are counted. Keys under which the same nodes meet are one bucket.
2. Shingle sets are made again for the nodes that meet others, and go to their buckets. Each bucket hands back links
   that span its components, at most one for each node and component, so large groups never make all their pairs; nor
   does it compare them all: nodes join the star of one they are near, and only stars that can touch meet.
3. A bucket of more than BLOCK_BYTES of sets is cut into blocks and meets by pairs of blocks; no pair is left out.

Words are lower-cased as bytes and split at ASCII white space, as in `simhash`. A text of fewer than five words has one
shingle; texts without words (null, empty, blank) are copies of each other.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import give_back, prepared, stored

SEED = 42
SHINGLE = 5
#: Similarity of a link as a fraction, compared in whole numbers.
SHARED, OF = 4, 5
BANDS = 32
ROWS = 4
BLOCK_BYTES = 16 << 20


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return np.empty(0, "<u8")
    parts = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.dtype("<u8")))


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def band_keys(found: np.ndarray) -> list[int]:
    """Keys under which similar shingle sets meet; none for an empty set."""
    if not len(found):
        return []
    mix = np.frombuffer(b"".join(xxhash.xxh64_digest(f"mix {k}", SEED) for k in range(2 * BANDS * ROWS)), "<u8")
    flip, factor = mix[: BANDS * ROWS], mix[BANDS * ROWS :] | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 2048):  # bounded memory for long texts
        np.minimum(least, ((found[k : k + 2048, None] ^ flip) * factor).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, number of shingles and band keys of every row."""

    @F.pandas_udf("node long, size long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for found in map(shingles, texts):
            rows.append((_node(found), len(found), band_keys(found)))
        return pd.DataFrame(rows, columns=["node", "size", "keys"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), of(F.col("text").cast("string")).alias("_m"))
    return marked.select("doc_id", "text_hash", "_m.*")


def _spanning(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one bucket: enough to join whatever is joined by pairs of sufficient similarity.

    A node in no star yet is compared with all others, and those near it become its star: its later pairs are done, and
    pairs within a star need none. Between a star and earlier ones only nodes can be linked whose distance to the
    representative is at most twice the bound (Jaccard distance is a metric), and only those of other components are
    compared. So a family of near copies takes a pass or a few, not one per node.
    """
    group = group.drop_duplicates("node")
    nodes = group["node"].tolist()
    sets = [np.frombuffer(x, "<u8") for x in group["found"]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark, root, out = np.zeros(len(every), np.int64), np.arange(len(sets)), []
    taken, done = np.zeros(len(sets), bool), np.zeros(len(sets), bool)

    def shared(k: int, codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
        own = code[starts[k] : starts[k] + sizes[k]]
        mark[own] = 1
        found = np.add.reduceat(mark[codes], borders)
        mark[own] = 0
        return found

    def join(k: int, others: np.ndarray) -> None:
        """Links of k with one node of each other component."""
        groups, first = np.unique(root[others], return_index=True)
        new = groups != root[k]
        for at in others[first[new]].tolist():
            out.append((min(nodes[k], nodes[at]), max(nodes[k], nodes[at])))
        if new.any():
            root[np.isin(root, groups[new])] = root[k]

    low = 0
    for k in range(len(sets)):
        if taken[k]:
            continue
        while done[low]:  # compared with all nodes already
            low += 1
        same = shared(k, code[starts[low] :], starts[low:] - starts[low])
        either = sizes[low:] + sizes[k] - same
        near = low + np.flatnonzero(OF * same >= SHARED * either)
        star = near[~taken[near] & (near != k)]
        join(k, near)
        taken[star] = taken[k] = done[k] = True
        reach = low + np.flatnonzero(OF * same >= (2 * SHARED - OF) * either)
        old = reach[taken[reach] & ~done[reach] & (root[reach] != root[k])]
        few, many = sorted((star, old), key=len)
        held = None
        for x in few.tolist():
            left = many[root[many] != root[x]]
            if not len(left):
                continue
            if held is None or len(held) != len(left) or (held != left).any():
                held = left
                codes = np.concatenate([code[starts[y] : starts[y] + sizes[y]] for y in left.tolist()])
                borders = np.cumsum(sizes[left]) - sizes[left]
            same = shared(x, codes, borders)
            join(x, left[OF * same >= SHARED * (sizes[left] + sizes[x] - same)])
    give_back()
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs a < b of nodes of sufficient similarity, whose components are those of all such pairs."""
    keys = marked.select("node", "size", F.explode("keys").alias("key")).distinct()
    met = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")
    ).where("n > 1")
    buckets = met.groupBy("n", "total", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("total") * 8 / F.lit(BLOCK_BYTES)).cast("int")
    members = stored(keys.join(buckets.select("key", blocks.alias("blocks")), "key").select("key", "node", "blocks"), "members")
    # one row of each node stands for its copies: aggregated before it moves, so that copies never meet in one task
    wanted = marked.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("w")).join(members.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", F.col("w.doc_id").alias("_id"), F.col("w.text_hash").alias("_hash"))

    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x).tobytes() for x in texts], dtype="object")

    own = docs.select("doc_id", "text")  # other columns may have any name
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    found = own.join(wanted, on).select("node", sets(F.col("text").cast("string")).alias("found"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"))
    parts = members.select("key", "node", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("part"))
    sent = parts.join(stored(found, "shingles"), "node").select("key", "part.i", "part.j", "node", "found")
    return sent.groupBy("key", "i", "j").applyInPandas(_spanning, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest id of its group of near copies) and component (a key of the group)."""
    from talloom.llm.simhash import components

    prepared(docs.sparkSession)
    marked = stored(marks(docs), "marks")
    names = marked.groupBy(F.col("node").alias("fp")).agg(F.min("doc_id").alias("name"))
    roots = components(stored(links(docs, marked), "links"), names)
    classes = names.join(roots, "fp", "left").select(
        "fp", F.coalesce("component_id", "name").alias("component_id"), F.coalesce("root", "fp").alias("component")
    )
    return marked.join(classes, marked["node"] == classes["fp"]).select("doc_id", "text_hash", "component_id", "component")
