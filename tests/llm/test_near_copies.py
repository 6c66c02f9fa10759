"""The near-dedup stage and the pipeline against all pairs of texts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talloom.llm import shingles, simhash


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_roots(rows):
    """(id, text) -> smallest id reachable over pairs of similarity 0.8 or more."""
    sets, root = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 5 * shared >= 4 * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.fixture(scope="module")
def copies(spark, texts, sf, tmp_path_factory):
    """The given table and copies of it with one to five changed words."""
    rng, rows = np.random.default_rng(3), []
    for i, text in texts:
        words = (text or "").split(" ")
        for k in range(1, 6) if 60 <= len(words) <= 400 and len(rows) < 200 else ():
            for at in rng.choice(len(words), k, replace=False):
                words[at] = f"changed{k}"
            rows.append((1_000_000 + 10 * i + k, " ".join(words)))
    folder = str(tmp_path_factory.mktemp("copies"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.select("lang", "source", "doc_id")
    more = spark.createDataFrame(rows, "doc_id long, text string")
    more = more.join(first.withColumnRenamed("doc_id", "_of"), F.floor((F.col("doc_id") - 1_000_000) / 10) == F.col("_of"))
    more = more.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)
    docs.union(more).write.parquet(f"{folder}/documents.parquet")
    return folder


def print_roots(rows):
    """(id, text) -> smallest id reachable over fingerprints that differ in at most three bits."""
    prints = np.array([simhash.fingerprint(t) for _, t in rows], "<i8").view("<u8")
    ids, left, out = np.array([i for i, _ in rows]), set(range(len(rows))), {}
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            k = queue.pop()
            group.add(k)
            near = [x for x in np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 3).tolist() if x in left]
            left -= set(near)
            queue += near
        out |= {int(ids[k]): int(min(ids[x] for x in group)) for k in group}
    return out


def test_pipeline_against_all_pairs(spark, copies):
    """The near-dedup stage keeps the smallest id of each group of linked SimHash fingerprints."""
    docs = spark.read.parquet(f"{copies}/documents.parquet")
    passed = [tuple(r) for r in corpus_pipeline.quality_rules(spark, docs, copies).select("doc_id", "text").collect()]
    roots = print_roots(passed)
    assert len(set(roots.values())) < len(roots) - 20 and roots != plain_roots(passed)
    stage = corpus_pipeline.simhash_near_dedup(spark, corpus_pipeline.quality_rules(spark, docs, copies), copies)
    assert sorted(r["doc_id"] for r in stage.collect()) == sorted(set(roots.values()))
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, copies).select("doc_id").distinct().collect()}
    assert ids and ids <= set(roots.values())


@pytest.mark.parametrize("block", [shingles.BLOCK_BYTES, 20_000])
def test_near_copies_against_all_pairs(spark, copies, block, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_BYTES", block)
    docs = spark.read.parquet(f"{copies}/documents.parquet")
    roots = plain_roots([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs).collect()} == roots


def bucket(sets):
    return pd.DataFrame({"node": range(len(sets)), "found": [np.array(sorted(x), "<u8").tobytes() for x in sets]})


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for k in range(n):
        groups.setdefault(find(k), set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_buckets_against_all_pairs():
    """Families and chains that drift: stars that touch, near misses, links between stars only."""
    rng = np.random.default_rng(1)
    for _ in range(150):
        sets = []
        for _ in range(rng.integers(1, 4)):
            base = set(rng.integers(0, 1 << 30, rng.integers(5, 40)).tolist())
            for _ in range(rng.integers(1, 25)):
                own = set(base)
                for _ in range(rng.integers(0, 5)):
                    if len(own) > 1 and rng.random() < 0.6:
                        own.discard(sorted(own)[rng.integers(len(own))])
                    if rng.random() < 0.6:
                        own.add(int(rng.integers(0, 1 << 30)))
                sets.append(frozenset(own))
                base = own if rng.random() < 0.5 else base
        sets = list(dict.fromkeys(sets))
        rng.shuffle(sets)
        shared = lambda i, j: (len(sets[i] & sets[j]), len(sets[i] | sets[j]))
        near = [(i, j) for i in range(len(sets)) for j in range(i) for s, u in [shared(i, j)] if 5 * s >= 4 * u]
        made = [tuple(x) for x in shingles._spanning(bucket(sets)).itertuples(index=False)]
        assert set(made) <= {(min(x), max(x)) for x in near}
        assert classes(len(sets), made) == classes(len(sets), near)


def test_a_large_family_takes_no_pass_per_node():
    base, n = list(range(1, 10)), 200_000
    assert len(shingles._spanning(bucket([[*base, 100 + k] for k in range(n)]))) == n - 1


def test_near_copies_on_odd_rows(odd, empty):
    rows = shingles.near_copies(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    assert shingles.near_copies(empty).count() == 0
    kept = simhash.keep_one(odd, shingles.near_copies)
    assert kept.columns == odd.columns
    # 1, 2, 3 and the row without id and text are one group, so are 6, 6 and 7
    ids = [(r["doc_id"], (r["text"] or "")[:10], r["node"]) for r in kept.collect()]
    assert sorted(i for i, *_ in ids if i is not None) == [1, 4, 5, 6, 8, 9, 10, 11, 12]
    assert [x for x in ids if x[0] is None] == [(None, "a row with", "own node")] and {x[2] for x in ids} == {"own node"}


def test_exactly_one_row_of_a_group(spark):
    """Repeated rows, null ids, and a row that shares its id with the one kept of another group."""
    a, b, c = ("one two three four five six seven " * 3 + x for x in ("alpha", "beta " * 9, "gamma " * 30))
    rows = [(1, a), (1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (3, None), (3, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(docs, shingles.near_copies).collect()]
    components = {r["component_id"] for r in shingles.near_copies(docs).select("component_id").distinct().collect()}
    groups = len({frozenset(x.split()) for _, x in rows if x}) + 1
    assert len(kept) == groups == 4 and components == {1, 3, None}
    assert sorted((i or 0, len(t or "")) for i, t in kept) == sorted([(1, len(a)), (1, len(b)), (0, len(c)), (3, 0)])


def test_odd_and_empty_tables_go_through_every_stage(spark, odd, empty, sf):
    """Names that operators use inside, nulls, repeats, empty and very long texts."""
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf)
            found = made.collect()
            if name != "bpe_encoding":
                assert made.columns == odd.columns and all(r["node"] == "own node" and r["epoch"] == "own epoch" for r in found)
            assert not found if docs is empty else name == "quality_rules" or len(found) >= 9
