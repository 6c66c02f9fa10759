"""Operators on documents against brute force, the tokenizers library, and odd input."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talloom.llm import bitpack, bpe, mixing, quality, queries, sharding, simhash, suffixes
from talloom.llm.windows import prefix_classes


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def plain_components(prints):
    """ids and fingerprints -> smallest id reachable over at most three differing bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def plain_spans(rows, width=50):
    """What is left of every (id, text) row."""
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        rank = float("inf") if doc is None else doc
        for k in range(len(raw) - width + 1):
            w = raw[k : k + width]
            first[w] = min(first.get(w, rank), rank)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        rank = float("inf") if doc is None else doc
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if first[raw[k : k + width]] < rank:
                gone[k : k + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))


# 1 -------------------------------------------------------------------------------------------------------------------


def test_quality_on_odd_rows(odd, empty):
    book = quality.apply_policy(quality.ledger(odd))
    rows = {(r["doc_id"], r["n_words"]): r for r in book.collect()}
    assert len(book.collect()) == odd.count()
    assert rows[(1, 0)]["base_failed"] and not rows[(1, 0)]["kept"]
    assert rows[(9, 27_000)]["n_repeat_words"] == 27_000
    assert rows[(10, 1)]["word_chars"] == 200_000
    assert quality.ledger(empty).count() == 0
    assert quality.filter_documents(odd).columns == odd.columns


def test_ablation_counts_rules(spark, sf):
    book = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r[0] for r in book.select("fail_bits").collect()]
    names = [n for n, _ in quality.RULES]
    for row in quality.ablation(book).collect():
        bit = 1 << names.index(row["rule"])
        assert row["n_failed"] == sum(b & bit > 0 for b in bits)
        assert row["n_only"] == sum(b == bit for b in bits)
        assert row["n_kept"] == sum(b == 0 for b in bits)
        assert row["n_kept_without"] == sum(b & ~bit == 0 for b in bits)


def test_quality_keeps_good_and_drops_junk(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    book = quality.apply_policy(quality.ledger(spark.read.parquet(f"{sf}/documents.parquet"))).join(labels, "doc_id")
    good = book.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = book.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and junk < 0.6


# 2 -------------------------------------------------------------------------------------------------------------------


def test_simhash_against_brute_force(spark, sf, texts):
    found = {r["doc_id"]: r for r in queries.op2_simhash_pivots(spark, sf).collect()}
    prints = [plain_fingerprint(t) for _, t in texts]
    ids = [i for i, _ in texts]
    for k, root in enumerate(plain_components(prints)):
        assert (found[ids[k]]["fingerprint"], found[ids[k]]["component_id"]) == (f"{prints[k]:016x}", ids[root])


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    prints = {int(x) for x in base}
    for x in base[:10]:  # neighbours at every distance up to five
        for bits in range(1, 6):
            for _ in range(8):
                y = int(x)
                for b in rng.choice(63, bits, replace=False):
                    y ^= 1 << int(b)
                prints.add(y)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {(r["a"], r["b"]) for r in simhash.links(frame).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert found == want


def test_long_chain_is_one_component(spark):
    x, prints = 0, []
    for k in range(60):
        prints.append(x)
        x ^= 7 << (3 * (k % 20)) if k % 2 else 1 << (k % 60)
    prints = list(dict.fromkeys(prints))
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(prints, prints[1:])], "a long, b long")
    names = spark.createDataFrame([(p, 1000 - k) for k, p in enumerate(prints)], "fp long, name long")
    roots = {r["component_id"] for r in simhash.components(edges, names).collect()}
    assert roots == {1000 - len(prints) + 1}


def test_simhash_on_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in blank} == {1} and len(blank) == 4
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    assert simhash.near_duplicates(empty).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------


def test_spans_against_brute_force(spark, sf, texts):
    found = queries.op3_suffix_intervals(spark, sf).collect()
    assert order(map(tuple, found)) == order(plain_spans(texts))


def test_spans_with_tiny_chunks_and_routes(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "ROUTE_BYTES", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80").repartition(5)
    found = suffixes.duplicate_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert order(map(tuple, found)) == order(plain_spans([x for x in texts if x[0] < 80]))


def test_spans_on_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = suffixes.duplicate_spans(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert order(map(tuple, found)) == order(plain_spans(rows))
    assert suffixes.duplicate_spans(empty).count() == 0


def test_empty_rows_between_removed_ones_have_no_span(spark):
    text = "the same sixty bytes in every row, removed behind the first."
    rows = [(1, text), (2, text), (3, ""), (4, text), (5, None), (6, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = suffixes.duplicate_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans").collect()
    assert order(tuple(r)[:5] for r in found) == order(plain_spans(rows))
    assert {r["doc_id"]: len(r["spans"]) for r in found} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1}


def test_cut_texts_stay_valid(odd):
    kept = suffixes.without_duplicates(odd)
    assert kept.columns == odd.columns
    rows = {(r["doc_id"], r["source"]): r["text"] for r in kept.collect()}
    assert (7, "t") not in rows and rows[(6, "s")]
    assert rows[(12, "s")].encode().decode() == rows[(12, "s")]


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh"])
def test_prefix_classes(letters):
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(letters, np.uint8), 3000)
    data[1000:1400] = data[:400]
    ordered, starts = prefix_classes(data, 50)
    round_ = np.concatenate([data, data[:64]]).tobytes()
    keys = [round_[k : k + 50] for k in ordered]
    assert keys == sorted(keys) or letters != b"ab"
    assert [a != b for a, b in zip(keys[1:], keys)] == starts[1:].tolist()


# 5 -------------------------------------------------------------------------------------------------------------------


def plain_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def test_shards_are_minimax(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", 4)
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, "x" * int(n) + str(k)) for k, n in enumerate(rng.integers(1, 400, 900))], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 7).join(docs.select("doc_id", F.xxhash64("text").alias("h")), "doc_id").orderBy("h").collect()
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) == plain_capacity([r["size"] for r in rows], 7)


def test_hot_group_gets_a_shard_of_its_own(spark):
    rows = [(k, "hot text" * 4) for k in range(500)] + [(1000 + k, f"text number {k} " * 3) for k in range(1000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    shards, loads = defaultdict(list), Counter()
    for r in found:
        shards[r["shard"]].append(r)
        loads[r["shard"]] += r["size"]
    assert len({r["shard"] for r in found if r["doc_id"] < 500}) == 1
    rest = [n for s, n in loads.items() if s != next(r["shard"] for r in found if r["doc_id"] < 500)]
    assert len(rest) == 5 and max(rest) < 1.02 * min(rest)
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))


def test_shards_on_odd_rows(odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count() and {r["law"] for r in rows} == {"bytes"}
    assert {r["shard"] for r in rows if r["doc_id"] in (6, 7)} == {next(r["shard"] for r in rows if r["doc_id"] == 6)}
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert sharding.shard_documents(empty).count() == 0


# 7 -------------------------------------------------------------------------------------------------------------------


def plain_fill(caps, weights, budget):
    """Water-filling by rounds: share what is left among those with room."""
    got = [0.0] * len(caps)
    while budget > 1e-9:
        open_ = [k for k in range(len(caps)) if weights[k] > 0 and caps[k] - got[k] > 1e-9]
        if not open_:
            break
        total = sum(weights[k] for k in open_)
        for k, share in [(k, budget * weights[k] / total) for k in open_]:
            give = min(share, caps[k] - got[k])
            got[k] += give
            budget -= give
    return got


def test_budgets_share_shortages_among_siblings_first(spark):
    rows = [("a", "x", "1", 100), ("a", "x", "2", 5), ("a", "y", "1", 50), ("b", "x", "1", 10), ("b", "y", "1", 1000), (None, None, None, 40)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"a": 2.0, "b": 1.0}, "source": {"2": 4.0}}
    found = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, 200, 2, weights).collect()}
    a, b, other = plain_fill([310, 2020, 80], [2, 1, 1], 200)
    ax, ay = plain_fill([210, 100], [1, 1], a)
    bx, by = plain_fill([20, 2000], [1, 1], b)
    x1, x2 = plain_fill([200, 10], [1, 4], ax)
    want = {("a", "x", "1"): x1, ("a", "x", "2"): x2, ("a", "y", "1"): ay, ("b", "x", "1"): bx, ("b", "y", "1"): by, (None, None, None): other}
    assert found.keys() == want.keys()
    for leaf, value in want.items():
        assert abs(found[leaf] - value) <= 3, leaf


def test_mix_takes_the_longest_prefix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = {"lang": {"de": 5.0}}
    chosen = mixing.mix(docs, 0.6, 3, weights)
    got = Counter()
    for r in chosen.select("doc_id", "lang", "source").collect():
        got[r["doc_id"]] += 1
    rows = docs.select("doc_id", "lang", "source", "text").withColumn("n", mixing.token_count()).collect()
    leaves = defaultdict(list)
    for r in rows:
        leaves[(r["lang"], r["source"])].append(r)
    total = sum(r["n"] for r in rows)
    tree = spark.createDataFrame([("all", *k, sum(r["n"] for r in v)) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    budget = {(r["lang"], r["source"]): r["budget"] for r in mixing.budgets(tree, int(0.6 * total), 3, weights).collect()}
    for leaf, members in leaves.items():
        tokens = sum(r["n"] for r in members)
        whole, rest = divmod(budget[leaf], tokens)

        def key(r):
            body = hashlib.md5(r["text"].encode()).hexdigest()
            return hashlib.md5(f"{mixing.SEED}:{whole}:{r['doc_id']}:{body}".encode()).hexdigest()[:15]

        used, want = 0, Counter()
        open_ = True
        for r in sorted(members, key=key):
            open_ = open_ and used + r["n"] <= rest
            used += r["n"]
            want[r["doc_id"]] = whole + open_
        assert all(got[d] == n for d, n in want.items()), leaf


def test_mix_on_odd_rows(odd, empty):
    assert mixing.mix(odd, 1.0, 1).columns == [*[c for c in odd.columns if c != "epoch"], "epoch"]
    odd = odd.drop("epoch")
    everything = mixing.mix(odd, 1.0, 1)
    assert everything.columns == [*odd.columns, "epoch"]
    # one epoch of everything: only rows of leaves without tokens are left out
    assert {r["doc_id"] for r in everything.collect()} >= {4, 5, 6, 7, 8, 9, 10}
    assert mixing.mix(empty, 1.0).count() == 0


# 8, 9 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_is_the_library(spark, sf, texts, odd, library):
    rows = [(i, t) for i, t in texts] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = [*queries.op8_forced_boundary_bpe(spark, sf).collect(), *bpe.encode_documents(odd).collect()]
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert order(map(tuple, found)) == order(want)


def test_bpe_on_generated_words(library):
    rng = np.random.default_rng(9)
    own = bpe.encoder(bpe.default_path())
    alphabet = list("aeiostnrqxzjw'’éÅΣ0123456789!?.,-_日本́‍😀🙂 ") + ["'s", "'re", "<|startoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, rng.integers(1, 14)))
        ids = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_decoding_from_ids_alone(spark, library):
    """Ids that no encoder made, every token of the vocabulary, none, and null."""
    rng, size = np.random.default_rng(2), library.get_vocab_size()
    rows = [rng.integers(0, size, n).tolist() for n in (1, 2, 1000)] + [list(range(size)), []]
    packed = [(k, struct.pack(f"<{len(ids)}I", *ids)) for k, ids in enumerate(rows)] + [(len(rows), None)]
    frame = spark.createDataFrame(packed, "k long, ids binary").select("k", bpe.decoded(F.col("ids"), bpe.default_path()).alias("t"))
    found = {r["k"]: r["t"] for r in frame.collect()}
    assert found == {k: library.decode(ids, skip_special_tokens=False) for k, ids in enumerate(rows)} | {len(rows): None}


def test_forced_boundaries_cut_nothing_that_merges():
    own = bpe.encoder(bpe.default_path())
    for token in list(own.vocab)[:20_000]:
        ids = [own.vocab[s] for s in own._split(token)]
        assert own.inside.issuperset(a << 32 | b for a, b in zip(ids, ids[1:]))


def test_packed_files_are_the_library(spark, sf, texts, library):
    want, at = [], 0
    for doc, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert order(map(tuple, queries.op9_bit_packed_ids(spark, sf).collect())) == order(want)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    raw = bitpack.pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    for start, count in ((0, 1000), (1, 1), (123, 456), (999, 1), (500, 0)):
        assert (bitpack.unpack(raw, bits, start, count) == ids[start : start + count]).all()


def test_packed_files_of_other_widths_and_many_blocks(spark, sf, monkeypatch, tmp_path):
    """Ids that end inside a byte, several files of a task, and the index of every file against its blocks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = order(tuple(r) for r in queries.op9_bit_packed_ids(spark, sf).collect())
    monkeypatch.setattr(bitpack, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(bitpack, "LINES_PER_FILE", 4)
    assert order(tuple(r) for r in bitpack.round_trip(docs.coalesce(2), bits=17).collect()) == want
    bitpack.write_files(docs.coalesce(2), str(tmp_path / "packed"), bits=19)
    files = [f.read_bytes() for f in (tmp_path / "packed").glob("part-*")]
    assert len(files) > 2
    for data in files:
        index, at = bitpack.block_index(data), 0
        assert 1 <= len(index) <= 3
        for offset, docs_in, tokens in index.tolist():
            bits, _, _, ids, lengths, packed = bitpack.read_block(data, offset)
            assert (offset, docs_in, tokens, bits) == (at, len(ids), int(lengths.sum()), 19)
            at += bitpack.HEADER_BYTES + 16 * len(ids) + len(packed) + 1
        with pytest.raises(ValueError):
            bitpack.block_index(data[:-1])


def test_packed_files_of_odd_rows(odd, empty, library, monkeypatch):
    monkeypatch.setattr(bitpack, "BLOCK_TOKENS", 50)
    rows = bitpack.round_trip(odd).orderBy("start").collect()
    assert len(rows) == odd.count()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert bitpack.round_trip(empty).count() == 0
