import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talloom.llm import runs
from talloom.llm.queries import QUERIES


def brute(words):
    """(start, end, period) of all maximal runs, by comparing the words with themselves at every distance."""
    found, n = [], len(words)
    for q in range(1, n // runs.MIN_TIMES + 1):
        a = 0
        while a < n - q:
            if words[a] != words[a + q]:
                a += 1
                continue
            b = a
            while b < n - q and words[b] == words[b + q]:
                b += 1
            part = words[a : b + q]
            if len(part) >= max(6, 4 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                found.append((a, b + q, q))
            a = b
    return sorted(found, key=lambda r: (r[0], r[2]))


def got(texts):
    known = {}
    ids = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
    return [[tuple(r) for r in x.tolist()] for x in runs.batch_runs(ids)]


def made(rng):
    """Words of few letters with repeated parts, nested repeats and noise."""
    letters = "abcdefghij"[: rng.randint(1, 10)]
    words = []
    while len(words) < rng.randint(0, 120):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            part = part * rng.randint(2, 5) + [rng.choice(letters)]
        part = part * rng.randint(1, 6)
        words += part[: rng.randint(1, len(part))]
        if rng.random() < 0.2 and len(words) > 8:
            words += words[rng.randint(0, len(words) - 8) :]
    return words[:400]


def test_runs_of_generated_texts():
    rng = random.Random(5)
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.randint(1, 12))]
        assert got(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("words", [
    [], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 5000, list("ab") * 4, list("ab") * 3 + ["a"], list("abc") * 4, list("abc") * 4 + list("ab"),
    (list("aab") * 4 + ["c"]) * 4, [str(i) for i in range(300)] * 5, [str(i) for i in range(50)] * 3,
])
def test_runs_of_given_texts(words):
    assert got([words, words[::-1]]) == [brute(words), brute(words[::-1])]


def test_a_fibonacci_word_and_few_letters():
    a, b = "a", "ab"
    while len(b) < 1200:
        a, b = b, b + a
    rng = random.Random(2)
    texts = [list(b), [rng.choice("ab") for _ in range(1500)], ["x"] + list("abcabd" * 200) + ["x"]]
    assert got(texts) == [brute(t) for t in texts]


def test_pairs_of_equal_texts_in_one_batch():
    text = list("abcde") * 6
    assert got([text, text, [], text]) == [[(0, 30, 5)], [(0, 30, 5)], [], [(0, 30, 5)]]


def expected(doc_id, text, periodic=True):
    words = (text or "").encode().split()
    if periodic and doc_id is not None and words:
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words) if len(words) < 3000 else got([words])[0]
    drop = {i for a, b, q in found for i in range(a + q, b)}
    best = min(((b - a, a, q) for a, b, q in found), key=lambda r: (-r[0], r[1], r[2]), default=None)
    longest = (best[1], best[0], best[2], 1000 * best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark, sf, texts):
    found = rows(QUERIES["op11_repair_runs"](spark, sf))
    assert found == sorted((expected(*t) for t in texts), key=str) and sum(1 for r in found if r[1]) > 10


def test_odd_rows(spark, odd, empty):
    for periodic in (False, True):
        found = rows(runs.document_runs(odd, periodic_end=periodic))
        assert found == sorted((expected(r["doc_id"], r["text"], periodic) for r in odd.collect()), key=str)
    assert rows(runs.document_runs(empty)) == []
    assert runs.document_runs(odd.withColumn("_r", F.lit(1)).withColumn("n_runs", F.lit(1))).count() == odd.count()
