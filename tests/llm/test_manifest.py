import hashlib
import zlib

import pytest

from talloom.llm import manifest
from talloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(hashes, at, found):
    """Root of a list of hashes, the siblings of place `at` on the way up, and what `found` folds to there."""
    proof = []
    while len(hashes) > 1:
        run = hashes[at // 8 * 8 : at // 8 * 8 + 8]
        k = at % 8
        proof += run[:k] + run[k + 1 :]
        found = H(*run[:k], found, *run[k + 1 :])
        hashes = [H(*hashes[i : i + 8]) for i in range(0, len(hashes), 8)]
        at //= 8
    return hashes[0], proof, found


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text). The same digest columns in plain Python."""
    leaf = [(r, H(*map(field, r)), H(*map(field, (*r[:4], r[4] and r[4].translate(LOWER))))) for r in rows]
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted((x for x in leaf if x[0][2] == g), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for g in langs}
    subroots = [climb([x[1] for x in trees[g]], 0, "")[0] for g in langs]
    out = []
    for n, g in enumerate(langs):
        for i, (r, own, low) in enumerate(trees[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            sub, proof, up = climb([x[1] for x in trees[g]], i, low if hit else own)
            root, more, up = climb(subroots, n, up)
            out.append((r[0], own, sub, root, H(*proof, *more), up, up == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = got(QUERIES["op13_merkle_climb"](spark, sf))
    assert found == brute(plain(docs)) and len({r[-1] for r in found}) == 2


def test_manifest_of_odd_rows(spark, odd, empty):
    assert got(manifest.document_manifest(odd)) == brute(plain(odd))
    assert got(manifest.document_manifest(empty)) == []


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9], [64, 1], [65, 8, 513], [1] * 70 + [80]])
def test_trees_of_any_shape(spark, sizes, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", 2)  # nodes with rows for several spans
    rows = [(1000 * g + i, "S", None if g == 3 else f"l{g}", i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(manifest.document_manifest(docs)) == brute(rows)
