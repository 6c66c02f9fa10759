"""Archives, language identification and vectors against brute force, and odd input."""

import hashlib
import html
import math
import random
import re
import time

import numpy as np
import pytest

from talloom.llm import forest, langid, queries, warc
from talloom.session import scratch_path

PAGES = "page_id long, url string, html string, digest string, refers string, host string"
BIG = "<p>Grüße</p>\r\n\r\n" * 4000


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (None, None, None), (None, "http://a.de/x", BIG), (1, None, BIG), (2, "u\r\nX: y", BIG), (2, "u", BIG), (3, "", ""), (4, "WARC/1.1\r\n", None),
        (5, "http://h/", "x" * 1000), (6, "http://h/", "x" * 1000), (7, "http://h/", "x" * 999), (8, "http://h/", "x" * 999), (9, "http://h/", "\r\n0\r\n\r\n"),
    ]
    return spark.createDataFrame([(*r, "d", "r", "h") for r in rows], PAGES)


# 4 -------------------------------------------------------------------------------------------------------------------


def test_archives_of_odd_pages(spark, odd_pages, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    found = {(r["page_id"], r["payload_digest"]): r for r in warc.round_trip(odd_pages).collect()}
    rows = {(r["page_id"], hashlib.sha1((r["html"] or "").encode()).hexdigest()): (r["html"] or "").encode() for r in odd_pages.collect()}
    assert found.keys() == rows.keys()
    for key, payload in rows.items():
        assert found[key]["payload_bytes"] == len(payload)
        last = max((i for (i, d) in rows if d == key[1] and i is not None), default=None)
        again = len(payload) >= 1000 and last is not None and key[0] != last
        assert (found[key]["record_type"], found[key]["refers_to"]) == (("revisit", last) if again else ("response", None))


def test_every_page_row_comes_back(spark, odd_pages):
    """Rows that repeat their id and payload, with other addresses or not, and rows without ids."""
    big = "<p>" + "x" * 40_000
    rows = [(1, "http://a/", "p"), (1, "http://b/", "p"), (1, "http://a/", "p"), (None, "u", "p"), (None, "v", "p"), (2, "u", big), (2, "v", big), (1, "w", big), (None, "w", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.round_trip(pages).collect()
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in found))
    want = [(i or 0, len(h), "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else 0) for i, _, h in rows]
    assert got == sorted(want)
    assert warc.round_trip(odd_pages.unionByName(odd_pages)).count() == 2 * odd_pages.count()


@pytest.mark.parametrize("page", ["<script a ", "<!-- x ", "<style>", "<", "<a ", "</script ", "<!--", "<script></scrip"])
def test_unclosed_markup_takes_linear_time(page):
    whole = page * (5_000_000 // len(page))
    start = time.perf_counter()
    langid.visible(whole)
    assert time.perf_counter() - start < 20


def test_visible_text_is_what_the_pattern_leaves():
    hidden = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    rng, parts = random.Random(3), ["<script>", "</script>", "</SCRIPT >", "<style", "</style>", "<!--", "-->", "<", ">", "a", " ", "<p>", "--", "<scripted>", "&amp;"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert langid.visible(page) == html.unescape(hidden.sub(" ", page)), page


def test_segments_are_checked(spark, odd_pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(odd_pages, path)
    records = warc.read_records(spark, path)
    assert records.where("segment IS NOT NULL").count() > 3
    whole = warc.reassembled(records).collect()
    assert whole and all(warc.payload_of(r["block"]).decode() == BIG for r in whole)
    lost = warc.reassembled(records.where("segment IS NULL OR segment != 2")).collect()
    assert len(lost) == len(whole) and all(r["block"] is None for r in lost)
    cut = warc.reassembled(records.where("total IS NULL")).collect()
    assert all(r["block"] is None for r in cut)


@pytest.mark.parametrize("body", [b"", b"a", b"x" * 10_000, b"\r\n\r\n0\r\n"])
def test_framing(body):
    assert warc.unframed(warc.framed(body)) == body
    assert warc.unframed(warc.framed(body)[:-2]) is None


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------


def plain_nearest(ids, matrix, query, k=20):
    scores = matrix @ matrix[list(ids).index(query)]
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != query][:k]
    return [(int(ids[j]), float(scores[j])) for j in order]


def test_recall(spark, sf, tables):
    rows = tables.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found = {}
    for r in queries.op6_prefix_forest(spark, sf).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for query in ids[ids % 20 == 0]:
        want = plain_nearest(ids, matrix, query)
        got = found[int(query)]
        assert sorted(got) == list(range(1, 21))
        hits += len({v for v, _ in got.values()} & {v for v, _ in want})
        total += len(want)
    assert hits / total >= 0.95


def test_clusters_stop_at_long_prefixes(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELL_ROWS", 64)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    matrix = np.repeat(centres, 50, axis=0) + 0.05 * rng.standard_normal((2000, 16))
    matrix *= rng.uniform(0.5, 2.0, (2000, 1))  # lengths matter for the inner product
    frame = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    found = {}
    for r in forest.nearest(frame, frame.where("vec_id % 100 = 0"), 10).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    ids = np.arange(2000)
    hits = [len(set(found[q]) & {v for v, _ in plain_nearest(ids, matrix, q, 10)}) / 10 for q in range(0, 2000, 100)]
    assert np.mean(hits) >= 0.9


def test_odd_vectors(spark):
    good = [(k, [1.0, float(k % 5), 0.5]) for k in range(100)]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [math.nan, 1.0, 1.0]), (204, [math.inf, 1.0, 1.0]), (205, [1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    rows = forest.nearest(frame, frame.where("vec_id % 20 = 0 OR vec_id > 150"), 20).collect()
    assert {r["query_id"] for r in rows} == {0, 20, 40, 60, 80}
    ids, matrix = np.arange(100), np.array([v for _, v in good])
    for query in (0, 20):
        got = [(r["vec_id"], r["score"]) for r in sorted((r for r in rows if r["query_id"] == query), key=lambda r: r["rank"])]
        assert got == plain_nearest(ids, matrix, query)
    few = forest.nearest(frame.where("vec_id < 5"), frame.where("vec_id = 0"), 20).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == plain_nearest(ids[:5], matrix[:5], 0)
    assert forest.nearest(frame.where("vec_id > 1000"), frame, 20).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------


def test_language_of_pages(spark, sf, tables):
    truth = {i: re.match(r"https?://[^/]*/([a-z]{2})/", u)[1] for i, u in tables.sql("SELECT page_id, url FROM pages").fetchall()}
    rows = queries.op10_fused_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert np.mean([r["lang"] == truth[r["page_id"]] for r in rows]) > 0.98


def test_weak_text_leans_on_other_evidence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 2000").collect()}
    pages = [(k, f"http://h{k % 3}.{lang}/p", f"<html lang='{lang}'><body>{texts[lang][:1500]}</body>") for k, lang in enumerate(["de", "fr"] * 30)]
    pages += [(100, "http://h0.de/q", "<html lang='de'><p>x</p>"), (101, "http://new.fr/", None), (102, None, None), (103, "no url", ""), (103, "no url", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in langid.identify(frame, docs).collect()}
    assert len(found) == 64
    assert all(found[k]["lang"] == lang for k, lang in enumerate(["de", "fr"] * 30))
    assert found[100]["lang"] == "de" and found[101]["lang"] == "fr"
    assert 0 < found[102]["confidence"] <= 1


def test_language_without_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert langid.identify(pages, docs.limit(0)).where("lang IS NOT NULL").count() == 0


def test_fused_language_against_plain_python(spark, sf):
    """Every page's posterior, from counts kept in dictionaries."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert len(docs) <= langid.SAMPLE_ROWS
    langs = sorted({lang for lang, text in docs if lang is not None and text is not None})
    counts = {lang: [0.5] * langid.BUCKETS for lang in langs}
    for lang, text in docs:
        for at in langid.trigrams(text) if lang in counts and text is not None else ():
            counts[lang][at] += 1
    logs = {lang: [math.log(c / sum(counts[lang])) for c in counts[lang]] for lang in langs}

    def softmax(scores):
        powers = [math.exp(s - max(scores)) for s in scores]
        return [p / sum(powers) for p in powers]

    rows = []
    for page, url, body in pages:
        found = langid.trigrams(langid.visible(body)).tolist()
        text = [min(30, len(found)) * sum(logs[lang][at] for at in found) / len(found) if found else 0.0 for lang in langs]
        host = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", (url or "").lower())
        host = host[1] if host else ""
        said = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", body or "", re.I | re.S)
        rows.append((page, text, softmax(text), host, ".".join(host.split(".")[-2:]), host.split(".")[-1], said[1].lower() if said else ""))
    n, add = len(langs), lambda beliefs: [sum(x) for x in zip(*beliefs)]
    whole = add(r[2] for r in rows)
    world = [(w + 1) / (sum(whole) + n) for w in whole]
    by = [{v: add(r[2] for r in rows if r[k] == v) for v in {r[k] for r in rows}} for k in range(3, 7)]

    def likelihood(c):
        return [math.log((x + world[k]) / (whole[k] + 1) / ((sum(c) + 1) / (sum(whole) + 1))) for k, x in enumerate(c)]

    made = {r["page_id"]: r for r in queries.op10_fused_language(spark, sf).collect()}
    assert len(made) == len(rows)
    for page, text, belief, host, site, suffix, said in rows:
        above = [(c + 5 * w) / (sum(by[1][site]) + 5) for c, w in zip(by[1][site], world)]
        rest = [max(c - b, 0) for c, b in zip(by[0][host], belief)]
        prior = [math.log((c + 5 * a) / (sum(rest) + 5)) for c, a in zip(rest, above)]
        posterior = softmax([sum(x) for x in zip(text, prior, likelihood(by[3][said]), likelihood(by[2][suffix]))])
        best = max(posterior)
        assert abs(made[page]["confidence"] - best) < 1e-3, page
        assert best - posterior[langs.index(made[page]["lang"])] < 1e-3, page
        assert (made[page]["declared"], made[page]["host"]) == (said, host)
