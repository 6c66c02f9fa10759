"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talloom.llm import bitpack, bpe, forest, langid, manifest, mixing, quality, quantised, runs, sharding, simhash, suffixes, warc
from talloom.llm.common import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make

    return add


@_query("op1_quality_ledger", r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM cut, unnest(range(1, len(words) - 6)) t(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM wins) WHERE c > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
m AS (
  SELECT cut.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 5 * word_chars)::INT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars > 16 * n_words)::INT
    + 32 * (2 * word_chars < 3 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & 3) != 0 AS base_failed, fail_bits = 0 AS kept FROM judged
""")
def op1_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(_table(spark, folder, "documents")), quality.PRODUCTION)


@_query("op2_simhash_pivots")
def op2_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query("op3_suffix_intervals")
def op3_suffix_intervals(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.duplicate_spans(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query("op4_warc_segments", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id != last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id != last THEN last END AS refers_to
FROM p
""")
def op4_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


@_query("op5_minimax_shards")
def op5_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


@_query("op6_prefix_forest")
def op6_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: Weights of the mixing query and of the pipeline: languages level with each other except for English, sources alike.
MIX_WEIGHTS = {"lang": {"en": 3.0}, "domain": {"crawl": 2.0, "curated": 3.0}}


def mix_domain():
    """Top of the source tree: the one large crawl, and everything else."""
    return F.when(F.col("source") == "src0", "crawl").otherwise("curated")


def _level(depth: int, weight: str, given: str) -> str:
    """Two CTEs that share the budget of one tree level: nodes, and nodes with `budget`."""
    path, up = ("domain", "lang", "source")[:depth], ("domain", "lang", "source")[: depth - 1]
    names = ", ".join(path)
    family = f"PARTITION BY {', '.join(up)}" if up else ""
    join = f"JOIN b{depth - 1} USING ({', '.join(up)})" if up else ", goal"
    return f"""
n{depth} AS (
  SELECT {names}, CAST(4 * sum(leaf.tokens) AS BIGINT) AS cap, CAST(sum(leaf.tokens) AS BIGINT) AS tokens, any_value(CAST({weight} AS DOUBLE)) AS w,
         any_value({given}) AS given FROM leaf {join} GROUP BY {names}),
s{depth} AS (
  SELECT *, cap / w AS ratio, CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS used,
         sum(w) OVER ({family}) - coalesce(sum(w) OVER b, 0) AS room
  FROM n{depth} WINDOW b AS ({family} ORDER BY cap / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l{depth} AS (
  SELECT *, max(CASE WHEN ratio * room + used > given THEN (given - used) / room END) OVER ({family}) AS level FROM s{depth}),
b{depth} AS (SELECT {names}, tokens, least(cap, CAST(floor(coalesce(level * w, cap)) AS BIGINT)) AS budget FROM l{depth})"""


@_query("op7_hierarchical_mix", r"""
WITH d AS (
  SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, md5(coalesce(text, '')) AS h FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY ALL),
goal AS (SELECT CAST(trunc(CAST(0.8 AS DOUBLE) * sum(tokens)) AS BIGINT) AS goal FROM leaf),"""
+ _level(1, "CASE domain WHEN 'crawl' THEN 2 ELSE 3 END", "goal.goal") + ","
+ _level(2, "CASE lang WHEN 'en' THEN 3 ELSE 1 END", "b1.budget") + ","
+ _level(3, "1", "b2.budget") + """,
share AS (SELECT *, CAST(floor(budget / tokens) AS BIGINT) AS whole FROM b3 WHERE tokens > 0),
k AS (
  SELECT doc_id, d.lang, d.source, domain, n, whole, budget - whole * tokens AS rest,
         CAST('0x' || substr(md5(concat_ws(':', '17', whole, doc_id, h)), 1, 15) AS BIGINT) AS key
  FROM d JOIN share USING (domain, lang, source)),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k),
copies AS (SELECT doc_id, lang, source, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, lang, source, CAST(unnest(range(copies)) AS INTEGER) AS epoch FROM copies
""")
def op7_hierarchical_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"), 0.8, 4, MIX_WEIGHTS, mix_domain())
    return mixed.select("doc_id", "lang", "source", "epoch")


@_query("op8_forced_boundary_bpe")
def op8_forced_boundary_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, folder, "documents"))


@_query("op9_bit_packed_ids")
def op9_bit_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bitpack.round_trip(_table(spark, folder, "documents"))


@_query("op10_fused_language")
def op10_fused_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "pages"), _table(spark, folder, "documents"))


@_query("op11_repair_runs")
def op11_repair_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.document_runs(_table(spark, folder, "documents"), periodic_end=True)


@_query("op12_quantised_links")
def op12_quantised_links(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.near_duplicates(_table(spark, folder, "embeddings"))


def _tree_level(k: int) -> str:
    """CTEs for one level of the manifest's trees: runs of eight, and the nodes above them."""
    return f"""
r{k} AS (SELECT tree, n, idx // 8 AS run, list(hash ORDER BY idx) AS hs FROM t{k} GROUP BY ALL),
t{k + 1} AS (SELECT tree, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n, run AS idx,
         CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS hash FROM r{k})"""


def _fold_level(k: int) -> str:
    """One step of every leaf: the run's other hashes join the proof, and the hash so far takes its place among them."""
    return f"""
f{k + 1} AS (
  SELECT doc_id, leaf, f.tree, f.idx // 8 AS idx,
         CASE WHEN n > 1 THEN sha256(array_to_string(hs[1:f.idx % 8] || [fold] || hs[f.idx % 8 + 2:], '')) ELSE fold END AS fold,
         CASE WHEN n > 1 THEN proof || array_to_string(hs[1:f.idx % 8] || hs[f.idx % 8 + 2:], '') ELSE proof END AS proof
  FROM f{k} f JOIN r{k} r ON r.tree = f.tree AND r.run = f.idx // 8)"""


#: Levels that the SQL spells out: 8 ** 8 documents of a language.
_LEVELS = 8
_FIELDS = "concat({})".format(", ".join(
    f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
))


def _tree_sql() -> str:
    folds = ",".join(_fold_level(k) for k in range(_LEVELS))
    trees = ",".join(_tree_level(k) for k in range(_LEVELS))
    upper = ",".join(_tree_level(k) for k in range(100, 100 + _LEVELS))
    climbs = ",".join(_fold_level(k) for k in range(100, 100 + _LEVELS))
    return f"""
WITH crc AS (
  SELECT DISTINCT doc_id, xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || range(8)::UBIGINT[], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END)),
    CAST(4294967295 AS UBIGINT)) AS crc FROM documents WHERE doc_id IS NOT NULL),
d AS (
  SELECT doc_id, lang, sha256({_FIELDS.format(text='text')}) AS leaf, sha256({_FIELDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
l AS (
  SELECT d.doc_id, leaf, CASE WHEN crc % 3 = 0 THEN low ELSE leaf END AS seen, tree, row_number() OVER (PARTITION BY tree ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n
  FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang LEFT JOIN crc ON crc.doc_id = d.doc_id),
t0 AS (SELECT tree, n, idx, leaf AS hash FROM l),{trees},
t100 AS (SELECT 0 AS tree, count(*) OVER () AS n, tree AS idx, hash FROM t{_LEVELS}),{upper},
f0 AS (SELECT doc_id, leaf, tree, idx, seen AS fold, '' AS proof FROM l),{folds},
f100 AS (SELECT doc_id, leaf, 0 AS tree, f.tree AS idx, fold, proof FROM f{_LEVELS} f),{climbs},
s AS (SELECT l.doc_id, l.leaf, t.hash AS subroot FROM l JOIN t{_LEVELS} t USING (tree))
SELECT DISTINCT f.doc_id, f.leaf, subroot, t.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.hash AS verified
FROM f{100 + _LEVELS} f JOIN s ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.leaf = f.leaf, t{100 + _LEVELS} t
"""


@_query("op13_merkle_climb", _tree_sql())
def op13_merkle_climb(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.document_manifest(_table(spark, folder, "documents"))
