"""Work and memory of operators on larger tables, read off their plans."""

import re

from pyspark.sql import functions as F

from talloom.functions import frontmatter
from talloom.operators import catalog, compress, corpus, ordered, policy, usage
from talloom.session import literal_rows, reliable
from talloom.sources import definitions, notes


def test_recall_counts_pairs_where_their_doc_is(spark):
    asked = literal_rows(spark, [{"query_id": 1, "text": "red fox"}, {"query_id": 2, "text": "blue sky"}], "query_id bigint, text string")
    docs = spark.createDataFrame([(1, "the red fox"), (2, "red sky"), (2, "blue red"), (None, "fox fox"), (3, None)], "doc_id bigint, text string")
    best = corpus.recall_by_overlap(asked, docs, k=2)
    assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in best.collect()) == [(1, 1, 2, 1), (1, 2, 2, 2), (2, 2, 2, 1)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\((query_id.*?), \d+\)", plan)
    assert keys and not [k for k in keys if "doc_id" in k]


def test_few_removed_rows_are_broadcast(spark):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.without(rows, spark.range(5).withColumnRenamed("id", "doc_id"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan


def test_cycles_do_not_prolong_the_search(spark, monkeypatch):
    stored, store = [], usage.reliable
    monkeypatch.setattr(usage, "reliable", lambda df, *name: stored.append(1) or store(df, *name))
    rows = [(i, i - 1 if i % 10 else None, 1, i) for i in range(300)] + [(1000, 1001, 1, 1), (1001, 1000, 1, 1), (1002, 1001, 1, 1), (1003, 1003, 1, 1)]
    found = usage.tree_rollup(spark.createDataFrame(rows, "run_id bigint, parent_id bigint, in_tok bigint, out_tok bigint"))
    got = {r["run_id"]: (r["in_tok"], r["on_cycle"]) for r in found.collect()}
    assert got == {i: (10 - i % 10, False) for i in range(300)} | {i: (1, True) for i in range(1000, 1004)}
    assert len(stored) <= 6  # paths of ten runs and one round that ends none; before, as many rounds as the number of runs has bits


def test_repetitive_texts_are_dealt_by_their_own_size(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id % 20 AS session", "id AS seq", "'read_file' AS tool", "CAST(id % 3 AS STRING) AS path", "repeat('ab', 5000) AS text")
    gauge = spark.range(20).selectExpr("id AS session", "0.9D AS utilisation", "400 AS idle_seconds")
    whole = [sorted(f(rows, gauge, "session", ["seq"]).collect()) for f in (compress.snip_tier, compress.microcompact_tier, compress.compress)]
    monkeypatch.setattr(ordered, "TASK_BYTES", 1 << 18)
    for f, expected in zip((compress.snip_tier, compress.microcompact_tier, compress.compress), whole):
        for chunk_rows in (None, 3):
            found = f(rows, gauge, "session", ["seq"], chunk_rows=chunk_rows)
            assert ", 15), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(found.collect()) == expected


def test_calls_stay_where_they_are_while_they_are_judged(spark):
    calls = spark.range(50).selectExpr("id AS seq", "'write_file' AS tool", "concat('f', id % 5) AS value", "'default' AS mode")
    rules = spark.createDataFrame([("deny", "write_file", "f1")], "effect string, tool string, pattern string")
    existing = spark.createDataFrame([("f2",), ("f2",)], "path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = policy.decide(calls, rules, existing)
        plan, actions = found._jdf.queryExecution().executedPlan().toString(), {(r["value"], r["decision"]["action"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert actions == {("f0", "confirm"), ("f1", "deny"), ("f2", "allow"), ("f3", "confirm"), ("f4", "confirm")}
    assert "SortMergeJoin" not in plan


def test_header_pairs_are_made_once(spark):
    text = "---\nname: a\nname: b\ncontext: fork\nallowed-tools: x, y\n---\nbody"
    raw = literal_rows(spark, [{"layer": i, "folder": f"u/{i}", "text": x} for i, x in enumerate([text, None, "plain"])], "layer int, folder string, text string")
    found = definitions.parse_definitions(raw)
    assert {(r["name"], r["context"], r["template"]) for r in found.collect()} == {("b", "fork", "body"), ("1", "inline", None), ("2", "inline", "plain")}
    parsed = raw.select(frontmatter.parse_frontmatter(F.col("text")).alias("p"))
    assert parsed._jdf.queryExecution().analyzed().toString().count("substring_index") == 1

def test_tiny_files_are_listed_once_and_packed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "notes")
    files = spark.range(700).selectExpr("concat('f', id % 3) AS folder", "concat(id, '.md') AS file", "concat('text ', id) AS text")
    notes.write_note_files(files, folder)
    raw = notes.read_markdown_corpus(spark, folder)
    assert raw.rdd.getNumPartitions() <= 8 and raw.count() == 700
    index = reliable(notes.note_index(raw))
    notes.write_note_files(files.where("file < '10.md'").selectExpr("folder", "file", "IF(file = '0.md', NULL, concat(text, '!')) AS text"), folder)
    listed, list_files = [], notes._note_files
    monkeypatch.setattr(notes, "_note_files", lambda *a: listed.append(a) or list_files(*a))
    changes = notes.note_changes(spark, folder, index)
    assert sorted((r["path"].split("/")[-1], r["status"], r["text"]) for r in changes.collect()) == [("0.md", "removed", None), ("1.md", "changed", "text 1!")]
    assert len(listed) == 1
