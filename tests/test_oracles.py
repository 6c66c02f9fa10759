"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["session", "batches", "calls", "cost"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["html_to_text", "apply_edits", "decide", "compress", "mode_as_of", "recall_by_overlap"])
def test_check_notices_a_change(spark, sf, con, name):
    """A check must fail when the result of the operator is changed."""
    from pyspark.sql import functions as F

    df = QUERIES[name](spark, sf)
    column = next((f.name for f in df.schema if f.dataType.simpleString() == "string"), df.columns[-1])
    kind = df.schema[column].dataType.simpleString()
    changed = df.withColumn(column, F.lit("x") if kind == "string" else (F.col(column) + 1).cast(kind))
    assert compare(changed, con, ORACLES[name]) != []


@pytest.mark.parametrize("name", ["parallel_batches", "compact", "concat_dir", "budget_crossing", "stale_writes", "compress"])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partition_count_does_not_matter(spark, sf, con, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


SPLIT = [
    "parallel_batches", "budget_crossing", "streaks", "confirm_once", "epochs", "first_user_flag", "mode_as_of",
    "stale_writes", "keep_recent", "superseded_reads", "snip_tier", "microcompact_tier", "compress", "compact",
    "retry_chains", "late_results", "idle_sessions", "concat_dir", "build_index_newest", "render_transcript",
    "tool_sequence", "byte_budget", "mark_last_block", "recall_context", "catalog_sections", "compare_runs",
]


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups_give_the_same_rows(spark, sf, con, name, monkeypatch):
    """Cut every group into chunks of a few rows, as happens to hot groups at scale."""
    from talloom.operators import ordered

    monkeypatch.setattr(ordered, "must_split", lambda df: True)
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 5)
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) == []
