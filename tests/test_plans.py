"""Shapes of physical plans: joins, exchanges, what is read."""

import re

import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
# These run streams or write tables when they are built; their plans only read results.
EAGER = re.compile("stream|read_sessions|read_rules|write_sessions|event_log|result_texts|session_catalog|quarantine|compress_sessions|compact_sessions|replies|pending|_open|late_results_late|note_changes|markdown_corpus")


def _plan(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", plan)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not EAGER.search(n)))
def test_no_cross_joins(spark, sf, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", _plan(spark, sf, name))


@pytest.mark.parametrize(
    "name, exchanges",
    [("parallel_batches", 1), ("streaks", 1), ("mode_as_of", 1), ("epochs", 1), ("retry_chains", 1), ("idle_sessions", 1),
     ("render_transcript", 1), ("byte_budget", 1), ("keep_recent", 1), ("compress", 2), ("budget_crossing", 1), ("compact", 1),
     ("match_rules", 0), ("html_to_text", 0), ("cost", 0)],
)
def test_exchanges(spark, sf, name, exchanges):
    plan = _plan(spark, sf, name)
    # The small side of a rule or price join and the spread of a tiny table do not count.
    found = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "hashpartitioning(tool" not in line]
    assert len(found) == exchanges, plan


def test_limits_before_the_shuffle(spark, sf):
    for name in ("grep_first_per_file", "pick_selected", "largest_calls"):
        assert re.search(r"WindowGroupLimit .*Partial", _plan(spark, sf, name))
    for name in ("grep_first_with_rest", "newest_orders"):
        assert "TakeOrderedAndProject" in _plan(spark, sf, name)


@pytest.mark.parametrize(
    "name, columns",
    [("parallel_batches", "event_id,ts,user_id,event_type"), ("message_counts", "conv_id"), ("category_counts", "event_type"),
     ("not_yet_seen", "doc_id,source"), ("distinct_seen", "user_id,event_type"), ("catalog_search", "p_partkey,p_name,p_type,p_size")],
)
def test_only_needed_columns_are_read(spark, sf, name, columns):
    assert f"FileScan parquet [{columns}]" in _plan(spark, sf, name)


def test_filters_reach_the_scan(spark, sf):
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in _plan(spark, sf, "last_text")
    assert "GreaterThan(p_size,25)" in _plan(spark, sf, "catalog_search")
