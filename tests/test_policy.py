"""Rules against calls, by index and by trying every rule."""

import random

import pytest
from pyspark.sql import functions as F

from talloom.operators import policy


def applies(tool, value, pattern):
    value = value or ""
    if pattern is None or (tool != "run_shell" and not value):
        return True
    return value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern


@pytest.fixture(scope="module")
def generated():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab/*") for _ in range(rng.randint(0, 5)))
    rules = [(rng.choice(["deny", "allow"]), rng.choice(["run_shell", "read_file", "x"]), word() + rng.choice(["", "*"])) for _ in range(60)]
    rules += [("allow", "bare", None), ("deny", "bare", "a*"), ("deny", "bare", "a*"), ("allow", "run_shell", "*")]
    calls = [(i, rng.choice(["run_shell", "read_file", "x", "bare", "unruled", None]), rng.choice([None, "", word()])) for i in range(800)]
    return calls, [r for r in rules if r[2] != ""]


def test_index_finds_what_every_rule_finds(spark, generated):
    calls, rules = generated
    df = spark.createDataFrame(calls, "id long, tool string, value string").withColumns({"rule": F.lit("mine"), "_key": F.lit(1)})
    got = policy.match_rules(df, spark.createDataFrame(rules, "effect string, tool string, pattern string"))
    assert sorted(got.columns) == sorted(df.columns)
    found = {r["id"]: r["rule"] for r in got.collect()}
    want = {}
    for i, tool, value in calls:
        hits = {e for e, t, p in rules if t == tool and applies(tool, value, p)}
        want[i] = "deny" if "deny" in hits else "allow" if "allow" in hits else None
    assert found == want and set(want.values()) == {"deny", "allow", None}


def test_no_row_holds_all_rules_of_a_tool(spark, generated):
    calls, rules = generated
    plan = policy.match_rules(
        spark.createDataFrame(calls, "id long, tool string, value string"), spark.createDataFrame(rules, "effect string, tool string, pattern string")
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(CASE WHEN EndsWith" in plan and plan.count("collect_set") == plan.count("collect_set(CASE WHEN EndsWith")


def test_no_rules_and_no_calls(spark):
    rules = spark.createDataFrame([], "effect string, tool string, pattern string")
    calls = spark.createDataFrame([(1, "read_file", "a")], "id long, tool string, value string")
    assert [r["rule"] for r in policy.match_rules(calls, rules).collect()] == [None]
    assert policy.match_rules(calls.limit(0), rules).collect() == []
