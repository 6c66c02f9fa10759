"""Allow and deny rules, and the decision each call gets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.functions import predicates
from talloom.session import reliable, small_side

# The form of a rule, and the messages of a decision.
RULE_TEXT = r"^([a-z_]+)\((.+)\)$"
DENIED_BY_RULE = "Denied by permission rule for "
DENIED_EDIT = "Blocked in plan mode: "
DENIED_SHELL = "Shell commands blocked in plan mode"
DENIED_UNASKED = "Auto-denied (dontAsk mode): "
ASK_WRITE = "write new file: "
ASK_EDIT = "edit non-existent file: "
NO_VALUE = "undefined"


def parse_rules(rules: DataFrame) -> DataFrame:
    """Rows (effect, rule) as (effect, tool, pattern); a bare rule has no pattern."""
    tool = F.regexp_extract("rule", RULE_TEXT, 1)
    pattern = F.regexp_extract("rule", RULE_TEXT, 2)
    rest = [c for c in rules.columns if c != "rule"]
    return rules.select(
        *rest,
        F.when(tool != "", tool).otherwise(F.col("rule")).alias("tool"),
        F.when(tool != "", pattern).alias("pattern"),
    )


def match_rules(calls: DataFrame, rules: DataFrame, store: bool = False) -> DataFrame:
    """Adds `rule`: deny, allow or null. A deny rule beats an allow rule.

    calls(tool, value, ...), rules(effect, tool, pattern). Rules are an index: whole values, and prefixes without their
    star. Every distinct value is looked up as a whole and with the prefixes of the lengths that rules of its tool have,
    by an equi-join; so what a call costs follows from the number of these lengths, not of the rules. A shell call
    without a command has the empty one; other calls without a value meet every rule of their tool. store: keep what the
    values hit as a table, so that few of them are known to be few and calls stay where they are.
    """
    star = F.endswith("pattern", F.lit("*"))
    deny, allow = F.col("effect") == "deny", F.col("effect") == "allow"
    bare = F.col("pattern").isNull()
    tools = rules.groupBy("tool").agg(
        F.max(deny).alias("_has_deny"), F.max(allow).alias("_has_allow"),
        F.max(deny & bare).alias("_bare_deny"), F.max(allow & bare).alias("_bare_allow"),
        F.collect_set(F.when(star, F.length("pattern") - 1)).alias("_lengths"),
    )
    stem = F.when(star, F.substr("pattern", F.lit(1), F.length("pattern") - 1)).otherwise(F.col("pattern"))
    index = rules.where(~bare).groupBy("tool", (~star).alias("_whole"), stem.alias("_key")).agg(F.max(deny).alias("_deny"), F.max(allow).alias("_allow"))

    value = F.coalesce("value", F.lit(""))
    values = calls.select("tool", value.alias("_value")).distinct().join(small_side(tools.select("tool", "_lengths")), "tool")
    fitting = F.filter("_lengths", lambda n: n <= F.length("_value"))
    keys = F.concat(
        F.array(F.struct(F.lit(True).alias("_whole"), F.col("_value").alias("_key"))),
        F.transform(fitting, lambda n: F.struct(F.lit(False).alias("_whole"), F.substr("_value", F.lit(1), n).alias("_key"))),
    )
    found = values.select("tool", "_value", F.inline(keys)).join(small_side(index), ["tool", "_whole", "_key"])
    hits = found.groupBy(F.col("tool").alias("_tool"), "_value").agg(F.max("_deny").alias("_deny"), F.max("_allow").alias("_allow"))
    hits = small_side(reliable(hits, "hits")) if store else hits

    joined = calls.join(small_side(tools.drop("_lengths")), "tool", "left").join(hits, (F.col("tool") == F.col("_tool")) & (value == F.col("_value")), "left")
    every = (F.col("tool") != "run_shell") & (value == "")

    def holds(name: str) -> Column:
        parts = [F.col(f"_bare_{name}"), F.col(f"_{name}"), every & F.col(f"_has_{name}")]
        return F.exists(F.array(*[F.coalesce(p, F.lit(False)) for p in parts]), lambda x: x)

    rule = F.when(holds("deny"), "deny").when(holds("allow"), "allow")
    return joined.withColumn("rule", rule).select(*[F.col(f"`{c}`") for c in calls.columns if c != "rule"], "rule")


def decide(
    calls: DataFrame, rules: DataFrame, existing: DataFrame, plan_file: str | None = None,
    dangerous: Column | None = None,
) -> DataFrame:
    """Action and message for each call, by the first test that applies.

    calls(tool, value, mode, ...): value is the command of a shell call and the
    path of a file call. existing(path): paths that exist.
    """
    edit = F.col("tool").isin(*predicates.EDIT_TOOLS)
    shell = F.col("tool") == "run_shell"
    mode = F.col("mode")
    known = small_side(reliable(existing.select(F.col("path").alias("_path")).distinct().withColumn("_exists", F.lit(True)), "existing"))
    rows = match_rules(calls, rules, store=True)
    rows = rows.join(known, edit & (F.col("value") == F.col("_path")), "left")
    missing = F.col("_exists").isNull()
    if dangerous is None:
        dangerous = predicates.matches_any(F.col("value"))

    # a missing value is named as such, so that a question always has a text
    named = F.coalesce("value", F.lit(NO_VALUE))
    question = (
        F.when(shell & F.coalesce(dangerous, F.lit(False)), named)
        .when((F.col("tool") == "write_file") & missing, F.concat(F.lit(ASK_WRITE), named))
        .when((F.col("tool") == "edit_file") & missing, F.concat(F.lit(ASK_EDIT), named))
    )
    own_plan = F.lit(False) if plan_file is None else F.coalesce(F.col("value") == plan_file, F.lit(False))
    rows = rows.withColumn("_question", question)
    asked = F.col("_question")
    allow = _decision("allow")
    decision = (
        F.when(F.col("rule") == "deny", _decision("deny", F.concat(F.lit(DENIED_BY_RULE), "tool")))
        .when((mode == "plan") & edit & own_plan, allow)
        .when((mode == "plan") & edit, _decision("deny", F.concat(F.lit(DENIED_EDIT), "tool")))
        .when((mode == "plan") & shell, _decision("deny", F.lit(DENIED_SHELL)))
        .when(mode == "bypassPermissions", allow)
        .when(F.col("rule") == "allow", allow)
        .when(F.col("tool").isin(*predicates.READ_TOOLS), allow)
        .when(F.col("tool").isin("enter_plan_mode", "exit_plan_mode"), allow)
        .when((mode == "acceptEdits") & edit, allow)
        .when(asked.isNull(), allow)
        .when(mode == "dontAsk", _decision("deny", F.concat(F.lit(DENIED_UNASKED), asked)))
        .otherwise(_decision("confirm", asked))
    )
    return rows.withColumn("decision", decision).drop("_path", "_exists", "_question")


def _decision(action: str, message: Column | None = None) -> Column:
    message = F.lit(None).cast("string") if message is None else message
    return F.struct(F.lit(action).alias("action"), message.alias("message"))


def route(requests: DataFrame, tracks: Sequence[dict]) -> DataFrame:
    """The one track whose tests all hold; several give `ambiguous`, none `main`.

    requests(system, first_user, tools array); a track is a dict with name and any
    of match, first_user, tools. The tracks become one expression, not a join.
    """
    hits = []
    for track in tracks:
        if not track.get("match"):
            continue
        test = F.contains(F.col("system"), F.lit(track["match"]))
        if track.get("first_user"):
            test = test & F.contains(F.col("first_user"), F.lit(track["first_user"]))
        for tool in track.get("tools", ()):
            test = test & F.array_contains(F.col("tools"), tool)
        hits.append(F.when(test, F.lit(track["name"])))
    found = F.array_compact(F.array(*hits))
    chosen = F.when(F.size(found) > 1, "ambiguous").when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("main")
    return requests.withColumn("track", chosen).withColumn("tracks", found)
