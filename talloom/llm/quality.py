"""Quality rules as a bitmask ledger: measure once, judge by masks afterwards.

`ledger` evaluates every rule once per text and stores one failure bit per rule beside the measurements. A policy is a
version and a mask: judging a ledger, or comparing policies, never touches texts again. Ablations come from one
bitwise aggregation over the distinct bit patterns, of which there are at most two to the number of rules.

Defined cases: a null or empty text has no words and fails `few_words`; repeated rows and equal ids are judged row by
row; a null id stays null; other columns are neither read nor returned; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import SPACE, let

WINDOW = 8

#: Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

#: Rule name and the condition under which measurements fail it. The position is the bit. New rules go at the end, so
#: that stored ledgers and policies keep their meaning.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("few_words", lambda m: m["n_words"] < MIN_WORDS),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 5 * m["word_chars"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    ("long_words", lambda m: m["word_chars"] > 16 * m["n_words"]),
    ("short_words", lambda m: 2 * m["word_chars"] < 3 * m["n_words"]),
]


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


def mask_of(*names: str) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in names)


BASE = Policy("base", mask_of("few_words", "repeated_windows"))
PRODUCTION = Policy("2", mask_of(*[name for name, _ in RULES]))


def _repeated(words: Column) -> Column:
    """Words covered by a window of eight words that occurs twice or more. Neighbours in the sorted windows decide."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("i")),
    )

    def same(a: Column, b: Column) -> Column:
        equal = (a["h"] == b["h"]) & (F.slice(words, a["i"], WINDOW) == F.slice(words, b["i"], WINDOW))
        return F.coalesce(equal, F.lit(False))

    def places(order: Column) -> Column:
        found = F.filter(order, lambda x, j: same(F.get(order, j - 1), x) | same(x, F.get(order, j + 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(F.sort_array(windows), places), covered)


def measured(text: Column) -> Column:
    """Measurements and `fail_bits` of a text as one struct.

    Words, lines and window hashes are bound inside the expression. As columns of their own they would be copied into
    every place that uses them once a filter on the verdict is pushed below them.
    """
    body = F.coalesce(text, F.lit(""))

    def judge(m: Column) -> Column:
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
        bits = F.lit(0).cast("long")
        for k, (_, fails) in enumerate(RULES):
            bits = bits.bitwiseOR(F.when(fails(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[n].alias(n) for n in names], bits.alias("fail_bits"))

    def measure(words: Column, lines: Column, hashes: Column) -> Column:
        # only texts in which some hash comes twice can hold a repeated window
        twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return let(F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(twice, _repeated(words)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        ), judge)

    def hashes(words: Column) -> Column:
        count = F.size(words) - (WINDOW - 1)
        every = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        return F.when(count >= 1, every).otherwise(F.array().cast("array<bigint>"))

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.array_remove(F.split(body, SPACE), ""),
        lambda words: let(lines, lambda l: let(hashes(words), lambda h: measure(words, l, h))),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: measurements and `fail_bits`, bit k set if rule k fails."""
    book = docs.select(F.col(f"`{id_col}`").alias("doc_id"), measured(F.col(f"`{text}`").cast("string")).alias("m"))
    return book.select("doc_id", "m.*")


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The ledger with the verdicts of the base rules and of one policy."""
    return book.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy)})


def ablation(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """What each rule of a policy does: rows failing it, rows failing only it, rows kept with and without it."""
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = book.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"))
        for k, (name, _) in enumerate(RULES) if policy.mask >> k & 1
    ])
    each = patterns.select("bits", "n", F.inline(rules))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: Policy = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with their own columns only. No shuffle and nothing stored."""
    bits = measured(F.col(f"`{text}`").cast("string"))["fail_bits"]
    return docs.where(bits.bitwiseAND(F.lit(policy.mask | BASE.mask).cast("long")) == 0)
