"""Running values over one hot group, in one piece and in chunks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talloom.operators import ordered
from talloom.operators.ordered import Ordered, concat_parts, last_before, last_upto, previous, running_count, running_max, running_sum


@pytest.fixture(scope="module")
def rows(spark):
    """Two thirds of the rows belong to key 0; key null has some as well."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0).when(F.col("id") < 2100, F.lit(None)).otherwise(F.pmod(F.col("id"), F.lit(40)) + 1).alias("k"),
        F.floor(F.pmod(F.xxhash64("id"), F.lit(500))).cast("bigint").alias("t"),
        "id",
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0, F.col("id")).alias("v"),
    )
    return df


def _values():
    return {
        "s": running_sum(F.col("v")),
        "s0": running_sum(F.col("v"), inclusive=False),
        "n": running_count(),
        "up": last_upto(F.col("v")),
        "bef": last_before(F.col("v")),
        "prev": previous(F.col("v")),
        "mx": running_max(F.col("v")),
    }


def _expected(rows):
    pdf = rows.toPandas().sort_values(["k", "t", "id"])
    out = []
    for _, g in pdf.groupby("k", dropna=False, sort=False):
        v = g["v"]
        filled = v.fillna(0)
        out.append(g.assign(
            s=filled.cumsum(), s0=filled.cumsum() - filled, n=range(1, len(g) + 1), up=v.ffill(), bef=v.ffill().shift(),
            prev=v.shift(), mx=v.cummax().ffill(),
        ))
    return pd.concat(out).sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("chunk_rows", [None, 7, 100, 10**9])
def test_running_values(rows, chunk_rows):
    got = Ordered(rows, ["k"], ["t", "id"], chunk_rows).with_running(**_values()).frame().toPandas()
    got = got.sort_values("id").reset_index(drop=True)
    want = _expected(rows)
    for name in _values():
        pd.testing.assert_series_equal(got[name].astype("float64"), want[name].astype("float64"), check_names=False)


@pytest.mark.parametrize("chunk_rows", [None, 20])
def test_totals_and_chaining(rows, chunk_rows):
    o = Ordered(rows, ["k"], ["t", "id"], chunk_rows).with_running(n=running_count()).with_total(all=F.lit(1))
    o = o.with_column("even", F.when(F.col("n") % 2 == 0, F.col("n"))).with_running(last_even=last_upto(F.col("even")))
    got = o.frame()
    assert got.filter("last_even <> floor(n / 2) * 2 OR (n > 1 AND last_even IS NULL)").count() == 0
    sizes = got.groupBy("k").agg(F.max("n").alias("n"), F.max("all").alias("all")).filter(F.col("k").isNotNull())
    assert sizes.filter("n <> all").count() == 0


def test_chunks_are_cut_and_bounded(rows):
    o = Ordered(rows, ["k"], ["t", "id"], 50)
    sizes = o.df.groupBy("k", "_chunk").count().filter("k = 0")
    assert sizes.count() > 10
    assert sizes.agg(F.max("count")).first()[0] < 600


def test_many_borders_without_broadcast(rows, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_BROADCAST_ROWS", 3)
    got = Ordered(rows, ["k"], ["t", "id"], 20).with_running(n=running_count()).frame()
    assert got.groupBy("k").agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("c")).filter("m <> c").count() == 0


@pytest.mark.parametrize("chunk_rows", [None, 30])
def test_parts_join_to_the_whole(rows, chunk_rows):
    parts = concat_parts(rows.filter("k IS NOT NULL"), ["k"], ["t", "id"], F.col("id").cast("string"), ",", 200, chunk_rows=chunk_rows)
    got = parts.toPandas()
    assert got["text"].map(lambda x: len(x.encode())).max() < 210
    pdf = rows.filter("k IS NOT NULL").toPandas().sort_values(["k", "t", "id"])
    want = pdf.groupby("k")["id"].agg(lambda s: ",".join(map(str, s)))
    for k, g in got.groupby("k"):
        assert ",".join(g.sort_values("part")["text"]) == want[k]


def test_both_forms_have_the_same_types(rows):
    values = {
        "d": running_sum(F.col("id").cast("decimal(18,6)")), "f": running_sum(F.col("id").cast("float")), "i": running_sum(F.col("id").cast("int")),
        "p": previous(F.col("v").cast("decimal(10,2)")), "m": running_max(F.col("id").cast("smallint")),
    }
    totals = {"t": F.col("id").cast("decimal(18,6)"), "n": F.lit(1)}
    one, cut = (Ordered(rows, ["k"], ["t", "id"], c).with_running(**values).with_total(**{f"all_{n}": v for n, v in totals.items()}).frame() for c in (None, 50))
    assert one.schema.simpleString() == cut.schema.simpleString()
    assert one.select("id", "d", "i", "p", "m", "all_t").exceptAll(cut.select("id", "d", "i", "p", "m", "all_t")).isEmpty()


def test_tiers_share_their_borders(spark, monkeypatch):
    """The three tiers over cut sessions: one search for borders, and rows and types of the plain form."""
    from talloom.operators import compress

    results = spark.range(900).select(
        F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 5).alias("session"), "id", F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(9))).alias("path"),
        F.when(F.col("id") % 3 == 0, "read_file").when(F.col("id") % 3 == 1, "grep_search").otherwise("write_file").alias("tool"),
        F.repeat(F.lit("text "), (F.col("id") % 40).cast("int")).alias("text"),
    )
    gauge = spark.range(5).select(F.col("id").alias("session"), (F.col("id") / 5 + 0.3).alias("utilisation"), (F.col("id") % 2 * 400 + 100).alias("idle_seconds"))
    found = []
    search = Ordered._borders
    monkeypatch.setattr(Ordered, "_borders", lambda self, *a: found.append(1) or search(self, *a))
    one, cut = (compress.compress(results, gauge, "session", ["id"], wide=120, tight=90, chunk_rows=c) for c in (None, 20))
    assert len(found) == 1 and one.schema.simpleString() == cut.schema.simpleString()
    assert one.exceptAll(cut).isEmpty() and cut.exceptAll(one).isEmpty() and one.select("text").distinct().count() > 20
