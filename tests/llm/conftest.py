import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("fp", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("_row", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("hash", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in (
        "node _id _hash _spans _d _t _n epoch component_id spans text_hash size keys run leaf grp seen row idx items n tree ids fail_bits kept_sha256"
    ).split()],
])


@pytest.fixture(scope="session")
def tables(sf):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def texts(tables):
    return tables.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


ODD = [
    (None, "a row without an id, long enough to hold one window of fifty bytes for sure", "en", "s"),
    (None, None, None, None),
    (1, None, "en", "s"),
    (2, "", "en", "s"),
    (3, " \t\n ", "en", None),
    (4, "word", "en", "s"),
    (5, "two words", "de", "s"),
    (6, "same text in two rows, which is long enough to hold a window of fifty bytes", "en", "s"),
    (6, "same text in two rows, which is long enough to hold a window of fifty bytes", "en", "s"),
    (7, "same text in two rows, which is long enough to hold a window of fifty bytes", "en", "t"),
    (8, "über élan 日本語 <|endoftext|> ΣΑΣ İstanbul don't  é  x", "fr", "t"),
    (9, "the same nine words come back again and again " * 3000, "en", "s"),
    (10, "x" * 200_000, "en", "s"),
    (11, "héé" * 40, "fr", "s"),
    (12, "ohéé" * 40 + " tail", "fr", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    more = [f"own {f.name}" for f in DOCS.fields[5:]]
    rows = [(i, t, lang, source, None, *more) for i, t, lang, source in ODD]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
