"""Language identification of pages by fusing four kinds of evidence.

Text: a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of labelled documents (`SAMPLE_ROWS`).
Declared markup language, address suffix and host: how much they say is learnt from all pages by grouped aggregation of
the text model's posteriors, so a suffix or attribute that does not go with the language weighs nothing. Host priors
are smoothed toward the registered domain, and that toward the whole corpus, and leave the page's own text out.

Everything after the text model is DataFrame code; tables per host, suffix and declaration are summed before any shuffle and
joined without hints, so a hot host is a skewed join that adaptive execution splits.

Defined cases: null or empty html says nothing, the other evidence decides; a null or odd url has no host and suffix; an unknown
or missing declaration counts as a value of its own; repeated rows are judged alike; without labelled documents there is
no language to choose and `lang` is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talloom.llm.common import let, prepared, stored

#: Labelled documents the text model is fitted on, those of smallest id hash. More rows bring no accuracy here.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 15
#: Neighbouring trigrams overlap, so a page's evidence counts as that of this many independent trigrams at most.
TEXT_WEIGHT = 30.0
#: Pages' worth of trust in the level above.
HOST_SMOOTHING = 5.0
TABLE_SMOOTHING = 1.0

_HIDING = re.compile(r"<(script|style)\b", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}


def visible(page: str | None) -> str:
    """Text of a page without markup, scripts, styles and comments.

    One pass forward. A script, style or comment that is never closed is a tag like others, and a tag without its end is
    text. An end that is not found is not looked for again, so unclosed markup takes no longer than any other.
    """
    if not isinstance(page, str):
        return ""
    out, at, comments, open_ = [], 0, True, dict(_CLOSING)
    while (begin := page.find("<", at)) >= 0:
        end = 0
        if (tag := _HIDING.match(page, begin)) and (name := tag[1].lower()) in open_:
            if close := open_[name].search(page, tag.end()):
                end = close.end()
            else:
                del open_[name]
        elif comments and page.startswith("<!--", begin):
            end = page.find("-->", begin + 4) + 3
            if end == 2:
                end, comments = 0, False
        end = end or page.find(">", begin + 1) + 1
        if not end:
            break
        out += page[at:begin], " "
        at = end
    out.append(page[at:])
    return markup.unescape("".join(out))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text."""
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    return (mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language x bucket) from at most `rows` labelled documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                totals[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})

    labelled = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    place = F.xxhash64("doc_id")
    # the last place of the sample is found over ids alone; rows that share an id are taken or left together
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    last = usable.select(place.alias("place")).orderBy("place").limit(rows).agg(F.max("place")).first()[0]
    sample = usable.where(place <= F.lit(last).cast("long"))
    counts = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _softmax(scores: Column) -> Column:
    top = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return let(let(scores, top), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(column, k)) for k in range(n)])


def _vector(*parts: Column) -> Column:
    """Sum of arrays, element by element."""
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda a, b: a + b)
    return out


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, site, suffix, declared, and the text's log likelihoods and posterior."""

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            at = trigrams(visible(text))
            out.append(table[:, at].mean(axis=1).astype(float) * min(TEXT_WEIGHT, len(at)) if len(at) else np.zeros(len(langs)))
        return pd.Series(out)

    url, body = F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), F.col("html").cast("string")
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    said = F.regexp_extract(body, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    rows = pages.select(F.col("page_id"), host.alias("host"), F.lower(F.coalesce(said, F.lit(""))).alias("declared"), score(body).alias("text"))
    return rows.withColumns({
        "site": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1), "belief": _softmax(F.col("text")),
    })


def identify(pages: DataFrame, docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, lang, confidence, and the text's own choice `text_lang` beside the declared language and host."""
    prepared(pages.sparkSession)
    langs, table = fit(docs, rows)
    n = len(langs)
    if not n:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))
    seen = stored(evidence(pages, langs, table), "evidence")
    whole = seen.agg(_sums("belief", n).alias("all")).first()["all"]
    total = sum(x or 0.0 for x in whole) or 1.0
    world = F.array(*[F.lit(((x or 0.0) + 1.0) / (total + n)) for x in whole])

    def likelihood(column: str) -> DataFrame:
        """log of P(value | language) against P(value): nothing where they agree."""
        counts = seen.groupBy(column).agg(_sums("belief", n).alias("c"))
        own = lambda k: (F.get("c", k) + TABLE_SMOOTHING * world[k]) / F.lit((whole[k] or 0.0) + TABLE_SMOOTHING)
        base = (F.aggregate("c", F.lit(0.0), lambda a, x: a + x) + TABLE_SMOOTHING) / (total + TABLE_SMOOTHING)
        return counts.select(column, F.array(*[F.log(own(k) / base) for k in range(n)]).alias(f"by_{column}"))

    def smoothed(counts: Column, above: Column) -> Column:
        return F.zip_with(counts, above, lambda c, p: (c + HOST_SMOOTHING * p) / (F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + HOST_SMOOTHING))

    sites = seen.groupBy("site").agg(_sums("belief", n).alias("c")).select("site", smoothed(F.col("c"), world).alias("above"))
    hosts = seen.groupBy("host", "site").agg(_sums("belief", n).alias("c")).join(sites, "site").select("host", "c", "above")
    rest = F.zip_with("c", "belief", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    joined = seen.join(hosts, "host").join(likelihood("declared"), "declared").join(likelihood("suffix"), "suffix")
    prior = F.transform(let(rest, lambda r: smoothed(r, F.col("above"))), lambda p: F.log(p))
    fused = joined.withColumn("posterior", _softmax(_vector(F.col("text"), prior, F.col("by_declared"), F.col("by_suffix"))))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return fused.select(
        "page_id", pick(F.col("posterior")).alias("lang"), F.round(F.array_max("posterior"), 6).alias("confidence"), pick(F.col("belief")).alias("text_lang"),
        "declared", "host",
    )
