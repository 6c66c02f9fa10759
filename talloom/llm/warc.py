"""WARC archives: written by Spark's text sink, read back with segment reassembly.

Writing: one record per page, its block an HTTP reply whose body is framed by chunked transfer coding. A block above
`SEGMENT_BYTES` is split: the first record has segment number 1, the others are `continuation` records that name the
first one's id, and the last carries the total length. A record's end (two line breaks) is the sink's line separator,
so the files are plain WARC and any store that Spark writes to will do. Files hold at most `RECORDS_PER_FILE` records of
bounded size.

Reading: files are parsed by content length. Whole records need no shuffle; segments are grouped by origin id, ordered
by number, checked for gaps and for the total length, joined, and the chunked framing is decoded.

Of pages with equal payloads of at least `REVISIT_BYTES`, that with the largest id is the response; the others are
revisit records without a payload, which are resolved by the id they refer to.

Defined cases: null html is an empty payload; a null url is written as `urn:none`; a null id is kept, never chosen as
the one referred to; rows that repeat id and payload are records with an occurrence number in their ids, so that every
row comes back; a damaged group of segments gives a row with null bytes and digest; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talloom.llm.common import prepared, stored
from talloom.session import scratch_path

#: Fixed value: smaller payloads are always responses.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 2000
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "type string, id string, origin string, segment long, total long, digest string, refers_to string, block binary, "
    "payload_bytes long, payload_digest string"
)


def framed(payload: bytes) -> bytes:
    """A body in chunked transfer coding."""
    parts = [payload[k : k + CHUNK_BYTES] for k in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out) if body[at : at + 2] == b"\r\n" else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, name: str, url: str, block: bytes, *extra: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", *extra]
    if kind != "continuation":
        lines.append("Content-Type: application/http; msgtype=response")
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block


def _records(page, url: str, payload: bytes, digest: str, refers: str | None, again: str | None) -> Iterator[bytes]:
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    name = f"urn:page:{page}:{digest}" + (f":again{again}" if again is not None else "")
    proof = f"WARC-Payload-Digest: sha1:{digest}"
    if refers is not None:
        yield _record("revisit", name, url, HTTP, proof, f"WARC-Refers-To: <urn:page:{refers}:{digest}>",
                      "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = HTTP + framed(payload)
    parts = [block[k : k + SEGMENT_BYTES] for k in range(0, len(block), SEGMENT_BYTES)]
    if len(parts) == 1:
        yield _record("response", name, url, block, proof)
        return
    yield _record("response", name, url, parts[0], proof, "WARC-Segment-Number: 1")
    for k, part in enumerate(parts[1:], 2):
        last = [f"WARC-Segment-Total-Length: {len(block)}"] if k == len(parts) else []
        yield _record("continuation", f"{name}:{k}", url, part, f"WARC-Segment-Origin-ID: <{name}>", f"WARC-Segment-Number: {k}", *last)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, `refers`: the page whose equal payload stands for this one, or null, and `again`: a
    number that tells rows of equal id and payload apart, null for the first of them."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("urn:none")).alias("url"), html.alias("html"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    equal = rows.groupBy(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).agg(F.min("place").alias("first"), F.count("*").alias("_n"))
    equal = stored(equal.where("_n > 1").drop("_n"), "equal-pages")
    rows = rows.join(equal, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.withColumn("again", F.when(F.col("place") != F.col("first"), F.col("place"))).drop("_page", "_digest", "first", "place")
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    # stored first: the planner then knows how small it is, and pages move only if it is not
    repeats = stored(large.groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1"), "repeats")
    other = F.col("refers").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers"))
    return rows.join(repeats.drop("n"), "digest", "left").withColumn("refers", F.when(other, F.col("refers")))


def write_archives(pages: DataFrame, path: str) -> None:
    """Pages as WARC files below `path`."""

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[bytes] = []
            for row in batch.itertuples(index=False):
                payload = row.html.encode("utf-8", "surrogatepass")
                out += _records(row.page, row.url, payload, row.digest, *(x if isinstance(x, str) else None for x in (row.refers, row.again)))
            yield pd.DataFrame({"record": out})

    # ids as text: pandas would turn whole numbers beside nulls into floats
    rows = with_revisits(pages).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("page"), "url", "html", "digest", F.col("refers").cast("string").alias("refers"),
        F.col("again").cast("string").alias("again"),
    )
    records = rows.mapInPandas(render, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def payload_of(block: bytes) -> bytes | None:
    """The payload in an HTTP reply, or None if it is damaged."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unframed(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Every record of every archive below `path`, with length and digest of the payload of unsegmented responses.

    Without `blocks` only segments keep theirs, for reassembly.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                at, rows, held = 0, [], 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at)
                    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
                    if not first.startswith("WARC/"):
                        raise ValueError(f"not a WARC record at byte {at}")
                    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    size = int(head["content-length"])
                    block = data[end + 4 : end + 4 + size]
                    at = end + 4 + size + len(END)
                    number = lambda key: int(head[key]) if key in head else None
                    segment, proof = number("warc-segment-number"), (None, None)
                    if head["warc-type"] == "response" and segment is None and (payload := payload_of(block)) is not None:
                        proof = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append((
                        head["warc-type"], head["warc-record-id"], head.get("warc-segment-origin-id"), segment, number("warc-segment-total-length"),
                        head.get("warc-payload-digest", "").removeprefix("sha1:") or None, head.get("warc-refers-to"),
                        block if blocks or segment is not None else None, *proof,
                    ))
                    held += size
                    if held > 4 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"segment": "Int64", "total": "Int64", "payload_bytes": "Int64"})


def _payload(blocks: Column) -> Column:
    """Length and digest of the payload in an HTTP reply; nulls if it is damaged."""

    @F.pandas_udf("bytes long, sha1 string")
    def of(blocks: pd.Series) -> pd.DataFrame:
        found = [None if block is None else payload_of(block) for block in blocks]
        return pd.DataFrame({
            "bytes": pd.array([None if x is None else len(x) for x in found], "Int64"),
            "sha1": [None if x is None else hashlib.sha1(x).hexdigest() for x in found],
        })

    return of(blocks)


def reassembled(records: DataFrame) -> DataFrame:
    """id and whole block of every segmented response; null block if segments are missing or the length is wrong."""
    parts = records.where("segment IS NOT NULL").select(F.coalesce("origin", "id").alias("id"), "segment", "total", "block")
    # one group is one page; repeats of a segment are dropped before the blocks are joined
    groups = parts.groupBy("id").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("segment", "block")))).alias("parts"), F.max("total").alias("total"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    gapless = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    # binary pieces are joined as unchecked strings, in one pass
    joined = F.array_join(F.transform("parts", lambda x: x["block"].cast("string")), "").cast("binary")
    return groups.select("id", F.when(gapless & (size == F.col("total")), joined).alias("block"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page in the archives."""
    records = stored(read_records(spark, path, blocks=False), "records")
    page = lambda c: F.regexp_extract(c, r"urn:page:(\d+|-\d+|none):", 1)
    number = lambda c: F.when(page(c) != "none", page(c)).cast("long")
    whole = records.where("type = 'response' AND segment IS NULL").select("id", "payload_bytes", "payload_digest")
    joined = reassembled(records).select("id", _payload(F.col("block")).alias("p")).select("id", F.col("p.bytes"), F.col("p.sha1"))
    responses = stored(whole.union(joined).dropDuplicates(["id"]), "responses")
    revisits = records.where("type = 'revisit'").select("id", "refers_to", "digest").dropDuplicates(["id"])
    targets = responses.select(F.col("id").alias("refers_to"), "payload_bytes", "payload_digest")
    resolved = revisits.join(targets, "refers_to", "left")
    return responses.select(
        number("id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).union(resolved.select(
        number("id"), "payload_bytes", F.when(F.col("payload_digest") == F.col("digest"), F.col("digest")), F.lit("revisit"), number("refers_to")
    ))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = prepared(pages.sparkSession)
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_pages(spark, path)
