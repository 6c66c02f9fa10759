"""Streams over several micro-batches."""

import json
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talloom.streaming import deltas, live, pairs, reorder, replies
from talloom.streaming.reorder import done, late
from talloom.streaming.run import end_input, held_map, run_available, run_to_end, use_rocksdb, waiting_rows, with_end


def _sse(events):
    return "".join(f"event: {e.get('type', 'x')}\ndata: {json.dumps(e)}\n\n" for e in events)


CALL = [
    {"type": "message_start"},
    {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}},
    {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "He"}},
    {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "llo\n"}},
    {"type": "content_block_stop", "index": 0},
    {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t", "name": "read_file"}},
    {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": '{"a": '}},
    {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "1}"}},
    {"type": "content_block_stop", "index": 1},
    {"type": "message_stop"},
]


def test_captured_replies(spark, tmp_path):
    use_rocksdb(spark)
    (tmp_path / "one").write_text(_sse(CALL))
    (tmp_path / "two").write_text(_sse(CALL[:4]))  # lost its end
    lines = deltas.read_captured_replies(spark, str(tmp_path))
    got = run_available(deltas.assemble_blocks_stream(deltas.block_events(lines)), "t").collect()
    assert {(r["stream_id"], r["block"], r["text"], r["input"]) for r in got} == {("one", 0, "Hello\n", None), ("one", 1, None, '{"a":1}')}


def _lines(spark, rows):
    """Rows (stream_id, minute of arrival, seq, event) as lines."""
    made = [(s, m, i, f"data: {json.dumps(e)}") for s, m, i, e in rows]
    frame = spark.createDataFrame(made, "stream_id string, m long, seq long, line string")
    return frame.select("stream_id", F.timestamp_seconds(F.lit(86_400) + 60 * F.col("m")).alias("arrived"), "seq", "line")


def test_replies_that_stay_open_and_replies_that_fall_silent(spark, tmp_path):
    """A is slow but never silent, B falls silent, C starts hours later; a line of B comes after it was given up."""
    a = [("A", 5 * i, i, e) for i, e in enumerate(CALL)]
    b = [("B", 1, i, e) for i, e in enumerate(CALL[:4])] + [("B", 1, 2, CALL[2])]
    c = [("C", 200, i, e) for i, e in enumerate(CALL)]
    folder = str(tmp_path / "in")
    steps = [a[:3] + b, a[3:], c, [("B", 201, 4, CALL[4])]]
    _lines(spark, steps[0]).coalesce(1).write.json(folder)
    use_rocksdb(spark)
    events = deltas.block_events(deltas.read_delta_stream(spark, folder))
    more = [lambda x=x: _lines(spark, x).coalesce(1).write.mode("append").json(folder) for x in steps[1:]]
    late_line = [lambda: _lines(spark, [("D", 900, 0, CALL[1])]).coalesce(1).write.mode("append").json(folder)]
    got = run_available(deltas.complete_blocks_stream(events, "10 minutes"), "t", more=more + late_line)
    found = {(r["kind"], r["stream_id"], r["block"], r["text"], r["missing"]) for r in got.collect()}
    call = '{"a": 1}'
    assert found == {
        ("whole", "A", 0, "Hello\n", 0), ("whole", "A", 1, call, 0), ("whole", "C", 0, "Hello\n", 0), ("whole", "C", 1, call, 0),
        ("lost", "B", 0, "Hello\n", None), ("lost", "B", 0, "", None),
    }


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_bytes_cut_anywhere(spark, tmp_path, size):
    text = 'event: x\r\ndata: {"a":\r\ndata:  "é日"}\r\n\r\n: note\n\ndata:b\r\rdata: open'.encode()
    cut = [text[i : i + size] for i in range(0, len(text), size)]
    rows = [("r", i, bytearray(p)) for i, p in enumerate(cut)][::-1] + [("r", 0, bytearray(cut[0])), ("gap", 1, bytearray(b"data: y\n\n"))]
    folder, schema = str(tmp_path / "in"), "stream_id string, piece long, bytes binary"
    frame = spark.createDataFrame(rows, schema).select("stream_id", F.timestamp_seconds(F.lit(86_400)).alias("arrived"), "piece", "bytes")
    frame.repartition(3, "piece").write.parquet(folder)
    stream = use_rocksdb(spark).readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = {(r["kind"], r["stream_id"], r["seq"], r["payload"]) for r in run_to_end(stream, replies.framed, "t", at="arrived").collect()}
    want = {("event", "r", 0, '{"a":\n "é日"}'), ("event", "r", 1, "b"), ("rest", "r", 2, "data: open"), ("rest", "gap", 0, "data: y\n\n")}
    assert found == want


def test_long_blocks_come_in_parts(spark):
    rows = [("s", "2024-01-01 00:00:00", i, f"data: {json.dumps(e)}") for i, e in enumerate(CALL)]
    raw = spark.createDataFrame(rows, "stream_id string, arrived string, seq bigint, line string")
    parts = deltas.assemble_blocks(deltas.block_events(deltas.data_lines(raw)), part_bytes=2).orderBy("part").collect()
    assert [(r["text"], r["input"]) for r in parts if r["block"] == 1] == [(None, '{"a":1}')]
    got = [r for r in parts if r["block"] == 0]
    assert [(r["part"], r["type"], r["text"]) for r in got] == [(0, "text", "He"), (1, "text", "llo\n")]


def test_lost_fragments_never_make_a_whole_block(spark, tmp_path):
    rows = [("s", "2024-01-01 00:00:00", i, f"data: {json.dumps(e)}") for i, e in enumerate(CALL)]
    at = next(i for i, e in enumerate(CALL) if e["type"] == "content_block_delta")
    broken = rows[:at] + rows[at + 1 :] + [rows[at - 1]]  # one lost, one repeated
    schema = "stream_id string, arrived string, seq bigint, line string"
    for given, whole in ((rows + rows[at : at + 1], True), (broken, False)):
        events = deltas.block_events(deltas.data_lines(spark.createDataFrame(given, schema)))
        found = {r["block"]: r["text"] for r in deltas.assemble_blocks(events).collect()}
        assert (0 in found) == whole and (not whole or found[0] == "Hello\n")


def test_captured_chunks(spark, tmp_path):
    def chunk(**delta):
        return {"choices": [{"delta": delta}]}

    events = [
        chunk(role="assistant"), chunk(content="a"), chunk(content="b"),
        chunk(tool_calls=[{"index": 1, "id": "y", "function": {"name": "g", "arguments": ""}}]),
        chunk(tool_calls=[{"index": 0, "id": "x", "function": {"name": "f", "arguments": '{"k"'}}]),
        chunk(tool_calls=[{"index": 0, "function": {"arguments": ": 2}"}}, {"index": 1, "function": {"arguments": "[["}}]),
        {"choices": [{"delta": {}, "finish_reason": "tool_calls"}]},
        {"choices": [], "usage": {"prompt_tokens": 7, "completion_tokens": 3}},
    ]
    (tmp_path / "one").write_text("".join(f"data: {json.dumps(e)}\n\n" for e in events) + "data: [DONE]\n\n")
    lines = deltas.read_captured_replies(spark, str(tmp_path))
    row = run_available(deltas.assemble_chunks_stream(deltas.chunk_events(lines)), "t").first()
    assert (row["text"], row["finish"], row["prompt_tokens"], row["completion_tokens"]) == ("ab", "tool_calls", 7, 3)
    assert [tuple(c) for c in row["calls"]] == [(0, "x", "f", '{"k":2}'), (1, "y", "g", "{}")]


def test_fragments_in_any_order_and_batch(spark, tmp_path):
    rows = [("s", "2024-01-01 00:00:00", i, f"data: {json.dumps(e)}") for i, e in enumerate(CALL)]
    for n, part in enumerate([rows[7:], rows[2:5], rows[:2], rows[5:7]]):
        frame = spark.createDataFrame(part[::-1], "stream_id string, arrived string, seq bigint, line string")
        frame.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = deltas.read_delta_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    got = run_available(deltas.early_complete(deltas.block_events(stream)), "t").collect()
    assert [(r["call_id"], r["input"], r["stop_seq"]) for r in got] == [("t", '{"a":1}', 8)]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """A log in six files of rising time, with one session that holds half of it."""
    folder = str(tmp_path_factory.mktemp("log"))
    rows = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).cast("bigint").alias("session"), F.col("id").alias("seq"),
        F.timestamp_micros(86_400_000_000 + F.col("id") * 60_000_000).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("amount"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) > 0).alias("flag"),
    )
    for i in range(6):
        rows.filter((F.col("seq") >= i * 100) & (F.col("seq") < i * 100 + 100)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _stream(spark, log):
    use_rocksdb(spark)
    schema = spark.read.parquet(log).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(log)


@pytest.fixture(scope="module")
def shuffled(spark, log, tmp_path_factory):
    """The log in eight files; a row may come up to three files after rows that follow it."""
    folder = str(tmp_path_factory.mktemp("shuffled"))
    place = F.floor((F.col("seq") + F.pmod(F.xxhash64("seq", F.lit(5)), F.lit(200))) / 100)
    rows = spark.read.parquet(log).withColumn("place", place)
    for i in range(8):
        rows.filter(F.col("place") == i).drop("place").orderBy(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(folder)
    return folder


DELAY = "4 hours"


def _passed(spark, log):
    """Rows in buckets of ten minutes that the watermark has passed at the end."""
    rows = spark.read.parquet(log)
    limit = rows.agg(F.unix_micros(F.max("ts")) - 4 * 3_600_000_000).first()[0]
    return rows.filter(F.unix_micros("ts") < limit // 600_000_000 * 600_000_000)


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    """Buckets of several chunks and frames, also where a log is short."""
    monkeypatch.setattr(reorder, "CHUNK_ROWS", 3)
    monkeypatch.setattr(reorder, "FRAME_ROWS", 7)
    monkeypatch.setattr(reorder, "BUCKET_MS", 600_000)


def _same(got, want):
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def _streaks(spark, rows):
    from talloom.operators.transcript import streaks

    return streaks(rows, ["session"], ["ts", "seq"], F.col("flag"), 4, 50).select("session", "seq", "total", "run", "limit_reached")


def test_streaks_go_on_across_batches(spark, shuffled, tmp_path):
    rows = _stream(spark, shuffled).select("session", "ts", "seq", F.col("flag").alias("denied"))
    state = str(tmp_path / "state")
    got = run_available(live.streaks_stream(rows, 4, 50, DELAY), "t", state=state)
    want = _streaks(spark, _passed(spark, shuffled))
    assert want.count() > 300 and late(got).isEmpty()
    _same(done(got).select(*want.columns), want)
    _same(waiting_rows(spark, state).select("session", "seq"), spark.read.parquet(shuffled).join(want, "seq", "left_anti").select("session", "seq"))


def test_a_closed_stream_holds_nothing_back(spark, shuffled, tmp_path):
    rows = _stream(spark, shuffled).select("session", "ts", "seq", F.col("flag").alias("denied"))
    state = str(tmp_path / "state")
    got = run_to_end(rows, lambda r: live.streaks_stream(r, 4, 50, DELAY), "t", state)
    want = _streaks(spark, spark.read.parquet(shuffled))
    assert want.count() == 600 and waiting_rows(spark, state).isEmpty()
    _same(done(got).select(*want.columns), want)


def test_rows_behind_the_watermark_come_out(spark, shuffled):
    """With a delay shorter than the disorder, each row is either folded in its place or late."""
    rows = _stream(spark, shuffled).select("session", "ts", "seq", F.col("flag").alias("denied"))
    got = run_to_end(rows, lambda r: live.streaks_stream(r, 4, 50, "30 minutes"), "t").cache()
    behind, everything = late(got), spark.read.parquet(shuffled)
    assert behind.count() > 20
    want = _streaks(spark, everything.join(behind, ["session", "seq"], "left_anti"))
    _same(done(got).select(*want.columns), want)


def test_one_alert_per_session(spark, shuffled):
    from talloom.operators.usage import budget_crossing

    rows = _stream(spark, shuffled).select("session", "ts", "seq", "amount", F.col("flag").alias("turn"))
    for run, known in ((run_available, _passed(spark, shuffled)), (None, spark.read.parquet(shuffled))):
        make = lambda r: live.usage_stream(r, 600, 60, DELAY)
        got = done(run(make(rows), "t") if run else run_to_end(rows, make, "t"))
        want = budget_crossing(known, "session", ["ts", "seq"], F.col("amount"), F.col("flag"), 600, 60).select(*got.columns)
        assert want.count() > 0
        _same(got, want)


def test_retries_across_batches(spark, shuffled, tmp_path):
    from talloom.operators.logs import retry_chains

    state = str(tmp_path / "state")
    rows = _stream(spark, shuffled).select("session", "ts", "seq", F.col("flag").alias("bad"), (F.col("flag") & (F.col("amount") < 45)).alias("again"))
    got = done(run_to_end(rows, lambda r: live.retry_stream(r, delay=DELAY), "t", state))
    batch = retry_chains(spark.read.parquet(shuffled), ["session"], ["ts", "seq"], F.col("flag"), F.col("amount") < 45)
    counts = lambda df: df.groupBy("session", "outcome", "attempts").count()
    _same(counts(got), counts(batch.filter("outcome <> 'open'")))
    _same(live.open_chains(spark, state).select("session", "attempts"), batch.filter("outcome = 'open'").select("session", "attempts"))


def test_late_results_across_batches(spark, log, tmp_path):
    rows = _stream(spark, log).select("session", "ts", "seq", F.col("flag").alias("is_turn"))
    state = str(tmp_path / "state")
    found = done(run_available(live.late_results_stream(rows, "5 minutes"), "t", state=state))
    got = {(r["session"], r["seq"]): r["turn"] for r in found.collect()}
    pdf = spark.read.parquet(log).toPandas().sort_values("seq")
    limit = (pdf["ts"].max().timestamp() - 300) // 600 * 600
    want, open_ = {}, set()
    for r in pdf[~pdf["flag"]].itertuples():
        later = pdf[pdf["flag"] & (pdf["session"] == r.session) & (pdf["seq"] > r.seq)]
        if len(later) and later.iloc[0]["ts"].timestamp() < limit:
            want[r.session, r.seq] = later.iloc[0]["seq"]
        else:
            open_.add((r.session, r.seq))
    assert got == want
    assert {(r["session"], r["seq"]) for r in live.unsettled_results(spark, state).collect()} == open_


def test_requests_responses_and_exits(spark, tmp_path):
    """Requests of two servers over micro-batches of disorder, against plain Python."""
    minute = 60_000_000
    asked = [(i % 2, i, 5 * i) for i in range(60)]
    told = [(i % 2, i, 5 * i + i % 9, i % 5 == 0) for i in range(60) if i % 3]
    exits = [(0, 151), (0, 220), (1, 40)]
    at = lambda m: F.timestamp_micros(F.lit(86_400_000_000) + F.col(m) * minute).alias("ts")
    rows = live.rpc_rows(
        spark.createDataFrame(asked, "server long, id long, m long").select("server", "id", at("m")),
        spark.createDataFrame(told, "server long, id long, m long, failed boolean").select("server", "id", at("m"), "failed"),
        spark.createDataFrame(exits, "server long, m long").select("server", at("m")),
    )
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    place = F.floor((F.unix_micros("ts") - 86_400_000_000) / (60 * minute) + F.pmod(F.xxhash64("id", "what"), F.lit(2)))
    placed = rows.withColumn("place", place).cache()
    for k in range(8):
        placed.where(F.col("place") == k).drop("place").coalesce(1).write.mode("append").parquet(folder)
    stream = use_rocksdb(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run_to_end(stream, lambda r: live.correlate_rpc_exits_stream(r, 6 * 60_000, "3 hours"), "t", state)
    found = {r["id"]: (r["status"], r["exit_us"]) for r in done(got).collect()}
    found |= {r["id"]: (r["status"], None) for r in live.unanswered(spark, state).collect()}
    want = {}
    for server, i, sent in asked:
        answer = next((x for x in told if x[1] == i and x[2] <= sent + 6), None)
        gone = min((m for s, m in exits if s == server and m >= sent), default=None)
        want[i] = ("error" if answer[3] else "ok", None) if answer else ("server exited", 86_400_000_000 + gone * minute) if gone else ("timeout", None)
    assert found == want and len({s for s, _ in want.values()}) == 4


def test_requests_and_responses_of_a_slot_are_one_entry(spark, tmp_path, monkeypatch):
    """Two batches in two slots, with repeated and missing keys and whole numbers beside gaps, against plain Python."""
    monkeypatch.setattr(pairs, "SLOTS", 2)
    big = 2**60 + 1  # no double
    asked = [(None if i % 30 == 3 else i // 2, 10 * i, big + i if i % 4 else None, f"q{i}") for i in range(300)] + [(None, None, 1, "no time")]
    told = [(None if i % 40 == 5 else i % 150, 20 * (i % 150) + 7 * (i // 150), i % 3 == 0 or None, big - i if i % 5 else None) for i in range(450)]
    at = lambda n: F.timestamp_seconds(F.lit(86_400) + F.col(n)).alias(n)
    q = spark.createDataFrame(asked, "id long, sent long, n long, name string").select("id", at("sent"), "n", "name")
    r = spark.createDataFrame(told, "id long, got long, flag boolean, m long").select("id", at("got"), "flag", "m")
    for rows, time, name in ((q, "sent", "q"), (r, "got", "r")):
        for k in (0, 1):
            rows.where(F.pmod(F.xxhash64(time), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    use_rocksdb(spark)
    (q_in, q_end), (r_in, r_end) = (
        with_end(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)), n) for x, n in ((q, "q"), (r, "r"))
    )
    state, entries = str(tmp_path / "state"), []

    def look():
        entries.extend(held_map(spark, state, n).count() for n in ("asked", "told"))

    def end():
        end_input(spark, q_end, "sent")
        end_input(spark, r_end, "got", id=-1)

    got = run_available(live.correlate_rpc_stream(q_in, r_in, "id", "sent", "got", "12 seconds", "1 day"), "t", state=state, more=[look, end])
    assert 0 < entries[0] <= 4 and 0 < entries[1] <= 4
    want = Counter()
    for i, sent, n, name in asked[:-1]:
        answers = [x for x in told if x[0] is not None and x[0] == i and sent <= x[1] <= sent + 12]
        want.update((i, 86_400 + sent, n, name, 86_400 + x[1], *x[2:]) for x in answers)
        want.update([] if answers else [(i, 86_400 + sent, n, name, None, None, None)])
    seconds = [F.unix_seconds(c).alias(c) if c in ("sent", "got") else c for c in got.columns]
    assert got.columns == ["id", "sent", "n", "name", "got", "flag", "m"] and Counter(map(tuple, got.select(*seconds).collect())) == want


def test_pairs_by_sorted_search(monkeypatch):
    monkeypatch.setattr(pairs, "FRAME_ROWS", 4)
    draw = np.random.default_rng(3)
    us = draw.integers(0, 50, 80)
    requests = pd.DataFrame({"key": draw.integers(0, 6, 80), "keyed": draw.random(80) < 0.9, "us": us, "due": us + draw.integers(0, 9, 80)})
    responses = pd.DataFrame({"key": draw.integers(0, 7, 90), "us": draw.integers(0, 60, 90)})
    found = [x for q, r in pairs._pairs(requests, responses) for x in zip(q.tolist(), r.tolist())]
    rows = list(enumerate(responses.itertuples()))
    want = {(i, j) for i, a in enumerate(requests.itertuples()) for j, b in rows if a.keyed and a.key == b.key and a.us <= b.us <= a.due}
    assert len(found) == len(want) > 40 and set(found) == want


def test_idle_sessions_close(spark, log):
    got = run_available(live.idle_sessions(_stream(spark, log), "session", "ts", "10 minutes", "1 minute"), "t")
    rows = spark.read.parquet(log)
    assert got.filter("session = 0").count() == 0  # still open at the end
    assert got.agg(F.sum("calls")).first()[0] <= rows.count()
    assert got.filter("unix_timestamp(end) - unix_timestamp(start) < 600").count() == 0


def test_rows_without_a_session_mix_with_no_other(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = F.timestamp_seconds(86_400 + F.col("id") * 60).alias("ts")
    rows = spark.range(400).select(F.expr("nullif(id % 40, 7)").alias("session"), at, F.col("id").alias("seq"), F.lit(True).alias("denied"))
    rows.repartition(4).write.parquet(folder)
    stream = use_rocksdb(spark).readStream.schema(rows.schema).parquet(folder)
    got = done(run_to_end(stream, lambda r: live.streaks_stream(r, 4, 50, "1 hour"), "t"))
    want = {(None if i % 40 == 7 else i % 40, i, i // 40 + 1) for i in range(400)}
    assert {(r["session"], r["seq"], r["run"]) for r in got.collect()} == want


def test_a_batch_operator_reads_the_rows_of_the_stream_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(50).write.parquet(folder)
    drawn = F.udf(lambda _: __import__("random").random(), "double").asNondeterministic()
    stream = spark.readStream.schema("id long").parquet(folder).withColumn("x", drawn("id"))
    twice = lambda df: df.join(df.select("id", F.col("x").alias("y")), "id")
    got = run_available(stream, "t", each=twice)
    assert got.count() == 50 and got.where("x <> y").isEmpty()


def test_replies_of_a_slot_are_one_call(spark, tmp_path, monkeypatch):
    """A hundred replies, in two batches and with their lines far apart, in two slots."""
    monkeypatch.setattr(replies, "SLOTS", 2)
    monkeypatch.setattr(replies, "PART_ROWS", 64)
    folder = str(tmp_path / "in")
    lines = _lines(spark, [(f"s{k}", 1, i, e) for k in range(100) for i, e in enumerate(CALL)])
    for half in ("seq % 2 = 0", "seq % 2 = 1"):
        lines.where(half).repartition(1, "seq").write.mode("append").json(folder)
    use_rocksdb(spark)
    events = deltas.block_events(deltas.read_delta_stream(spark, folder, files_per_batch=1))
    got = run_available(deltas.complete_blocks_stream(events, "10 minutes"), "t")
    assert {(r["stream_id"], r["block"], r["text"]) for r in got.collect()} == {(f"s{k}", b, x) for k in range(100) for b, x in ((0, "Hello\n"), (1, '{"a": 1}'))}


def test_larger_tables_are_written_to_more_files(spark, tmp_path, monkeypatch):
    from talloom.plans import all_queries, stream_queries  # noqa: F401 - in this order

    spark.range(1000).select(F.col("id").cast("string").alias("stream_id"), F.col("id").alias("seq")).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    assert stream_queries._files(rows, 4) == 4
    monkeypatch.setattr(stream_queries, "_FILE_BYTES", 500)
    assert stream_queries._files(rows, 4) > 8


def _piece_rows(spark, count):
    """Replies cut into pieces of ten bytes."""
    text = _sse(CALL).encode()
    rows = [(f"s{k}", i // 10, bytearray(text[i : i + 10])) for k in range(count) for i in range(0, len(text), 10)]
    made = spark.createDataFrame(rows, "stream_id string, piece long, bytes binary")
    return made.select("stream_id", F.timestamp_seconds(F.lit(86_400)).alias("arrived"), "piece", "bytes")


def test_pieces_ahead_of_their_turn_share_entries(spark, tmp_path, monkeypatch):
    """Before, an entry for every reply and micro-batch, each written anew whenever its reply got on."""
    monkeypatch.setattr(replies, "SLOTS", 2)
    pieces, folder, state = _piece_rows(spark, 50), str(tmp_path / "in"), str(tmp_path / "state")
    for k in (2, 1):
        pieces.where(f"piece % 3 = {k}").coalesce(1).write.mode("append").parquet(folder)
    stream, end = with_end(use_rocksdb(spark).readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(folder), "t")
    entries = []

    def last():
        entries.append(held_map(spark, state, "waiting").count())
        pieces.where("piece % 3 = 0").coalesce(1).write.mode("append").parquet(folder)

    got = run_available(replies.framed(stream, "1 hour"), "t", state=state, more=[last, lambda: end_input(spark, end, "arrived")]).collect()
    assert entries == [4]  # two slots, two micro-batches
    assert len(got) == 50 * len(CALL)
    assert {(r["kind"], r["stream_id"], r["seq"], r["payload"]) for r in got} == {("event", f"s{k}", i, json.dumps(e)) for k in range(50) for i, e in enumerate(CALL)}
    assert held_map(spark, state, "waiting").isEmpty()


def test_lost_blocks_share_entries(spark, tmp_path, monkeypatch):
    """A hundred replies without their third line, one of them in two parts: all come out, and their entries go."""
    monkeypatch.setattr(replies, "SLOTS", 2)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    lines = _lines(spark, [(f"s{k}", 1, i, e) for k in range(100) for i, e in enumerate(CALL) if i != 2 and (k or i != 3)])
    lines.coalesce(1).write.json(folder)
    stream, end = with_end(deltas.read_lines(use_rocksdb(spark), folder), "t")
    events, entries = deltas.block_events(deltas.data_lines(stream)), []

    def more():
        entries.append(held_map(spark, state, "waiting").count())
        _lines(spark, [("s0", 2, 3, CALL[3]), ("s1", 2, 2, CALL[2])]).coalesce(1).write.mode("append").json(folder)

    close = lambda: end_input(spark, end, "arrived", line='data: {"type":"end","index":0}')
    got = run_available(deltas.complete_blocks_stream(events, "10 minutes"), "t", state=state, more=[more, close]).where("block = 0 AND stream_id IS NOT NULL").collect()
    assert entries == [2]
    assert {(r["kind"], r["stream_id"], r["text"], r["missing"]) for r in got} == {("lost", f"s{k}", "llo\n", 1) for k in range(100) if k != 1} | {("whole", "s1", "Hello\n", 0)}
    assert len(got) == 100


def _documents(spark, folder, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    made.coalesce(1).write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("name", ["kept_replies", "lost_replies"])
def test_replies_in_many_files_are_not_given_up_in_between(spark, tmp_path, monkeypatch, name):
    """Lines are dealt over files by hash; a step read in several micro-batches gave up replies whose lines were still to come."""
    from talloom.plans import all_queries, stream_queries

    texts = {i: f"{i:03d}" * (30 * i) for i in range(1, 31)}
    _documents(spark, str(tmp_path), [(i, x, "en", "src1") for i, x in texts.items()])
    monkeypatch.setattr(stream_queries, "_files", lambda rows, least: 150)
    got = [tuple(r) for r in all_queries.QUERIES[name](spark, str(tmp_path)).collect()]
    if name == "lost_replies":
        want = [(f"d{i}", 0, "text", x[:300] + x[600:], 1 if len(x) > 300 else None) for i, x in texts.items() if i % 7 == 3]
    else:
        want = [(f"d{i}", 0, x, None) for i, x in texts.items() if i % 7 != 3]
        want += [(f"d{i}", 1, None, f'{{"n":{len(x)},"path":"src1"}}') for i, x in texts.items()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_captured_replies_of_documents_that_share_an_id(spark, tmp_path):
    """Only these are brought together, as one reply; and what was read goes."""
    from talloom.plans import all_queries
    from talloom.session import _located, scratch_path

    _documents(spark, str(tmp_path), [(1, "a" * 700, "en", "src1"), (2, "b", "de", "src2"), (3, "c", "en", "src1"), (3, "c", "en", "src1"), (None, "d", "es", "src1")])
    at, files = _located(spark, scratch_path(spark, "x").rsplit("/", 1)[0])
    names = lambda: {s.getPath().getName() for s in files.listStatus(at)}
    files.mkdirs(at)
    before = names()
    found = all_queries.QUERIES["captured_replies"](spark, str(tmp_path))
    got = sorted(((r["stream_id"], r["block"], r["call_id"], r["text"], r["input"]) for r in found.collect() if r["stream_id"] != "d3"), key=str)
    assert got == sorted([
        ("d1", 0, None, "a" * 700, None), ("d1", 1, "call1", None, '{"n":700,"path":"src1"}'), ("d2", 0, None, "b", None),
        ("d2", 1, "call2", None, '{"n":1,"path":"src2"}'), (None, 0, None, "d", None), (None, 1, None, None, "{}"),
    ], key=str)
    kept = {n.rsplit("-", 1)[0] for n in names() - before}
    assert "captured-out" in kept and not kept & {"whole", "raw", "framed", "frame-state", "captured-state"}
