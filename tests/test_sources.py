"""Sources and sinks over small files of every shape."""

import json
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from talloom.session import shared_dir
from talloom.sources import config, definitions, logs, notes, session_store, sessions
from talloom.sources.config import read_layered_config


def _session(ident, start, messages, key):
    return {"metadata": {"id": ident, "model": "m", "cwd": "/w", "startTime": start, "messageCount": len(messages)}, key: messages}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("sessions")
    blocks = [
        {"role": "user", "content": "read it"},
        {"role": "assistant", "content": [
            {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"},
            {"type": "tool_use", "id": "t1", "name": "read_file", "input": {"file_path": "a.py", "n": 1}},
        ]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "body"}]},
    ]
    chunks = [
        {"role": "system", "content": "be good"},
        {"role": "user", "content": "run"},
        {"role": "assistant", "content": None, "tool_calls": [
            {"id": "c1", "type": "function", "function": {"name": "run_shell", "arguments": '{"command": "ls"}'}},
            {"id": "c2", "type": "function", "function": {"name": "run_shell", "arguments": "{oops"}},
        ]},
        {"role": "tool", "tool_call_id": "c1", "content": "out"},
    ]
    (base / "a.json").write_text(json.dumps(_session("a", "2024-01-02T00:00:00.000Z", blocks, "listA"), indent=2))
    (base / "b.json").write_text(json.dumps(_session("b", "2024-01-03T00:00:00.000Z", chunks, "listB"), indent=2))
    (base / "c.json").write_text('{"metadata": {"id": "c"')
    return str(base)


def test_sessions_of_both_shapes(spark, folder):
    found = sessions.read_sessions(spark, folder, whole_files=True)
    meta = {r["id"]: r for r in found.metadata.collect()}
    assert set(meta) == {"a", "b"} and meta["b"]["message_count"] == 4
    assert found.corrupt.count() == 1
    texts = {(r["session_id"], r["msg_idx"]): (r["role"], r["text"]) for r in found.messages.collect()}
    assert texts["a", 0] == ("user", "read it") and texts["a", 1] == ("assistant", None) and texts["b", 2] == ("assistant", None)
    blocks = {(r["session_id"], r["msg_idx"], r["block_idx"]): r for r in found.blocks.collect()}
    call = blocks["a", 1, 2]
    assert (call["type"], call["call_id"], call["tool"]) == ("tool_use", "t1", "read_file")
    assert json.loads(call["input"]) == {"file_path": "a.py", "n": 1}
    assert blocks["a", 2, 0]["result"] == "body" and blocks["a", 2, 0]["call_id"] == "t1"
    assert json.loads(blocks["b", 2, 0]["input"]) == {"command": "ls"} and blocks["b", 2, 1]["input"] == "{}"
    assert blocks["b", 3, 0]["type"] == "tool_result" and blocks["b", 3, 0]["call_id"] == "c1"
    assert len(blocks) == 10


def test_latest_session(spark, folder):
    from talloom.operators.transcript import latest_session

    found = sessions.read_sessions(spark, folder, whole_files=True).metadata
    assert latest_session(found, "start_time", "id").first()["id"] == "b"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, saved_at int, model string")


def _models(spark, path):
    rows = [(r["id"], r["model"]) for r in session_store.stored_sessions(spark, path).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_saved_sessions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "saved")
    save = lambda *r: session_store.write_sessions(_rows(spark, *r), path)
    save(("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("a", 2, "y"))
    save(("b", 5, "z"), ("d", 5, "z"), ("a", 0, "old"))
    assert _models(spark, path) == {"a": "y", "b": "z", "c": "x", "d": "z"}
    session_store.compact_sessions(spark, path)
    session_store.compact_sessions(spark, path)  # nothing left to do
    save(("e", 1, "n"))
    save()
    assert _models(spark, path) == {"a": "y", "b": "z", "c": "x", "d": "z", "e": "n"}
    session_store.compact_sessions(spark, path)
    assert len(session_store.vacuum(spark, path, 0)) == 5
    assert _models(spark, path) == {"a": "y", "b": "z", "c": "x", "d": "z", "e": "n"}


def test_a_save_touches_no_other_row(spark, tmp_path):
    """Files stay as they are, compaction rewrites the touched buckets, and their number follows the size."""
    path = str(tmp_path / "saved")
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "saved").rglob("*.parquet")}
    session_store.write_sessions(_rows(spark, *[(f"s{i}", i, "x" * (i % 50)) for i in range(3000)]), path)
    session_store.compact_sessions(spark, path, 4096)
    before, live = files(), session_store.Live(session_store._commits(spark, path))
    assert live.bits >= 2 and len(live.buckets) == 2**live.bits
    session_store.write_sessions(_rows(spark, ("s1", 9999, "new")), path)
    assert {k: v for k, v in files().items() if k in before} == before
    session_store.compact_sessions(spark, path, 4096)
    assert {k: v for k, v in files().items() if k in before} == before
    now = session_store.Live(session_store._commits(spark, path))
    assert now.bits == live.bits and len(set(now.buckets) - set(live.buckets)) == 1 and now.single()
    session_store.compact_sessions(spark, path, 4096)
    session_store.write_sessions(_rows(spark, *[(f"t{i}", i, "y") for i in range(9000)]), path)
    session_store.compact_sessions(spark, path, 4096)
    grown = session_store.Live(session_store._commits(spark, path))
    assert grown.bits > live.bits and grown.single()
    found = _models(spark, path)
    assert len(found) == 12_000 and found["s1"] == "new" and found["s2"] == "xx"


def test_small_buckets_are_written_by_many_tasks(spark, tmp_path):
    """A task writes some of them. Adaptive execution goes by bytes, and gave all of them to one task."""
    path = str(tmp_path / "saved")
    session_store.write_sessions(_rows(spark, *[(f"s{i}", i, "x" * (i % 50)) for i in range(9000)], (None, 1, "none")), path)
    session_store.compact_sessions(spark, path, 512)
    live = session_store.Live(session_store._commits(spark, path))
    files = [f for f in (tmp_path / "saved" / "data" / live.buckets[0][0]).rglob("*.parquet")]
    assert len(files) == len(live.buckets) > 2 * session_store.TASK_BUCKETS
    by_task = Counter(f.name.split("-")[1] for f in files)
    assert len(by_task) > 1 and max(by_task.values()) <= 2 * session_store.TASK_BUCKETS
    assert {b: size for _, _, b, size in live.buckets} == {int(f.parent.name.removeprefix("bucket=")): f.stat().st_size for f in files}
    assert len(_models(spark, path)) == 9001


def test_saves_and_compactions_at_once(spark, tmp_path):
    path = str(tmp_path / "saved")
    session_store.write_sessions(_rows(spark, *[(f"s{i}", 0, "first") for i in range(50)]), path)

    def work(n):
        session_store.write_sessions(_rows(spark, *[(f"s{i}", n, f"m{n}") for i in range(n, 50)], ("tie", 7, f"m{n}")), path)
        session_store.compact_sessions(spark, path, 512)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(1, 7)))
    (tmp_path / "saved" / "data" / "halfway").mkdir()  # a save that never got to its commit
    found = _models(spark, path)
    assert {k: v for k, v in found.items() if k != "tie"} == {"s0": "first"} | {f"s{i}": f"m{min(i, 6)}" for i in range(1, 50)}
    session_store.compact_sessions(spark, path, 512)
    assert session_store.Live(session_store._commits(spark, path)).single() and _models(spark, path) == found


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nname: A\ntype: user\ndescription: d: e\n---\nbody\n")
    (tmp_path / "sub" / "b.md").write_text("---\nname: B\ntype: odd\n---\n")
    (tmp_path / "c.md").write_text("no header")
    (tmp_path / "MEMORY.md").write_text("index")
    (tmp_path / "d.txt").write_text("---\nname: D\ntype: user\n---\n")
    raw = notes.read_markdown_corpus(spark, str(tmp_path))
    assert {r["file"] for r in raw.collect()} == {"a.md", "b.md", "c.md"}
    listed = {r["name"]: r for r in notes.list_notes(raw).collect()}
    assert set(listed) == {"A", "B"}
    assert listed["A"]["description"] == "d: e" and listed["A"]["body"] == "body" and listed["B"]["type"] == "project"
    headers = {r["file"]: (r["type"], r["description"]) for r in notes.scan_headers(raw).collect()}
    assert headers == {"a.md": ("user", "d: e"), "b.md": (None, None), "c.md": (None, None)}


def test_header_that_closes_late_is_not_scanned(spark):
    text = "---\nname: A\ntype: user\n" + "x: y\n" * 40 + "---\nbody"
    raw = spark.createDataFrame([("a.md", text)], "file string, text string")
    assert notes.scan_headers(raw).first()["type"] is None
    assert notes.list_notes(raw).first()["type"] == "user"


def test_note_round_trip(spark, tmp_path):
    entries = spark.createDataFrame(
        [("My Note!", "about it", "user", "line 1\nline 2"), ("Ünï", "d", "project", "b")], "name string, description string, type string, body string"
    )
    notes.write_note_table(entries, str(tmp_path / "n"))
    back = spark.read.parquet(str(tmp_path / "n"))
    assert {r["file"] for r in back.collect()} == {"user_my_note.md", "project_n.md"}
    listed = {r["name"]: (r["description"], r["body"]) for r in notes.list_notes(back.drop("type")).collect()}
    assert listed == {"My Note!": ("about it", "line 1\nline 2"), "Ünï": ("d", "b")}


def test_rules(spark, tmp_path):
    (tmp_path / "a").write_text(
        json.dumps({"layer": 0, "permissions": {"allow": ["read_file", "run_shell(npm *)"], "deny": "x"}})
        + "\nnot json\n" + json.dumps({"layer": 1, "permissions": {"deny": ["run_shell(rm (x))", "Bad(y)"]}})
    )
    rules = config.read_rules(spark.read.text(str(tmp_path / "a")))
    assert {tuple(r) for r in rules.collect()} == {
        (0, "allow", "read_file", None), (0, "allow", "run_shell", "npm *"), (1, "deny", "run_shell", "rm (x)"), (1, "deny", "Bad(y)", None),
    }


def test_layered_config(spark):
    rows = [
        (0, json.dumps({"mcpServers": {"a": {"command": "x"}, "b": {"command": "x"}}})),
        (1, json.dumps({"a": {"command": "y", "args": ["1"]}, "b": {"command": 5}, "c": {"url": "z"}})),
        (2, "{broken"),
    ]
    got = read_layered_config(spark.createDataFrame(rows, "layer int, value string"))
    assert {(r["name"], r["layer"], r["command"]) for r in got.collect()} == {("a", 1, "y"), ("b", 0, "x")}


def test_definitions(spark):
    rows = [
        (0, "u/greet", "---\ndescription: old\nuser-invocable: false\n---\nHi $ARGUMENTS"),
        (1, "p/greet", "---\nname: greet\ndescription: new\nallowed-tools: [bad, list]\ncontext: fork\n---\nHello"),
        (0, "u/other", "plain text"),
    ]
    got = {r["name"]: r for r in definitions.parse_definitions(spark.createDataFrame(rows, "layer int, folder string, text string")).collect()}
    assert got["greet"]["description"] == "new" and got["greet"]["context"] == "fork" and got["greet"]["user_invocable"]
    assert got["greet"]["allowed_tools"] == ["bad", "list"]
    assert got["other"]["template"] == "plain text" and got["other"]["allowed_tools"] is None


def test_event_log(spark, tmp_path):
    (tmp_path / "log").write_text('{"category":"main","toolResults":["a","b"]}\n\nnoise\n{"category":"side"}\n')
    keep = logs.read_event_log(spark, str(tmp_path / "log"))
    assert sorted((r["category"], r["raw"]) for r in keep.select("category", F.coalesce("raw", F.lit("")).alias("raw")).collect()) == [
        ("PARSE_ERROR", "noise"), ("main", ""), ("side", ""),
    ]
    assert logs.read_event_log(spark, str(tmp_path / "log"), "drop").count() == 2
    assert {r["result"] for r in logs.result_texts(keep).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        logs.read_event_log(spark, "x", "ignore")


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_note_changes(spark, tmp_path):
    folder = str(tmp_path / "notes")
    files = lambda *rows: spark.createDataFrame(list(rows), "folder string, file string, text string")
    notes.write_note_files(files(("a", "x.md", "one"), ("a b/c", "y.md", "two\n"), ("a", "z.md", "é"), ("a", "MEMORY.md", "i")), folder)
    index = notes.note_index(notes.read_markdown_corpus(spark, folder))
    index = spark.createDataFrame(index.collect(), index.schema)
    assert index.count() == 3 and notes.note_changes(spark, folder, index).isEmpty()
    notes.write_note_files(files(("a", "x.md", "one"), ("a b/c", "y.md", "three"), ("a", "z.md", None), ("n", "w.md", "new"), ("a", "MEMORY.md", "j")), folder)
    changes = notes.note_changes(spark, folder, index)
    assert {(r["path"].split("/")[-1], r["status"], r["text"]) for r in changes.collect()} == {("y.md", "changed", "three"), ("z.md", "removed", None), ("w.md", "new", "new")}
    after = spark.createDataFrame(notes.update_index(index, changes).collect(), index.schema)
    assert after.count() == 3 and notes.note_changes(spark, folder, after).isEmpty()
    notes.write_note_files(files(("a", "x.md", None), ("a b/c", "y.md", None), ("n", "w.md", None)), folder)
    assert {r["status"] for r in notes.note_changes(spark, folder, after).collect()} == {"removed"}
