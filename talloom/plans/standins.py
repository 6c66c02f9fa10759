"""The given tables read as sessions, calls, files and notes.

Each stand-in exists twice: as a Spark projection and as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from talloom.plans.registry import Tables

# events as a log of tool calls
_TOOL = """CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'grep_search'
 WHEN 'purchase' THEN 'write_file' WHEN 'signup' THEN 'edit_file' ELSE 'run_shell' END"""
_CALLS = f"""SELECT user_id AS session, event_id AS seq, ts, event_type, {_TOOL} AS tool,
 CAST(round(value * 100) AS BIGINT) AS tokens,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
 concat('dir/f', regexp_extract(props, '([0-9]+)', 1)) AS path,
 CASE WHEN value < 5 THEN concat('git push origin ', event_type)
      WHEN value < 10 THEN concat('sudo rm ', event_type)
      ELSE concat('echo ', event_type) END AS command
FROM events"""
# calls with their token classes; the model is the event type
_USAGE = """SELECT session, seq, ts, event_type AS model, tokens AS in_tok, k AS out_tok,
 CAST(floor(tokens / 2) AS BIGINT) AS cache_read, k * 3 AS cache_write FROM calls"""
# documents as files
_FILES = """SELECT doc_id, source, lang, concat(source, '/', doc_id, '.', lang) AS path,
 concat(doc_id, '.', lang) AS file, text FROM documents"""
# documents as notes: with, without and with an unclosed header
_KIND = "CASE lang WHEN 'en' THEN 'user' WHEN 'de' THEN 'feedback' WHEN 'fr' THEN 'other' ELSE 'reference' END"
_NOTES = f"""SELECT doc_id, source, lang, path, file, text AS plain, {_KIND} AS kind,
 CASE WHEN lang = 'es' THEN text
      WHEN source = 'src3' THEN concat('---', chr(10), 'name: open', chr(10), text)
      ELSE concat('---', chr(10), 'name:  Note ', doc_id, chr(10), 'no colon here', chr(10), 'type: first', chr(10),
        'description: ', lang, ': from ', source, chr(10), 'type: ', {_KIND}, chr(10), ' --- ', chr(10), text, chr(10), ' ')
 END AS text
FROM files"""

_DEPENDS = {"usage": ["calls"], "notes": ["files"]}
_SQL = {"calls": _CALLS, "usage": _USAGE, "files": _FILES, "notes": _NOTES}


def ctes(*names: str, more: str = "") -> str:
    """WITH clause giving the named stand-ins to a check."""
    wanted: list[str] = []
    for name in names:
        for n in [*_DEPENDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    parts = [f"{n} AS ({_SQL[n]})" for n in wanted]
    return "WITH " + ", ".join(parts + ([more] if more else [])) + " "


def _select(t: Tables, name: str, source: DataFrame) -> DataFrame:
    head, _, tail = _SQL[name].rpartition("FROM ")
    return t.spark.sql(head + "FROM {src}", src=source)


def calls(t: Tables) -> DataFrame:
    return _select(t, "calls", t.events)


def usage(t: Tables) -> DataFrame:
    return _select(t, "usage", calls(t))


def files(t: Tables) -> DataFrame:
    return _select(t, "files", t.documents.select("doc_id", "source", "lang", "text"))


def notes(t: Tables) -> DataFrame:
    return _select(t, "notes", files(t))
