"""Text columns: cleaning, cutting, quoting, labels and small renderings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms these functions must produce or recognise.
HTML_DROPPED = [r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>"]
HTML_TAG = "<[^>]*>"
HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
SINGLE_QUOTES = "‘’′"
DOUBLE_QUOTES = "“”″"
RESULT_CUT = ("\n\n[... truncated ", " chars ...]\n\n")
BUDGET_CUT = ("\n\n[... budgeted: ", " chars truncated ...]\n\n")
PAGE_CUT = ("\n\n[... truncated at ", " characters]")
EMPTY_PAGE = "(empty response)"
INDEX_LINES_CUT = "\n\n[... truncated, too many memory entries ...]"
INDEX_BYTES_CUT = "\n\n[... truncated, index too large ...]"
NOTE_CUT = "\n\n[... truncated, memory file too large ...]"
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def trim_ws(text: Column) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def html_to_text(html: Column) -> Column:
    text = html
    for pattern in HTML_DROPPED:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, HTML_TAG, " ")
    for entity, plain in HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return trim_ws(F.regexp_replace(text, r"\s{2,}", " "))


def truncate_chars(text: Column, limit: int) -> Column:
    """Cut at a character limit with a note; an empty text becomes a marker."""
    note = f"{PAGE_CUT[0]}{limit}{PAGE_CUT[1]}"
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note)))
    return cut.when(text == "", F.lit(EMPTY_PAGE)).otherwise(text)


def head_tail(text: Column, limit: Column | int, reserve: int, cut=RESULT_CUT) -> Column:
    """Keep equal head and tail of an over-long text around a count of the rest."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    keep = F.floor((limit - reserve) / 2).cast("int")
    removed = (F.length(text) - 2 * keep).cast("string")
    shortened = F.concat(
        F.substr(text, F.lit(1), keep), F.lit(cut[0]), removed, F.lit(cut[1]), F.right(text, keep)
    )
    return F.when(F.length(text) > limit, shortened).otherwise(text)


def normalize_quotes(text: Column) -> Column:
    return F.translate(text, SINGLE_QUOTES + DOUBLE_QUOTES, "'''" + '"""')


def find_actual(text: Column, needle: Column) -> Column:
    """The needle if it occurs, else the slice that equals it up to quote style."""
    at = F.instr(normalize_quotes(text), normalize_quotes(needle))
    return F.when(F.contains(text, needle), needle).when(
        at > 0, F.substr(text, at, F.length(needle))
    )


def count_occurrences(text: Column, needle: Column) -> Column:
    """Occurrences that do not overlap; null for an empty needle."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (removed / F.length(needle)).cast("bigint"))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(lines_of(text), 1, n), "\n")


def preview_lines(text: Column, n: int) -> Column:
    """First lines with a note naming the total when there are more."""
    note = F.concat(F.lit("\n  ... ("), line_count(text).cast("string"), F.lit(" lines total)"))
    return F.when(line_count(text) > n, F.concat(first_lines(text, n), note)).otherwise(text)


def size_kb(text: Column) -> Column:
    """Kilobytes as text with one decimal; the decimal quotient keeps rounding exact."""
    kb = F.octet_length(text).cast("decimal(20,4)") / F.lit(1024).cast("decimal(10,0)")
    return F.round(kb, 1).cast("decimal(20,1)").cast("string")


def numbered(text: Column, width: int = 4) -> Column:
    """The text with line numbers in front; wide numbers are never cut."""
    def line(value: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        padded = F.lpad(number, F.greatest(F.length(number), F.lit(width)), F.lit(" "))
        return F.concat(padded, F.lit(" | "), value)

    return F.array_join(F.transform(lines_of(text), line), "\n")


def diff_hunk(text: Column, old: Column, new: Column) -> Column:
    """One hunk for the first place where old stands in the text."""
    before = F.substr(text, F.lit(1), F.instr(text, old) - 1)
    at = line_count(before).cast("string")

    def span(side: Column) -> Column:
        return F.concat(at, F.lit(","), line_count(side).cast("string"))

    def marked(side: Column, sign: str) -> Column:
        return F.array_join(F.transform(lines_of(side), lambda x: F.concat(F.lit(sign), x)), "\n")

    header = F.concat(F.lit("@@ -"), span(old), F.lit(" +"), span(new), F.lit(" @@"))
    return F.concat_ws("\n", header, marked(old, "- "), marked(new, "+ "))


def slugify(text: Column, width: int = 40) -> Column:
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(joined, r"^_|_\z", ""), 1, width)


def key_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def age_days(at: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    return F.greatest(F.floor(seconds / 86400), F.lit(0)).cast("bigint")


def age_label(at: Column, now: Column) -> Column:
    days = age_days(at, now)
    named = F.when(days == 0, "today").when(days == 1, "yesterday")
    return named.otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def freshness_note(at: Column, now: Column, template: str) -> Column:
    """The template with {days} filled in, empty up to one day."""
    days = age_days(at, now)
    filled = F.replace(F.lit(template), F.lit("{days}"), days.cast("string"))
    return F.when(days <= 1, "").otherwise(filled)


def manifest_line(kind: Column, file: Column, at: Column, description: Column) -> Column:
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    tag = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("["), kind, F.lit("] "))).otherwise("")
    tail = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(": "), description)).otherwise("")
    return F.concat(F.lit("- "), tag, file, F.lit(" ("), stamp, F.lit(")"), tail)


def wrap_block(tag: str, header: Column, text: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), header, F.lit("\n\n"), text, F.lit(f"\n</{tag}>"))


def fill_template(text: Column, values: Mapping[str, Sequence[str]], columns: Mapping[str, Column]) -> Column:
    """Replace every spelling of every variable by its column, literally."""
    for name, spellings in values.items():
        for spelling in spellings:
            text = F.replace(text, F.lit(spelling), columns[name])
    return text


def parse_list(text: Column) -> Column:
    """A JSON array, or a comma list with optional brackets around it."""
    plain = F.transform(F.split(text, ",", -1), trim_ws)
    bare = F.transform(F.split(F.regexp_replace(text, r"[\[\]]", ""), ",", -1), trim_ws)
    parsed = F.from_json(text, "array<string>")
    return F.when(F.startswith(text, F.lit("[")), F.coalesce(parsed, bare)).otherwise(plain)


def flag_default_true(text: Column) -> Column:
    return ~text.eqNullSafe(F.lit("false"))


def first_json_object(text: Column) -> Column:
    """From the first { to the last }, as a variant; null if it does not parse."""
    return F.try_parse_json(json_object_text(text))


def json_object_text(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def prefix_verdict(text: Column, yes: str, no: str) -> Column:
    """ok if the trimmed text starts with yes; otherwise a reason without no."""
    trimmed = trim_ws(text)
    ok = F.startswith(trimmed, F.lit(yes))
    reason = F.when(ok, F.lit("")).otherwise(trim_ws(F.replace(trimmed, F.lit(no), F.lit(""))))
    return F.struct(ok.alias("ok"), reason.alias("reason"))


def split_command(text: Column) -> Column:
    """`/name rest` as name and trimmed rest; null for anything else."""
    name = F.regexp_extract(text, r"(?s)^/([^ ]*) ?(.*)\z", 1)
    rest = trim_ws(F.regexp_extract(text, r"(?s)^/([^ ]*) ?(.*)\z", 2))
    return F.when(F.startswith(text, F.lit("/")), F.struct(name.alias("name"), rest.alias("rest")))


def call_summary(tool: Column, path: Column, pattern: Column, command: Column) -> Column:
    """Short text of a call for listings."""
    short = F.when(F.length(command) > 60, F.concat(F.substring(command, 1, 60), F.lit("..."))).otherwise(command)
    where = F.concat(F.lit('"'), pattern, F.lit('" in '), F.coalesce(path, F.lit(".")))
    return (
        F.when(tool.isin("read_file", "write_file", "edit_file"), path)
        .when(tool == "list_files", pattern)
        .when(tool == "grep_search", where)
        .when(tool == "run_shell", short)
        .otherwise("")
    )


def backoff_ms(attempt: Column, base: int = 1000, ceiling: int = 30000) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(float(ceiling))).cast("bigint")


def is_substantial(text: Column) -> Column:
    trimmed = trim_ws(text)
    return F.coalesce((F.regexp_count(trimmed, F.lit(CJK)) >= 2) | F.rlike(trimmed, F.lit(r"\s")), F.lit(False))


def split_namespace(name: Column) -> Column:
    """`prefix__server__tool` as server and tool; null below three parts."""
    parts = F.split(name, "__", -1)
    tool = F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "__")
    made = F.struct(F.get(parts, F.lit(1)).alias("server"), tool.alias("tool"))
    return F.when(F.size(parts) >= 3, made)


def cap_index(text: Column, max_lines: int = 200, max_bytes: int = 25000) -> Column:
    """Cut by lines, then by size; the size test is in bytes, the cut in characters."""
    by_lines = F.when(
        line_count(text) > max_lines, F.concat(first_lines(text, max_lines), F.lit(INDEX_LINES_CUT))
    ).otherwise(text)
    by_bytes = F.concat(F.substring(by_lines, 1, max_bytes), F.lit(INDEX_BYTES_CUT))
    return F.when(F.octet_length(by_lines) > max_bytes, by_bytes).otherwise(by_lines)


def cap_note(text: Column, max_bytes: int = 4096) -> Column:
    cut = F.concat(F.substring(text, 1, max_bytes), F.lit(NOTE_CUT))
    return F.when(F.octet_length(text) > max_bytes, cut).otherwise(text)


def lookup_ordered(text: Column, rules: Sequence[tuple[Sequence[str], object]], default) -> Column:
    """First rule in order with all its substrings present gives the value."""
    lowered = F.lower(text)
    chosen = None
    for needles, value in rules:
        test = F.lit(True)
        for needle in needles:
            test = test & F.contains(lowered, F.lit(needle))
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return F.lit(default) if chosen is None else chosen.otherwise(F.lit(default))
