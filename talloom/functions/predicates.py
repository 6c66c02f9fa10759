"""Boolean columns and class tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tool classes, retry conditions and command patterns.
READ_TOOLS = ["read_file", "list_files", "grep_search", "web_fetch"]
EDIT_TOOLS = ["write_file", "edit_file"]
PARALLEL_TOOLS = ["read_file", "list_files", "grep_search", "web_fetch"]
SNIPPABLE_TOOLS = ["read_file", "grep_search", "list_files", "run_shell"]
READ_ONLY_TOOLS = ["read_file", "list_files", "grep_search"]
RETRY_STATUS = [429, 503, 529]
RETRY_CODES = ["ECONNRESET", "ETIMEDOUT"]
RETRY_WORD = "overloaded"
DANGEROUS_COMMANDS = {
    "rm": r"\brm\s",
    "git": r"\bgit\s+(push|reset|clean|checkout\s+\.)",
    "sudo": r"\bsudo\b",
    "mkfs": r"\bmkfs\b",
    "dd": r"\bdd\s",
    "device": r">\s*/dev/",
    "kill": r"\bkill\b",
    "pkill": r"\bpkill\b",
    "reboot": r"\breboot\b",
    "shutdown": r"\bshutdown\b",
    "del": r"(?i)\bdel\s",
    "rmdir": r"(?i)\brmdir\s",
    "format": r"(?i)\bformat\s",
    "taskkill": r"(?i)\btaskkill\s",
    "remove-item": r"(?i)\bRemove-Item\s",
    "stop-process": r"(?i)\bStop-Process\s",
}
VENDOR_FOLDER = "node_modules"

TOOL_CLASSES = {
    "read": READ_TOOLS,
    "edit": EDIT_TOOLS,
    "parallel": PARALLEL_TOOLS,
    "snippable": SNIPPABLE_TOOLS,
}


def tag_class(tool: Column, classes: Mapping[str, Sequence[str]] = TOOL_CLASSES) -> Column:
    """Names of the classes the tool belongs to."""
    tests = [F.when(tool.isin(*members), name) for name, members in classes.items()]
    return F.array_compact(F.array(*tests))


def matching_patterns(text: Column, patterns: Mapping[str, str] = DANGEROUS_COMMANDS) -> Column:
    """Ids of the patterns found in the text."""
    return F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), n) for n, p in patterns.items()]))


def matches_any(text: Column, patterns: Mapping[str, str] = DANGEROUS_COMMANDS) -> Column:
    found = F.lit(False)
    for pattern in patterns.values():
        found = found | F.rlike(text, F.lit(pattern))
    return F.coalesce(found, F.lit(False))


def is_retryable(status: Column, code: Column, message: Column) -> Column:
    hit = status.isin(*RETRY_STATUS).eqNullSafe(F.lit(True))
    hit = hit | code.isin(*RETRY_CODES).eqNullSafe(F.lit(True))
    return hit | F.contains(message, F.lit(RETRY_WORD)).eqNullSafe(F.lit(True))


def is_http(url: Column) -> Column:
    return F.rlike(url, F.lit("(?i)^https?://"))


def visible_path(path: Column) -> Column:
    """No part of the path is hidden or the vendor folder."""
    return ~F.rlike(path, F.lit(rf"(^|/)(\.[^/]*|{VENDOR_FOLDER})(/|\z)"))


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regex; `**/` spans folders, `*` does not; with `{a,b}` and `[a-z]`."""
    return "^" + _glob_body(glob, "[^/]*", "[^/]", spans=True) + r"\z"


def name_regex(pattern: str) -> str:
    """A file-name pattern as an anchored regex."""
    return "^" + _glob_body(pattern, ".*", ".", spans=False) + r"\z"


def _glob_body(glob: str, many: str, one: str, spans: bool) -> str:
    out, i, open_braces = [], 0, 0
    while i < len(glob):
        char, step = glob[i], 1
        if spans and glob.startswith("**/", i):
            part, step = "(?:[^/]+/)*", 3
        elif spans and glob.startswith("**", i):
            part, step = ".*", 2
        elif char in "*?":
            part = many if char == "*" else one
        elif char == "[" and (end := glob.find("]", i + 2)) > 0:
            negated = glob[i + 1] in "!^"
            members = glob[i + 1 + negated : end]
            part = "[" + ("^" if negated else "") + "".join(c if c == "-" or c.isalnum() else "\\" + c for c in members) + "]"
            step = end + 1 - i
        elif char == "{" and _closing(glob, i):
            part, open_braces = "(?:", open_braces + 1
        elif char == "}" and open_braces:
            part, open_braces = ")", open_braces - 1
        elif char == "," and open_braces:
            part = "|"
        else:
            part = _literal(char)
        out.append(part)
        i += step
    return "".join(out)


def _closing(glob: str, start: int) -> bool:
    """Whether the brace at `start` is closed and holds a comma; else it is a plain character."""
    depth, comma = 0, False
    for char in glob[start:]:
        depth += (char == "{") - (char == "}")
        comma |= char == "," and depth == 1
        if not depth:
            return comma
    return False


def _literal(char: str) -> str:
    return char if char.isalnum() or char in "_-/ " else "\\" + char
