"""Text and policy functions against plain Python on made-up edge cases."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from talloom.functions import frontmatter, predicates, text
from talloom.operators import corpus, policy


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(7)
    alphabet = ["a", "b", "é", "漢", " ", "\n", "\t", "'", "’", '"', "“", ":", "-", "---", "\n---\n", "[", "]", ",", "key: v\n", "$1", "\\", "{", "}"]
    return [""] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def _apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.select("i", column.alias("y")).orderBy("i").select("y").collect()]


def test_head_tail(spark, strings):
    def plain(x, limit=20, reserve=4):
        keep = (limit - reserve) // 2
        if len(x) <= limit:
            return x
        return x[:keep] + f"\n\n[... truncated {len(x) - 2 * keep} chars ...]\n\n" + x[-keep:]

    assert _apply(spark, strings, text.head_tail(F.col("x"), 20, 4)) == [plain(x) for x in strings]


def test_find_actual(spark, strings):
    quotes = str.maketrans({c: "'" for c in "‘’′"} | {c: '"' for c in "“”″"})

    def plain(x, needle="a'"):
        if needle in x:
            return needle
        at = x.translate(quotes).find(needle)
        return x[at:at + len(needle)] if at >= 0 else None

    assert _apply(spark, strings, text.find_actual(F.col("x"), F.lit("a'"))) == [plain(x) for x in strings]


def test_count_lines_and_numbers(spark, strings):
    assert _apply(spark, strings, text.count_occurrences(F.col("x"), F.lit("ab"))) == [x.count("ab") for x in strings]
    assert _apply(spark, strings, text.line_count(F.col("x"))) == [x.count("\n") + 1 for x in strings]
    want = ["\n".join(f"{i:4d} | {line}" for i, line in enumerate(x.split("\n"), 1)) for x in strings]
    assert _apply(spark, strings, text.numbered(F.col("x"))) == want
    assert _apply(spark, strings, text.first_lines(F.col("x"), 2)) == ["\n".join(x.split("\n")[:2]) for x in strings]


def test_frontmatter(spark, strings):
    def plain(x):
        lines = x.split("\n")
        if lines[0].strip() != "---":
            return {}, x
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if end is None:
            return {}, x
        meta = {}
        for line in lines[1:end]:
            key, colon, value = line.partition(":")
            if colon and key.strip():
                meta[key.strip()] = value.strip()
        return meta, "\n".join(lines[end + 1:]).strip()

    values = strings + ["---\n" + x for x in strings] + ["---\n---", "---\n---\n", " --- \na: 1\na: 2\n\t---\t\nb", "---", "---\nx"]
    got = _apply(spark, values, frontmatter.parse_frontmatter(F.col("x")))
    assert [(r["meta"], r["body"]) for r in got] == [plain(x) for x in values]


def test_very_long_unclosed_header(spark):
    x = "---\n" + "key: value\n" * 200_000
    got = _apply(spark, [x], frontmatter.parse_frontmatter(F.col("x")))[0]
    assert got["meta"] == {} and got["body"] == x


def test_slugify(spark, strings):
    def plain(x):
        return re.sub(r"^_|_$", "", re.sub("[^a-z0-9]+", "_", x.lower()))[:40]

    assert _apply(spark, strings, text.slugify(F.col("x"))) == [plain(x) for x in strings]


def test_parse_list_and_command(spark):
    values = ['["a", "b,c"]', "[a, b", "a , b,,c", "[]", '[1, "x"]', "one"]
    assert _apply(spark, values, text.parse_list(F.col("x"))) == [
        ["a", "b,c"], ["a", "b"], ["a", "b", "", "c"], [], ["1", "x"], ["one"],
    ]
    got = _apply(spark, ["/go  now \n", "/go", "go", "/", "/a\nb c"], text.split_command(F.col("x")))
    assert [None if r is None else tuple(r) for r in got] == [("go", "now"), ("go", ""), None, ("", ""), ("a\nb", "c")]


def test_html(spark):
    page = "<script>x</script >y</SCRIPT><Style\n>p</style>&amp;lt;b&gt; &nbsp;&quot;<p\nclass='a'>t\n\n u</p>"
    assert _apply(spark, [page, "", "<b>"], text.html_to_text(F.col("x"))) == ['<b> " t u', "", ""]


def test_templates_are_literal(spark):
    filled = text.fill_template(F.col("x"), {"a": ["$A", "${A}"]}, {"a": F.lit("$1\\")})
    assert _apply(spark, ["$A ${A} $B"], filled) == ["$1\\ $1\\ $B"]


def test_wide_line_numbers(spark):
    got = _apply(spark, ["\n".join(["x"] * 10001)], text.numbered(F.col("x")))[0].split("\n")
    assert got[0] == "   1 | x" and got[-1] == "10001 | x"


@pytest.mark.parametrize("pattern", ["*.py", "a?c", "[x].py", "a.b*", "*"])
def test_name_patterns(pattern):
    for name in ["a.py", "abc", "x.py", "[x].py", "a.bc", "axb", ""]:
        want = fnmatch.fnmatchcase(name, pattern)
        assert bool(re.match(predicates.name_regex(pattern).replace(r"\z", r"\Z"), name)) == want


def test_globs(spark):
    rows = spark.createDataFrame([(p,) for p in ["a.py", "d/a.py", "d/e/a.py", "d/.h/a.py", "d/node_modules/a.py", "my_node_modules_x.py", ".a.py"]], "path string")

    def listed(glob):
        return {r["path"] for r in corpus.list_paths(rows, glob).collect()}

    assert listed("*.py") == {"a.py", "my_node_modules_x.py"}
    assert listed("**/*.py") == {"a.py", "my_node_modules_x.py", "d/a.py", "d/e/a.py"}
    assert listed("d/*.py") == {"d/a.py"} and listed("d/**") == {"d/a.py", "d/e/a.py"}


@pytest.mark.parametrize("pattern", ["^a", "b$", "a.c", r"\bx", r"foo(?!\s)", r"\Aa", "a*+b"])
def test_grep_equals_a_line_loop(spark, pattern):
    texts = ["abc\nxa\nfoo\n", "b\n\nfoo bar\nab", "", "zzz\nax\na c", "aab\nx"]
    rows = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(texts)], "path string, text string")
    got = {(r["path"], r["line_no"]) for r in corpus.grep(rows, pattern).collect()}
    want = {(f"f{i}", n) for i, x in enumerate(texts) for n, line in enumerate(x.split("\n"), 1) if re.search(pattern, line)}
    assert got == want


DECISIONS = [
    # tool, value, mode, action
    ("run_shell", "rm x", "bypassPermissions", "deny"), ("run_shell", "ls", "plan", "deny"), ("write_file", "plan.md", "plan", "allow"),
    ("write_file", "old.py", "plan", "deny"), ("edit_file", "old.py", "default", "allow"), ("edit_file", "new.py", "default", "confirm"),
    ("write_file", "new.py", "acceptEdits", "allow"), ("write_file", "new.py", "dontAsk", "deny"), ("read_file", "secret", "default", "deny"),
    ("read_file", "x", "plan", "allow"), ("run_shell", "sudo ls", "default", "confirm"), ("run_shell", "sudo ls", "bypassPermissions", "allow"),
    ("run_shell", "git push now", "default", "allow"), ("web_fetch", None, "plan", "allow"), ("exit_plan_mode", None, "plan", "allow"),
    ("agent", None, "default", "allow"), ("run_shell", "git push now", "plan", "deny"),
]


def test_decisions(spark):
    calls = spark.createDataFrame([(i, *d[:3]) for i, d in enumerate(DECISIONS)], "i int, tool string, value string, mode string")
    rules = policy.parse_rules(spark.createDataFrame(
        [("deny", "run_shell(rm *)"), ("deny", "read_file(secret)"), ("allow", "run_shell(git push*)"), ("allow", "run_shell(rm *)")], "effect string, rule string"
    ))
    existing = spark.createDataFrame([("old.py",), ("old.py",)], "path string")
    got = policy.decide(calls, rules, existing, plan_file="plan.md").orderBy("i").select("decision.action").collect()
    assert [r[0] for r in got] == [d[3] for d in DECISIONS]


def test_includes(spark):
    files = {
        "/p/main": "top\n@./a\n@/p/gone\nend", "/p/a": "A\n@./b\n@~/c", "/p/b": "B\n@/p/a", "/h/c": "C", "/p/self": "@./self",
        **{f"/d/{i}": f"{i}\n@./{i + 1}" for i in range(8)},
    }
    rows = spark.createDataFrame(list(files.items()), "path string, text string")
    got: dict = {}
    for r in corpus.expand_includes(rows, home="/h").orderBy("root", "position").collect():
        got.setdefault(r["root"], []).append(r["line"])
    assert got["/p/main"] == ["top", "A", "B", "<!-- circular: /p/a -->", "C", "<!-- not found: /p/gone -->", "end"]
    assert got["/p/self"] == ["<!-- circular: ./self -->"]
    assert got["/d/0"] == ["0", "1", "2", "3", "4", "5", "@./6"]
    assert got["/d/6"] == ["6", "7", "<!-- not found: ./8 -->"]


def test_recall_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i:02d}" for i in range(30)] + ["le", "été"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in rng.sample(range(10_000), 300)]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))) for i in range(25)]
    split = lambda x: {w for w in re.split(r"\W+", x.lower()) if len(w) > 2}
    want = set()
    for q, x in asked:
        scored = sorted((-len(split(x) & split(d)), i) for i, d in docs if split(x) & split(d))
        want |= {(q, i, -s) for s, i in scored[:3]}
    queries = spark.createDataFrame(asked, "query_id bigint, text string")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = corpus.recall_by_overlap(queries, rows)
    assert {(r["query_id"], r["doc_id"], r["score"]) for r in got.collect()} == want


@pytest.mark.parametrize("pattern", ["^$", r"^\s*$", "b", "^b", "c$", "x*", r"\bb", "(?i)B", "b+"])
def test_grep_equals_a_line_loop(spark, pattern):
    texts = {"/a": "abc\n", "/b": "", "/c": "x\n\nb c\n \n", "/d": "B", "/e": "\n"}
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    want = {(p, n, x) for p, t in texts.items() for n, x in enumerate(t.split("\n"), 1) if re.search(pattern, x)}
    assert {tuple(r) for r in corpus.grep(rows, pattern).collect()} == want


@pytest.mark.parametrize("glob, want", [
    ("*.{ts,tsx}", {"a.ts", "b.tsx"}), ("[ab].*", {"a.ts", "b.tsx"}), ("[!a].t*", {"b.tsx", "c.txt"}), ("**/{x,y/z}.py", {"x.py", "d/x.py", "d/y/z.py"}),
    ("{solo}", {"{solo}"}), ("d/[x-z]*", {"d/x.py"}),
])
def test_globs(spark, glob, want):
    paths = ["a.ts", "b.tsx", "c.txt", "x.py", "d/x.py", "d/y/z.py", "{solo}"]
    rows = spark.createDataFrame([(p, "") for p in paths], "path string, text string")
    assert {r[0] for r in corpus.list_paths(rows, glob).collect()} == want


def test_base_folder_and_parent_includes(spark):
    rows = spark.createDataFrame(
        [("/p/q/main", "@./../shared\n@/p//q/./leaf"), ("/p/shared", "S"), ("/p/q/leaf", "L"), ("/pq/leaf", "M")], "path string, text string"
    )
    assert {r[0] for r in corpus.list_paths(rows, "**/leaf", base="/p").collect()} == {"/p/q/leaf"}
    assert {r["path"] for r in corpus.grep(rows, "[LM]", base="/p/").collect()} == {"/p/q/leaf"}
    lines = corpus.expand_includes(rows).filter("root = '/p/q/main'").orderBy("position").collect()
    assert [r["line"] for r in lines] == ["S", "L"]
