"""Literals, calls and fixed paths in source texts, against character loops and by cases."""

import random

from pyspark.sql import functions as F

from sievehouse.functions import brackets
from sievehouse.operators import modules
from sievehouse.operators import source_code as SRC


def inside_by_hand(text):
    quote, i = None, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif text.startswith(quote, i):
                i += len(quote) - 1
                quote = None
        elif c == "#":
            i = text.find("\n", i)
            if i < 0:
                return False
        elif c in "'\"`":
            quote = c * 3 if text.startswith(c * 3, i) else c
            i += len(quote) - 1
        i += 1
    return quote is not None


def call_by_hand(text):
    at = text.find("(")
    depth, quote, i = 0, "", at
    while 0 <= i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return text[at + 1 : i]
        i += 1
    return ""


def comma_by_hand(text):
    depth, quote, i = 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            return True
        i += 1
    return False


def test_scanners_match_character_loops(spark):
    r = random.Random(3)
    pieces = ["'", '"', "`", '"""', "'''", "```", "\\", "#", "\n", "a", " ", "(", ")", "[", "]", "{", "}", ",", "é"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 22))) for _ in range(3000)] + ["x" * 200_000 + '"' + "y\\n" * 50_000, "(" * 300 + ")" * 300, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    rows = df.select("i", brackets.in_literal(t).alias("inside"), brackets.first_call(t).alias("call"), brackets.has_top_comma(t).alias("comma")).collect()
    for row in rows:
        x = texts[row.i]
        assert row.inside == inside_by_hand(x), repr(x)
        assert row.call == call_by_hand(x), repr(x)
        assert row.comma == comma_by_hand(x), repr(x)
    assert spark.range(1).select(brackets.in_literal(F.lit(None).cast("string")).alias("x")).head().x is False


def test_json_is_indented_as_scripts_do_it(spark):
    import json

    docs = [{}, [], {"a": {}}, {"b": [1, {"c": [], "d": "x, {y}: [z] \" \\"}], "a": None}, {"hooks": {"Pre": [{"m": "Bash", "n": [True, 1.5, "é\n"]}]}}]
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False, separators=(",", ":"))) for i, d in enumerate(docs)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", brackets.indented_json(F.col("t")).alias("x")).collect()}
    assert got == {i: json.dumps(d, ensure_ascii=False, indent=2) for i, d in enumerate(docs)}


def rules_of(spark, text, name="a.js"):
    df = spark.createDataFrame([(name, text)], "file string, text string")
    return {(r.rule, r.line) for r in SRC.rule_findings(SRC.statements(df)).collect()}


HARMLESS = [
    "const a = require('fs')",
    "const c = require(path.join(__dirname, '..', 'generated', 'client'))",
    "const p = require('node:path')\nconst c = require(p.posix.resolve(__dirname, 'x'))",
    "import * as q from 'path/posix'\nrequire(q.join('a', 'b'))",
    "private async require(orgId, id) {",
    "static require(a) {",
    "require(a, b)",
    "const ROOT = path.dirname(__filename);\nconst SRC = `${ROOT}/src`;\nrequire(SRC)",
    "const SRC = `${ROOT}/src`\nconst ROOT = process.cwd()\nawait import(SRC)",
    "import(new URL('./x.mjs', import.meta.url).href)",
    "import(`./fixed.mjs`)",
    "other.require(x)",
    "// require(x)",
]
HIDDEN = [
    ("require(name)", 1),
    ("const m = 'child' + '_process'\nrequire(m)", 2),
    ("import(cfg.modulePath)", 1),
    ("import(name, { with: { type: 'json' } })", 1),
    ("require(path.join(__dirname, name))", 1),
    ("require(`./${kind}.js`)", 1),
    ("const x = 1\nawait import(\n  pick('a)')\n)", 2),
    ("require(f('a, b'))", 1),
    ("const ROOT = path.join(base, 'x')\nrequire(ROOT)", 2),
    ("const $a$ = path.join('x')\nrequire($a)", 2),
]


def test_computed_module_names_are_found_but_fixed_paths_are_not(spark):
    rule = "js.dynamic_require"
    files = [(f"{i}.js", t) for i, t in enumerate(HARMLESS)] + [(f"h{i}.ts", t) for i, (t, _) in enumerate(HIDDEN)]
    df = spark.createDataFrame([*files, ("n.js", None), ("n.py", "require(x)")], "file string, text string")
    found = {(r.file, r.line) for r in SRC.rule_findings(SRC.statements(df)).collect() if r.rule == rule}
    assert found == {(f"h{i}.ts", line) for i, (_, line) in enumerate(HIDDEN)}


def test_names_of_the_path_module_and_of_fixed_paths(spark):
    text = "const p = require(\"path\"), x = 1\nvar u$ = require('node:path/win32')\nimport w from 'path'\nconst A = p.join('a')\nlet B = `${A}/b`;\nconst C = 'plain'\nconst D = u$.join(C)"
    df = spark.createDataFrame([(text,)], "t string").withColumn("p", modules.path_names(F.col("t")))
    row = df.select("p", modules.constant_paths(F.col("t"), F.col("p")).alias("c")).head()
    assert row.p == ["path", "p", "u$", "w"] and row.c == ["A", "B"]


def test_rules_heed_literals_of_all_quotes(spark):
    assert rules_of(spark, "'''Use `trust_remote_code=True` to load it.'''", "a.py") == set()
    assert rules_of(spark, "Use `trust_remote_code=True` to load it.", "a.py") == set()
    assert rules_of(spark, "f(`a`, trust_remote_code=True)", "a.py") == {("python.trust_remote_code", 1)}
    assert rules_of(spark, "f('it''s', # `\n trust_remote_code=True)", "a.py") == {("python.trust_remote_code", 2)}
