"""Registered queries on small tables, against brute force in Python: nothing of the job may be left out."""

import json
import re

import pytest

from sievehouse.operators import acquire, inventory, usage
from sievehouse.plans import inventory_queries, more_queries, queries
from sievehouse.plans import signals as S

#: Ids whose documents get no snippet.
FREE = [i for i in range(4 * queries.SLOTS) if i % queries.SLOTS >= len(queries.OVERLAY)]


@pytest.fixture
def table(spark, tmp_path):
    """Writes documents, on free ids in order, and returns the folder and the texts by id as the queries see them."""

    def write(texts):
        rows = list(zip(FREE, texts, strict=False))
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
        labels = [(i, 1, 0) for i, _ in rows]
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path), {i: t + "\n" for i, t in rows}

    return write


def first_match(s, text):
    return re.search(s.pattern, text, re.ASCII | (re.IGNORECASE if s.fold else 0))


def line_of(text, m):
    return text.count("\n", 0, m.start()) + 1


DATABASE_URL = next(s for s in S.SECRETS if s.name == "Database URL with password")
URLS = [
    "postgres://svc:" + "hunter22@db/x",
    "mysql://root:" + "password@h first\nREDIS://app:" + "s3cr3tpw@cache",
    "postgres://user:" + "pass@db",
    "amqp://app:" + "changeme@q",
    "mongodb+srv://svc:" + "abc@h",
    "nothing here",
]


def test_database_urls_are_in_every_credential_query(spark, table):
    sf_dir, docs = table(URLS)
    label = f"Live credential: {DATABASE_URL.name}"
    want = {}
    for i, t in docs.items():
        m = first_match(DATABASE_URL, t)
        if m and not any(re.search(p, m.group().lower()) for p in S.PLACEHOLDERS):
            want[i] = line_of(t, m)
    assert want == {FREE[0]: 1, FREE[1]: 2}
    assert {(r.doc_id, r.label, r.severity, r.line) for r in queries.secret_scan(spark, sf_dir).collect()} == {(i, label, "CRITICAL", n) for i, n in want.items()}
    graded = {r.doc_id: (r.verdict, r.risk_score, r.n_findings) for r in queries.doc_verdict(spark, sf_dir).collect()}
    assert graded == {i: ("BLOCK", 70, 1) if i in want else ("ALLOW", 0, 0) for i in docs}
    assert {(r.doc_id, r.label) for r in queries.top_finding(spark, sf_dir).collect()} == {(i, label) for i in want}
    assert {(r.verdict, r.n, r.risk) for r in queries.verdict_by_label(spark, sf_dir).collect()} == {("BLOCK", 2, 140), ("ALLOW", 4, 0)}
    reported = [json.loads(r.result) for r in more_queries.secret_report(spark, sf_dir).collect()]
    assert {x["message"]["text"] for x in reported} == {label}


CODE = ["eval('1')", "x\nexec (`ls`)", "db.exec('x')", "my-eval(\"1\")", "evaluate('1')", "a:eval('1')\nEVAL(\"2\")"]
CONCEALED = ["never tell the user", "Do it\nwithout informing  the owner.", "don't mention this to the user's team", "never tell the user how to log in", "never tell the user to stop; without notifying users", "do not never reveal it to humans"]


@pytest.mark.parametrize("name, rule, texts, negatable", [("inline_eval", S.INLINE_EVAL, CODE, False), ("conceal_action", S.CONCEAL, CONCEALED, True)])
def test_rules_with_lookaround_have_queries_of_their_own(spark, table, name, rule, texts, negatable):
    sf_dir, docs = table(texts)
    signal = next(s for s in [*S.SHELL, *S.INJECTIONS] if s.name == rule)
    want = set()
    for i, t in docs.items():
        m = first_match(signal, t)
        if m and not (negatable and re.search(S.NEGATED.replace("$", r"\Z"), t[: m.start()][-20:], re.IGNORECASE)):
            want.add((i, rule, "HIGH", line_of(t, m)))
    assert 0 < len(want) < len(docs)
    assert {(r.doc_id, r.label, r.severity, r.line) for r in queries.QUERIES[name](spark, sf_dir).collect()} == want


def test_each_rule_is_in_the_query_of_its_category():
    """Those with a look around, which have queries of their own besides, included."""
    for name, rules in (("shell_scan", S.SHELL), ("injection_scan", S.INJECTIONS), ("doc_verdict", [*S.SHELL, *S.INJECTIONS])):
        assert all(queries._quote(s.name) in queries.SQL[name] for s in rules)
    assert {"force_delete", "inline_eval", "conceal_action"} <= queries.QUERIES.keys()


def test_report_of_all_documents(spark, table):
    sf_dir, docs = table([URLS[0]] * 6)
    assert {i % 3 for i in docs} == {0, 1, 2}
    got = {(r.path, r.changed, json.loads(r.result)["level"]) for r in more_queries.secret_report_all(spark, sf_dir).collect()}
    assert got == {(f"f{i}", i % 3 < 2, "error") for i in docs}


def test_marks_of_changed_files(spark):
    files = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "path string")
    changed = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "path string")
    got = acquire.mark_changed(files, changed).collect()
    assert sorted((r.path or "", r.changed) for r in got) == [("", False), ("a", True), ("a", True), ("b", False)]


def test_rollup_has_the_first_sites(spark):
    rows = [(f"f{i % 7}.py", i // 7 + 1, 1, "openai" if i % 9 else "cohere", "import" if i % 2 else "call") for i in range(140)]
    found = spark.createDataFrame(rows, "file string, line int, ord int, provider string, kind string").selectExpr("*", "'L' as label", "'c' as category", "'v' as via", "'x' as code", "null as model")
    out = {r.provider: r for r in usage.rollup(found).collect()}
    for p in ("openai", "cohere"):
        want = sorted((f, n, k) for f, n, _, q, k in rows if q == p)
        assert out[p].sightings == len(want)
        assert [(x.file, x.line, x.kind) for x in out[p].sites] == want[:60]


def test_dependencies_are_read_from_the_text(spark, table):
    own = ['prose\n{"dependencies": {"langchain": "1"}}\nopenai', "prose of tiktoken\nvLLM==2\n# transformers", "my-openai", "nothing"]
    sf_dir, docs = table(own)
    want = set()
    for i, text in docs.items():
        manifest = json.loads(inventory_queries._NPM[i % 5])
        for kind in inventory.DEPENDENCIES:
            named = manifest.get(kind) or {}
            want |= {("npm", k, f"{i:012d}/package.json") for k in named if isinstance(named, dict) and (k in inventory.NPM_LIBRARIES or k.startswith(tuple(inventory.NPM_PREFIXES)))}
        snippets = inventory_queries._PIP + inventory_queries._LIST
        whole = (text + "\n" + snippets[i % len(snippets)]).lower()
        want |= {("pip", k, f"{i:012d}/{inventory_queries._NAMES[i % 5]}") for k in inventory.PIP_LIBRARIES if re.search(rf"(?<![a-z0-9_.-]){re.escape(k)}(?![a-z0-9_.-])", whole)}
    assert any(k == "vllm" and where.startswith(f"{FREE[1]:012d}") for _, k, where in want)
    got = inventory_queries.dependency_rollup(spark, sf_dir).collect()
    assert {(r.ecosystem, r.package, m) for r in got for m in r.manifests.split(",")} == want
    assert all(r.n_manifests == len(r.manifests.split(",")) for r in got)


def test_all_modules_of_an_import_count(spark):
    from sievehouse.operators import usage

    df = spark.createDataFrame([("a.py", "import os, openai\nimportant = 1\nfrom langchain.llms import x"), ("b.py", None), ("c.py", "")], "file string, text string")
    assert sorted((r.provider, r.line, r.via) for r in usage.sightings(df).collect()) == [("langchain", 3, "langchain.llms"), ("openai", 1, "openai")]


def test_sites_are_shown_by_name_and_calls_first(spark):
    files = [("B.py", "import openai\nx = OpenAI(model='m')"), ("a.py", "import openai"), ("é.py", "import openai"), ("b.py", "from anthropic import x"), ("_c.py", "import openai")]
    out = usage.in_shown_order(usage.sightings(spark.createDataFrame(files, "file string, text string"))).collect()
    got = [(r.provider, r.file, r.kind) for r in sorted(out, key=lambda r: (r.provider_place, r.place))]
    assert got == [("anthropic", "b.py", "import"), ("openai", "_c.py", "import"), ("openai", "a.py", "import"), ("openai", "B.py", "call"), ("openai", "B.py", "import"), ("openai", "é.py", "import")]


def test_fences_are_cut_in_the_row(spark):
    import random

    from sievehouse.functions import text as X

    r = random.Random(2)
    texts = ["\n".join(r.choice(["```", "  ~~~x", "a", "", "``", "x ```"]) for _ in range(r.randrange(0, 12))) for _ in range(300)] + [None, "", "```\n" * 4000, "a\r\n```\r\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lines = X.explode_fenced(df)
    want = set()
    for i, t in enumerate(texts):
        inside = False
        for n, line in enumerate((t or "").replace("\r\n", "\n").split("\n"), 1):
            mark = line.strip(" ").startswith(("```", "~~~"))
            inside ^= mark
            want.add((i, n, line, mark or inside))
    assert {tuple(x) for x in lines.collect()} == want
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
