"""Keys, artifacts and policies on small tables with nulls, ties, repeats and clashing names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievehouse.operators import artifacts, keys, policy
from sievehouse.operators import findings as FN

KEY = "A1b2C3d4E5f6G7h8I9j0K1"


def rows(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=repr)


def test_environment_keys(spark):
    text = f"X=1\nTOKEN=gsk_{KEY}\nTOKEN=hf_{KEY}\nHF_TOKEN=${{HF}}\nMY_AI_API_KEY='abcdefghi'\nAI_KEY=abcdefghi\nOPENAI_API_KEY=example-key"
    files = spark.createDataFrame([("a", text), ("a", text), ("b", None), ("c", ""), ("d", "x" * 200_000)], "path string, text string")
    assert rows(keys.environment_keys(files)) == [("a", "MY_AI_API_KEY", "unknown", "abc…hi"), ("a", "TOKEN", "groq", "gsk…K1")]
    assert keys.environment_keys(files.limit(0)).count() == 0
    env = spark.createDataFrame([("HF_TOKEN", "abcdefgh"), ("TOKEN", f"hf_{KEY}"), ("A_API_KEY", f"hf_{KEY}"), ("OPENAI_API_KEY", "short"), ("OPENAI_API_KEY", None), (None, "abcdefghi")], "name string, value string")
    assert rows(keys.process_keys(env), "name", "vendor") == [("A_API_KEY", "huggingface"), ("HF_TOKEN", "huggingface")]


@pytest.mark.parametrize("value,host", [("https://a.b:1/x", "a.b"), ("'q.Example.com:80'", "q.Example.com"), ("http://user:pw@h.io", "user"), ("localhost", None), ("", None), (None, None), ("a b.com", None)])
def test_endpoint_host(spark, value, host):
    assert spark.createDataFrame([(value,)], "v string").select(keys.endpoint_host(F.col("v"))).first()[0] == host


def test_vector_stores(spark):
    npm = json.dumps({"dependencies": {"@qdrant/x": "1", "chromadb": "1"}, "devDependencies": {"chromadb": "2"}})
    manifests = spark.createDataFrame([("a/package.json", npm), ("b/requirements.txt", "use FAISS-cpu here, not faiss-cpux\npinecone"), ("c/package.json", "{"), ("d/requirements.txt", None), ("a/package.json", npm)], "path string, text string")
    assert rows(keys.vector_clients(manifests), "engine", "hosted", "n_manifests", "manifests") == [("chroma", False, 1, "a/package.json"), ("faiss", False, 1, "b/requirements.txt"), ("pinecone", True, 1, "b/requirements.txt"), ("qdrant", True, 1, "a/package.json")]
    env = spark.createDataFrame([("e", "QDRANT_API_KEY=k\nCHROMA_HOST=your.host.io\nMILVUS_URI=" + "\nMILVUS_HOST=m"), ("f", "QDRANT_URL=https://q.io"), ("g", None)], "path string, text string")
    assert rows(keys.vector_endpoints(env)) == [("milvus", False, True, "", "e"), ("qdrant", True, True, "q.io", "e,f")]
    used = spark.createDataFrame([("chromadb",), ("openai",), ("@qdrant/y",)], "package string")
    assert rows(keys.without_vector(used)) == [("openai",)]


def test_assets_keep_the_first_of_clamped_identifiers(spark):
    long = "x" * 2000
    part = spark.createDataFrame([("T", "n1", long, "v"), ("T", "n2", long + "y", "v"), ("T", "k", None, "v"), ("T", "k", None, "w")], "type string, name string, identifier string, vendor string")
    found = rows(keys.assets(part, part.withColumn("vendor", F.lit("late"))), "name", "vendor")
    assert found == [("k", "v"), ("n1", "v"), ("n2", "v")]


def test_kinds_and_vendors_of_paths(spark):
    cases = [
        (".x/skills/a/SKILL.md", "cursor", "skill"), (".x\\settings.json", "cursor", "hook"), (".x/subagents/a.md", "cursor", "subagent"), (".x/agents/a.txt", "cursor", None), (".x/commands/a.toml", "cursor", "command"),
        (".github/workflows/a.md", "copilot", None), (".github/prompts/a.md", "copilot", "command"), (".github/chatmodes/a.md", "copilot", "subagent"), (".x/chatmodes/a.md", "cursor", None), (".x/prompts/a.md", None, "command"), (None, "cursor", None), ("", "cursor", None),
    ]
    df = spark.createDataFrame([(p, v) for p, v, _ in cases], "path string, vendor string")
    assert [r[0] for r in df.select(artifacts.artifact_kind(F.col("path"), F.col("vendor"))).collect()] == [k for _, _, k in cases]
    paths = spark.createDataFrame([("/h/.cursor/mcp.json",), ("/h/.zed/x",), ("/h/x",), (None,)], "p string")
    assert [r[0] for r in paths.select(artifacts.vendor_of_path(F.col("p"))).collect()] == ["cursor", "zed", "project", "project"]


def test_artifacts_names_hooks_and_caps(spark):
    files = [
        (1, "m", ".c/settings.json", "c", '{"hooks": {"B": [1], "A": {}} /* x */, "z": "secret"}'), (2, "m", ".c/settings.json", "c", '{"hooks": {}}'), (3, "m", ".c/hooks.json", "c", "{"), (4, "m", ".c/skills/deep/SKILL.md", "c", "---\nname: \"Named\"\n---\n"),
        (5, "m", ".c/skills/deep/SKILL.md", "c", "plain"), (6, "n", ".c/agents/Rev.md", "c", ""), (7, "n", ".c/agents/None.md", "c", None), (8, None, ".c/agents/" + "p" * 1100 + ".md", "c", "name: no"),
    ]
    df = spark.createDataFrame(files, "id int, machine string, path string, vendor string, text string").withColumn("extra", F.lit(1))
    found = artifacts.artifacts(df)
    assert [tuple(r) for r in found.orderBy("id").select("id", "kind", "name", "content").collect()][:4] == [(1, "hook", "settings.json · hooks", '{\n  "hooks": {\n    "B": [\n      1\n    ],\n    "A": {}\n  }\n}'), (4, "skill", "Named", '---\nname: "Named"\n---\n'), (5, "skill", "deep", "plain"), (6, "subagent", "Rev", "")]
    assert found.where("id = 8").select(F.length("name"), F.length("artifact_path")).first() == (200, 1024)
    kept, capped = artifacts.cap_artifacts(found, "machine", "id", 2)
    assert rows(kept, "id") == [(1,), (4,), (6,), (8,)]
    assert rows(capped) == [("m", "artifact-cap", ".c/skills/deep/SKILL.md")]
    assert rows(artifacts.kind_counts(found)) == [("hook", 1), ("skill", 2), ("subagent", 2)]
    assert artifacts.artifacts(df.limit(0)).count() == 0


def test_grants(spark):
    df = spark.createDataFrame([("plan", ["R"], [], None, True), (None, [], [], [], False), (None, None, ["x"], None, None)], "m string, a array<string>, d array<string>, k array<string>, t boolean")
    out = [r[0] for r in df.select(artifacts.canonical_grant(*map(F.col, "madkt"))).collect()]
    assert out == ['{"permissions":{"defaultMode":"plan","allow":["R"]},"enableAllProjectMcpServers":true}', None, '{"permissions":{"deny":["x"]}}']


def test_switches_equal_brute_force(spark):
    random.seed(7)
    names = ["yolo", "Auto-Run", "x.alwaysAllow", "other", "no_confirm", "a.b"]

    def node(depth):
        if depth == 0 or random.random() < 0.3:
            return random.choice([True, False, "true", "always", "no", 1, None, [], ["a"], {}])
        return {random.choice(names): node(depth - 1) for _ in range(3)} if random.random() < 0.8 else [node(depth - 1) for _ in range(2)]

    def expected(value, path=()):
        out, pairs = [], list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
        for k, v in pairs:
            name = str(k).rsplit(".", 1)[-1].lower().replace("-", "").replace("_", "")
            if name in ("yolo", "autorun", "alwaysallow", "noconfirm") and (v is True or v in ("true", "always") or (isinstance(v, list) and v)):
                out.append(".".join(map(str, (*path, k))))
            if len(path) < 6:
                out += expected(v, (*path, k))
        return out

    trees = [t for t in (node(8) for _ in range(60)) if len(expected(t)) < 40]
    texts = [json.dumps(t) for t in trees]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None, "", "{", '"yolo"', "{\"yolo\": true // on\n}"])], "i int, text string")
    found = {r["i"]: [s["key"] for s in r["s"]] for r in df.select("i", artifacts.switches(F.col("text")).alias("s")).collect()}
    assert [found[i] for i in range(len(trees))] == [expected(t) for t in trees]
    assert sum(map(bool, found.values())) > 10
    assert [found[len(trees) + i] for i in range(5)] == [[], [], [], [], ["yolo"]]


def test_policy(spark):
    text = "one\n# scan-ignore\ntwo\nthree // scan-ignore\nfour"
    make = lambda n: (f"L{n}", "HIGH", "c", n, 0)
    found = [make(n) for n in range(1, 6)] + [("none", "LOW", "c", None, None)]
    df = spark.createDataFrame([(1, text, found), (2, "x scan-ignore-file\n" + text, found), (3, None, found), (4, "plain", found), (5, "\n" * 9 + "scan-ignore-file", found)], f"id int, text string, f {FN.TYPE}")
    kept = {r["id"]: [x["label"] for x in r["k"]] for r in df.select("id", policy.unmarked(F.col("f"), F.col("text")).alias("k")).collect()}
    everything = ["L1", "L2", "L3", "L4", "L5", "none"]
    assert kept == {1: ["L1", "none"], 2: [], 3: everything, 4: everything, 5: everything}
    verdicts = df.select(policy.policy_verdict(F.col("f")).alias("a"), policy.policy_verdict(F.col("f"), "high").alias("b"), policy.policy_verdict(F.col("f"), "none", "low", ("l",)).alias("c"), policy.policy_verdict(F.col("f"), "none", "low", ("l", "none")).alias("d"))
    assert tuple(verdicts.first()) == ("FLAG", "BLOCK", "FLAG", "ALLOW")
    assert rows(policy.totals(verdicts, "b")) == [(5, 5, 0)]
    pairs = spark.createDataFrame([("ALLOW", "FLAG"), ("BLOCK", None), (None, None), ("ALLOW", None)], "a string, b string")
    assert [r[0] for r in pairs.select(policy.stricter(F.col("a"), F.col("b"))).collect()] == ["FLAG", "BLOCK", None, "ALLOW"]


def test_baseline_and_ignore_rules(spark):
    found = spark.createDataFrame([("a/b.py", "c", "AWS key", 1), ("a/b.py", "c", "AWS key", 9), ("a/b.py", "c", "Other", 1), (None, "c", "Other", 1)], "path string, category string, label string, line int")
    assert rows(policy.since_baseline(found, found.where("line = 9")), "path", "label") == [("a/b.py", "Other"), (None, "Other")]
    assert policy.since_baseline(found, found).count() == 0 and policy.since_baseline(found, found.limit(0)).count() == 4
    hit = lambda *r: [x[0] for x in found.select(policy.ignored(F.col("path"), F.col("label"), list(r))).collect()]
    assert hit() == [False] * 4 and hit("*.py") == [True, True, True, False] and hit("b.?y :: aws") == [True, True, False, False]
    assert hit("a/*.py") == [True, True, True, False] and hit("/*.py") == [False] * 4 and hit("a/") == [True, True, True, False] and hit("**/b.py :: other") == [False, False, True, False]
