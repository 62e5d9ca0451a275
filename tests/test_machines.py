"""Tools, settings and roots of machines against plain loops."""

import random

from sievehouse.operators import inventory, machines


def test_tools_are_found_by_folder_or_process(spark):
    r = random.Random(5)
    places = [p for _, _, _, ps in machines.PROBES for p in ps] + [("home", "x")]
    paths = [(m, *r.choice(places)) for m in ("a", "b") for _ in range(14)] + [("a", "home", None), ("c", "home", ".cursor"), ("c", "home", ".cursor")]
    procs = [("a", "/usr/bin/Ollama serve"), ("b", " LMS "), ("b", "ninja"), ("b", None), ("d", "vLLM"), ("d", "vllm worker"), ("c", "")]
    out = machines.installed_tools(spark.createDataFrame(paths, "machine string, base string, path string"), spark.createDataFrame(procs, "machine string, process string"))
    want = set()
    for m in "abcd":
        there = {(b, p) for x, b, p in paths if x == m}
        run = {v for v, ts in machines.PROCESSES.items() if any(t in (p or "").strip().lower() for x, p in procs if x == m and p for t in ts)}
        for kind, vendor, name, probes in machines.PROBES:
            at = next((f"{b}:{p}" for b, p in probes if (b, p) in there), None)
            runs = vendor in run if kind == "local-runtime" else None
            if at or runs:
                want.add((m, kind, vendor, name, at or f"proc:{vendor}", runs))
    assert {tuple(x) for x in out.collect()} == want and len(want) > 10


def test_sources_that_are_absent_are_rows(spark):
    files = [("m", "home", ".claude/settings.json", '{"defaultMode": "plan"}'), ("m", "cwd", ".claude/settings.json", '{"defaultMode": "bypassPermissions"}'), ("m", "home", ".gemini/settings.json", "{"), ("m", "home", "other", "{}"), ("q", "home", ".claude.json", "{}")]
    rows = machines.posture_sources(spark.createDataFrame([("m",), ("n",), ("m",), (None,)], "machine string"), spark.createDataFrame(files, "machine string, base string, path string, text string"))
    assert rows.count() == 2 * len(machines.SOURCES) and rows.where("text is not null").count() == 3
    out = {(x.machine, x.vendor): x for x in inventory.merge_postures(rows, ["machine", "vendor"]).collect()}
    assert (out["m", "claude-code"].mode, out["m", "claude-code"].claim, out["m", "claude-code"].sources) == ("bypassPermissions", "complete", 5)
    assert (out["m", "gemini"].claim, out["m", "gemini"].n_unreadable) == ("floor", 1) and out["n", "claude-code"].claim == "floor" and ("q", "claude-code") not in out


def test_roots_are_expanded_in_order(spark):
    dirs = ["/h/code", "/h/code/b", "/h/code/a", "/h/code/.x", "/h/code/node_modules", "/h/code/a/deep", "/h/Documents", "/h/Documents/z", "/h/other", "/h/source", "/h/source/repos", "/h/source/repos/r"]
    given = spark.createDataFrame([("m", "/w", 0), ("m", "/h/code/b", 1), ("m", "/w", 2), ("m", None, 3)], "machine string, root string, ord int")
    table = spark.createDataFrame([("m", d) for d in dirs] + [("n", "/h/code")], "machine string, path string")
    homes = spark.createDataFrame([("m", "/h"), ("n", None)], "machine string, home string")
    want = ["/w", "/h/code/b", "/h", "/h/Documents", "/h/Documents/z", "/h/source", "/h/source/repos", "/h/source/repos/r", "/h/code", "/h/code/a"]
    for most in (500, 4):
        out = machines.expanded_roots(given, table, homes, most=most).orderBy("ord").collect()
        assert [x.root for x in out] == want[:most] and [x.ord for x in out] == list(range(1, min(most, len(want)) + 1))


def test_servers_and_clients(spark):
    files = [
        ("cursor", "b", '{"mcpServers": {"f": {"command": "npx", "args": ["-y", "", "@s/f"], "env": {"Z": "1", "A": 2}}, "n": null, "t": "x", "u": {"url": "https://u", "command": "no"}}}'), ("zed", "a", '{"context_servers": {"u": {"serverUrl": "https://u"}, "e": {}}}'),
        ("v", "c", "{broken"), ("v", "d", None), ("v", "e", "[]"), ("v", "f", '{"servers": ["x"]}'), ("v", "g", '{"mcp.servers": {"q": {"args": ["only"]}}, "mcp": {"servers": {"no": {}}}}'),
    ]
    out = inventory.declared_servers(spark.createDataFrame(files, "vendor string, path string, text string"))
    assert sorted(tuple(x) for x in out.collect()) == [
        ("e", "e", "zed", "", None, "a", ""), ("f", "npx -y @s/f", "cursor", "npx -y @s/f", None, "b", "A,Z"), ("q", "only", "v", "only", None, "g", ""), ("u", "https://u", "zed", "", "https://u", "a", ""),
    ]
    manifests = [("x/package.json", '{"dependencies": {"@modelcontextprotocol/sdk": "1", "mcp": "1", "mcp-use": "1"}}'), ("y/Pipfile", "MCP = 1\nmy-mcp = 2"), ("z/requirements.txt", None)]
    got = inventory.client_assets(spark.createDataFrame(manifests, "path string, text string")).collect()
    assert sorted((x.ecosystem, x.package) for x in got) == [("npm", "@modelcontextprotocol/sdk"), ("npm", "mcp-use"), ("pip", "mcp")]
