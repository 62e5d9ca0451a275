"""Source rules on positive and negative files."""

from pyspark.sql import functions as F

from sievehouse.operators import source_code as SRC


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in texts.items()], "file string, text string")


def test_units_join_open_brackets():
    assert SRC.units_of("a(\n b)\nc \\\nd\n'('\n# (\ne") == [("a(\n b)", 1), ("c \\\nd", 3), ("'('", 5), ("# (", 6), ("e", 7)]
    assert len(SRC.units_of("(\n" * 100)) == 3


def test_rules_chains_and_flows(spark):
    df = files(
        spark,
        a_py="import pickle\nx = pickle.load(f)\n# eval(x)\nprint('trust_remote_code=True')",
        b_py="y = base64.b64decode(z)\nos.system(\n  y)",
        c_js="const r = await client.messages.create(p)\nconst t = r.text\neval(t)",
        d_py="def add(a, b):\n    return a + b",
        e_py="m = f(trust_remote_code=True)\nrequests.get(u)",
        g_txt="eval(x)",
        h_py=None,
    )
    units = SRC.statements(df)
    found = {(r.file, r.rule, r.line) for r in SRC.rule_findings(units).collect()}
    assert {x for x in found if x[0] == "a.py"} == {("a.py", "python.pickle_deserialization", 2)}
    assert ("b.py", "python.dangerous_sinks", 2) in found and ("c.js", "js.code_exec", 3) in found and not any(x[0] in ("d.py", "g.txt", "h.py") for x in found)
    assert {(r.file, r.rule) for r in SRC.chain_findings(SRC.rule_findings(units)).collect()} == {("b.py", "chain.decode_exec"), ("e.py", "chain.remote_code_egress")}
    assert {(r.file, r.name, r.line) for r in SRC.flow_findings(SRC.source_files(df)).collect()} == {("c.js", "t", 3)}
    whole = {(r.file, r.rule, r.line) for r in SRC.scan_source(df).collect()}
    assert whole == found | {("b.py", "chain.decode_exec", 1), ("e.py", "chain.remote_code_egress", 1), ("c.js", "js.llm_output_to_sink", 3)}


def test_notebooks(spark):
    import json

    call = "os.sys" + "tem(x)"
    cells = [{"cell_type": "markdown", "source": call}, {"cell_type": "code", "source": ""}, {"cell_type": "code", "source": ["import os\n", call]}, {"cell_type": "code", "source": "[1, 2]"}]
    files = [("a.ipynb", json.dumps({"cells": cells})), ("b.ipynb", json.dumps({"cells": [{"cell_type": "code", "source": "new Fun" + "ction('x')"}], "metadata": {"kernelspec": {"language": "TypeScript"}}})), ("c.ipynb", "{"), ("d.ipynb", None), ("e.ipynb", "[]")]
    df = spark.createDataFrame(files, "file string, text string")
    cells = df.select(F.explode(SRC.notebook_cells(F.col("file"), F.col("text"))).alias("c")).select("c.file", "c.lang")
    assert sorted(map(tuple, cells.collect())) == [("a.ipynb#cell2", "py"), ("a.ipynb#cell3", "py"), ("b.ipynb#cell1", "js")]
    found = SRC.rule_findings(SRC.statements(df))
    assert sorted(map(tuple, found.select("file", "rule", "line").collect())) == [("a.ipynb#cell2", "python.dangerous_sinks", 2), ("b.ipynb#cell1", "js.code_exec", 1)]


def flows_by_hand(text):
    """(line, name): two passes over the statements in order, then every sink."""
    import re

    units, known = SRC.units_of(text), []
    whole = lambda name, where: re.search(rf"(?<!\w){re.escape(name)}(?!\w)", where)
    for _ in range(2):
        for unit, _ in units:
            if m := re.match(SRC.ASSIGN.removesuffix("$") + r"\Z", unit):
                names = [x.strip() for x in m[1].split(",")]
                if re.search(SRC.MODEL_CALL["py"], m[2]) or any(whole(k, m[2]) for k in known):
                    known += [x for x in names if x not in known]
    out, lines = {}, text.split("\n")
    for unit, start in units:
        for m in re.finditer(SRC.FLOW_SINK["py"], unit):
            at = start + unit[: m.start()].count("\n")
            rest = unit[m.start() :]
            via = next((k for k in known if whole(k, rest[rest.index("(") :])), None)
            if via and lines[at - 1].strip() and not re.match(SRC.COMMENT, lines[at - 1].strip()):
                out.setdefault(at, via)
    return sorted(out.items())


def test_flows_equal_brute_force(spark):
    import random

    r = random.Random(3)
    names = ["r", "a", "b", "c", "out", "text"]
    pieces = lambda: r.choice([
        f"{r.choice(names)} = llm(x)", f"{r.choice(names)} = client.messages.create(\n  {r.choice(names)})", f"{r.choice(names)} = {r.choice(names)}", f"{r.choice(names)}, {r.choice(names)} = {r.choice(names)}.parts",
        f"exec({r.choice(names)})", f"# exec({r.choice(names)})", f"eval(1); exec({r.choice(names)})", f"os.system(\n  {r.choice(names)})", f"print({r.choice(names)})", "x = 1",
    ])
    texts = {"chain": "r=llm(x)\na=r\nb=a\nc=b\nexec(c)", "comment": "r = llm(x)\n# exec(r)", "second": "r = llm(x)\neval(1); exec(r)\nexec(1)", "first": "z = llm(x)\na = z\nexec(a, z)", "clean": "exec(x)", "empty": ""}
    texts |= {f"t{i}": "\n".join(pieces() for _ in range(r.randrange(1, 14))) for i in range(150)}
    df = spark.createDataFrame([(f"{k}.py", v) for k, v in texts.items()], "file string, text string")
    got = {}
    for row in SRC.flow_findings(SRC.source_files(df)).collect():
        got.setdefault(row.file.removesuffix(".py"), []).append((row.line, row.name))
    assert {k: sorted(v) for k, v in got.items()} == {k: f for k, v in texts.items() if (f := flows_by_hand(v))}
    assert got["chain"] == [(5, "c")] and got["second"] == [(2, "r")] and got["first"] == [(3, "z")] and "comment" not in got


def test_chains_are_shown_at_their_own_rules(spark):
    df = files(spark, a_py="importlib.import_module(x)\ny = base64.b64decode(z)\nexec(y)")
    assert [(r.rule, r.line) for r in SRC.chain_findings(SRC.rule_findings(SRC.statements(df))).collect()] == [("chain.decode_exec", 2)]


def parses(df):
    """How often a plan cuts files into statements."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("logical_units(")


def test_chains_cut_files_once(spark):
    df = files(spark, a_py="y = base64.b64decode(z)\nos.system(\n  y)", b_py="requests.get(u)\nm = f(trust_remote_code=True)", c_py="prose about the system")
    found = SRC.chain_findings(SRC.rule_findings(SRC.statements(df)))
    assert parses(found) == 1 and {(r.file, r.rule, r.line) for r in found.collect()} == {("a.py", "chain.decode_exec", 1), ("b.py", "chain.remote_code_egress", 1)}


def test_whole_scan_cuts_files_twice_at_most(spark):
    df = files(spark, a_py="y = base64.b64decode(z)\nos.system(\n  y)", c_js="const t = await client.messages.create(p)\neval(t)", d_py="prose about the system")
    found = SRC.scan_source(df)
    assert parses(found) <= 2
    assert {(r.file, r.rule, r.line) for r in found.collect()} == {
        ("a.py", "python.encoded_payload", 1), ("a.py", "python.dangerous_sinks", 2), ("a.py", "chain.decode_exec", 1), ("c.js", "js.code_exec", 2), ("c.js", "js.llm_output_to_sink", 2),
    }


def test_only_files_that_may_match_are_cut(spark):
    """What a rule needs is looked for in each cell and language by itself; no finding is lost by it."""
    import json

    df = files(spark, a_py="import pickle\nx = pickle.load(f)", b_js="x = pickle.load(f)", c_py="nothing at all", d_js="EVAL (x)\neval (x)", e_py=None, f_txt="eval(x)")
    book = [("n.ipynb", json.dumps({"cells": [{"cell_type": "code", "source": "m = torch.load(p)"}, {"cell_type": "code", "source": "prose"}]}))]
    df = df.unionByName(spark.createDataFrame(book, "file string, text string"))
    assert sorted(r.file for r in SRC.source_files(df, only=SRC.may_have_findings).collect()) == ["a.py", "d.js", "n.ipynb#cell1"]
    key = lambda found: sorted((r.file, r.rule, r.line) for r in found.collect())
    assert key(SRC.find_rules(df)) == key(SRC.rule_findings(SRC.statements(df))) == [("a.py", "python.pickle_deserialization", 2), ("d.js", "js.code_exec", 2), ("n.ipynb#cell1", "python.pickle_deserialization", 1)]
