"""Design prose: rules are tried only where a text holds what they need."""

from sievehouse.operators import design

TEXTS = {
    1: "It reads INBOUND EMAIL and\r\nruns shell commands.\r\nIt purges rows.",
    2: "```\nruns shell commands\n```\nnothing else",
    3: "It does not access customer records.",
    4: "plain prose about the weather",
    5: None,
    6: "",
    7: "reads inbound\nemail, and a user\nmessage",
}


def asked_first(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("mask(")


def test_paths_look_for_needs_once(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    cited = design.evidence(docs)
    assert asked_first(design.attack_paths(cited)) == 1
    assert {(r.doc_id, r.cap, r.what, r.line, r.match) for r in cited.collect()} == {
        (1, "injection", "inbound email", 1, "INBOUND EMAIL"), (1, "exec", "running shell commands", 2, "runs shell"), (7, "injection", "inbound email", 2, "email"),
    }


def test_verdicts_of_all_documents(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    out = design.analyze_designs(docs)
    assert asked_first(out) == 1
    got = {r.doc_id: (r.verdict, r.worst, r.n_paths) for r in out.collect()}
    assert got == {1: ("OPEN_PATH", "CRITICAL", 1)} | {i: ("NOT_DESCRIBED", None, 0) for i in range(2, 7)} | {7: ("PARTIAL", None, 0)}
