"""Ignore rules and baselines as tables, and whole report files."""

import glob
import json
import random
import re

from pyspark.sql import functions as F

from sievehouse.operators import acquire, policy


def test_rules_of_files_match_patterns_of_globs(spark):
    r = random.Random(3)
    globs = ["*.py", "src/", "src/**", "/a.py", "src/*.py", "**/x?.py", "src/a/b.py", "docs", "src/a/*/c", "a.b+c", "**", "src/**/c", "x?", "/", "*/a.py"]
    paths = ["/".join(r.choice(["src", "a", "b", "docs", "x1.py", "a.py", "b.py", "c", "a.b+c", "é"]) for _ in range(r.randrange(1, 5))) for _ in range(150)]
    found = [(repo, p, label, "c", i) for i, p in enumerate(paths) for repo in ("r", "s", None) for label in ("Key of AWS", "Other", None)]
    rules = [("r", "\n".join(r.choice(["", " :: aws", "::OTHER", " # no"]).join([g, ""]) for g in r.sample(globs, 4)) + "\n# x\n\n") for _ in range(3)] + [("s", "src/a/b.py :: key\r\n *.py\r\n"), ("s", None), ("t", "**")]
    df = spark.createDataFrame(found, "repo string, path string, label string, category string, line int")
    table = policy.ignore_rules(spark.createDataFrame(rules, "repo string, text string"), ["repo"])
    got = {(x.repo, x.path, x.label, x.line) for x in policy.without_ignored(df, table, ["repo"]).collect()}

    def ignored(repo, path, label):
        for of, text in rules:
            for line in (text or "").splitlines():
                line = line.strip()
                if of != repo or not line or line.startswith("#") or label is None:
                    continue
                g, _, title = (x.strip() for x in line.partition("::"))
                if re.search(policy.glob_pattern(g).replace("\\z", "\\Z"), path) and title.lower() in label.lower():
                    return True
        return False

    want = {(repo, p, label, line) for repo, p, label, _, line in found if not ignored(repo, p, label)}
    assert got == want and 0 < len(want) < len(set(found))
    n = 3000
    many = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("d/f"), F.col("id"), F.lit(".py")).alias("text"))
    files = spark.range(n + 5).select(F.lit("r").alias("repo"), F.concat(F.lit("d/f"), F.col("id"), F.lit(".py")).alias("path"), F.lit("x").alias("label"))
    assert policy.without_ignored(files, policy.ignore_rules(many, ["repo"]), ["repo"]).count() == 5


def test_baseline_files_survive_moved_lines(spark):
    schema = "repo string, path string, category string, label string, line int"
    old = spark.createDataFrame([("r", "a", "secret", "k", 3), ("r", "a", "secret", "k", 9), ("s", "b", "secret", "k", 1)], schema)
    files = policy.baseline_file(old, ["repo"]).unionByName(spark.createDataFrame([("t", "{broken"), ("t", None)], "repo string, text string"))
    new = spark.createDataFrame([("r", "a", "secret", "k", 30), ("r", "a", "secret", "other", 3), ("r", "b", "secret", "k", 1), ("s", "a", "secret", "k", 3), ("t", "a", "secret", "k", 3)], schema)
    assert sorted((x.repo, x.path, x.label) for x in policy.since_baseline_files(new, files, ["repo"]).collect()) == [("r", "a", "other"), ("r", "b", "k"), ("s", "a", "k"), ("t", "a", "k")]


def test_every_report_file_is_a_document(spark, tmp_path):
    results = spark.range(0, 25, 1, 3).select(F.when(F.col("id") != 7, F.to_json(F.struct(F.col("id").alias("ruleId"), F.lit('q"\n').alias("t")))).alias("result"))
    results = results.unionByName(spark.createDataFrame([], "result string"))
    acquire.write_report_files(results, str(tmp_path / "r"), "scan")
    docs = [json.load(open(f)) for f in glob.glob(str(tmp_path / "r" / "part-*"))]
    assert len(docs) >= 3 and all(d["version"] == "2.1.0" and d["runs"][0]["tool"]["driver"]["name"] == "scan" for d in docs)
    assert sorted(x["ruleId"] for d in docs for x in d["runs"][0]["results"]) == [i for i in range(25) if i != 7]
    acquire.write_report_files(results.limit(0), str(tmp_path / "e"), "scan")
    assert [json.load(open(f))["runs"][0]["results"] for f in glob.glob(str(tmp_path / "e" / "part-*"))] == [[]]
