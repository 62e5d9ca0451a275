"""Ignore rules are met by the names that they spell out."""

import itertools
import random
import re

from pyspark.sql import functions as F

from sievehouse.operators import policy


def test_keys_lose_no_match(spark):
    """Every path that a glob matches answers to the glob's folder and name."""
    r = random.Random(11)
    parts = ["a", "b", "/", "/", "*", "**", "**/", "?", ".py", "f1"]
    globs = sorted({"".join(r.choice(parts) for _ in range(r.randrange(1, 7))) for _ in range(1500)} | {"a**/**/f1", "a**/f1", "****/f1", "//f1", "f1**", "**/f1*"})
    paths = ["".join(x) for n in range(1, 5) for x in itertools.product(["a", "b", "/", "f1", ".py"], repeat=n)]
    found = spark.createDataFrame([("r", p, "x") for p in paths], "repo string, path string, label string").withColumn("repo", F.lit("r"))
    files = spark.createDataFrame([(g, g) for g in globs], "repo string, text string")
    each = found.drop("repo").crossJoin(files.select("repo"))
    left = policy.without_ignored(each, policy.ignore_rules(files, ["repo"]), ["repo"])
    got = {(x.repo, x.n) for x in left.groupBy("repo").agg(F.count("*").alias("n")).collect()}
    kept = lambda g: sum(not re.search(policy.glob_pattern(g).replace("\\z", "\\Z"), p) for p in paths)
    assert got == {(g, n) for g in globs if (n := kept(g))}


def test_paths_do_not_meet_all_rules_without_a_folder(spark):
    """3,000 rules that hold in any folder and 3,000 paths met in 9 million pairs."""
    n = 3000
    rules = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.when(F.col("id") % 2 == 0, "**/f").otherwise("f"), F.col("id"), F.when(F.col("id") % 2 == 0, "_*").otherwise(".py")).alias("text"))
    found = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("d/f"), F.col("id"), F.when(F.col("id") % 2 == 0, "_1.py").otherwise(".py")).alias("path"), F.lit("x").alias("label"))
    out = policy.without_ignored(found, policy.ignore_rules(rules, ["repo"]), ["repo"])
    assert out.count() == 0
    table = policy.ignore_rules(rules, ["repo"])
    assert table.select("folder", "name").distinct().count() == n
