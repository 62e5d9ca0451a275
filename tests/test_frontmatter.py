"""Frontmatter against a line loop."""

import random
import re

from pyspark.sql import functions as F

from sievehouse.functions import frontmatter as FM
from sievehouse.operators import gate


def by_hand(text):
    m = re.match("﻿?---\r?\n([\\s\\S]*?)\r?\n---\r?\n?", text or "")
    data, key = {}, None
    strip = lambda t: re.sub("^[\"']|[\"']$", "", t)
    for raw in re.split("\r?\n", m[1]) if m else []:
        if not raw.strip() or raw.strip().startswith("#"):
            continue
        item = re.match(r"\s*-\s+(.*)\Z", raw)
        if item and key is not None:
            data[key] = [*(data[key] if isinstance(data[key], list) else []), strip(item[1].strip())]
            continue
        kv = re.match(r"([A-Za-z0-9_.-]+)\s*:\s*(.*)\Z", raw)
        if kv:
            key, v = kv[1], kv[2].strip()
            if v == "":
                data.setdefault(key, None)
            elif v.startswith("["):
                data[key] = [t for t in (strip(t).strip() for t in re.split(r"[,\n]+", re.sub(r"^\[|\]$", "", v))) if t]
            else:
                data[key] = strip(v)
    return data


def test_frontmatter_matches_a_loop(spark):
    r = random.Random(6)
    lines = ["name: x", "name: 'quoted'", "tools:", "tools: [a, 'b', ]", "tools: Bash, Read", "- one", "  - \"two\"", "# note", "", "  deep: no", "just text", "a.b-c_1 : v", "tools: []", "allowed-tools: *", "- ", "url: http://x", "name:"]
    texts = []
    for _ in range(500):
        end = r.choice(["\n", "\r\n"])
        texts.append(r.choice(["", "", "﻿", "x"]) + "---" + end + end.join(r.choice(lines) for _ in range(r.randrange(1, 8))) + end + r.choice(["---", "---", "--"]) + end + "body")
    texts += ["", "---\n---", "---\n\n---\nx", "---\nname: a", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("f", FM.frontmatter(F.col("t")))
    for row in df.collect():
        got = {k: v.many if v.many is not None else v.one for k, v in row.f.items()}
        assert got == by_hand(texts[row.i]), repr(texts[row.i])


def test_grants_come_from_any_form(spark):
    texts = ["---\ntools:\n  - Bash\n  # comment\n  - Read(x)\nallowed-tools: [Write, '*']\n---\n", "﻿---\nallowedTools: 'Edit, Web'\n---\n", "---\ntools:\n---\n", "tools: Bash", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", gate.tool_grants(F.col("t")).alias("g"))
    assert [list(r.g) for r in df.orderBy("i").collect()] == [["Write", "'*", "Bash", "Read(x)"], ["Edit", "Web"], [], [], []]
    wild = spark.createDataFrame([(texts[0],)], "t string").select(gate.grant_findings(F.col("t")).alias("f")).head().f
    assert [x.severity for x in wild] == ["HIGH"]
