"""Walks, activation and budgets against plain loops."""

import random

from pyspark.sql import functions as F

from sievehouse.operators import sweep


def test_walks_match_a_queue(spark):
    r = random.Random(4)
    names = ["a", "b", "b.c", "node_modules", "z", "tmp"]
    dirs = {"/r1", "/r2", "/deep"}
    for _ in range(400):
        parent = r.choice(sorted(dirs))
        dirs.add(f"{parent}/{r.choice(names)}")
    dirs.add("/deep" + "/a" * 9)
    roots = ["/r2", "/r1", "/deep", "/r1/missing"]
    for budget in (7, 60, 40_000):
        want = []
        for root in roots:
            queue = [(root, 0)] if root in dirs else []
            while queue and len(want) < budget:
                d, depth = queue.pop(0)
                want.append((root, d, depth, len(want) + 1))
                for name in sorted(x.rsplit("/", 1)[1] for x in dirs if x.rsplit("/", 1)[0] == d):
                    if depth < 6 and name not in sweep.IGNORED:
                        queue.append((f"{d}/{name}", depth + 1))
        listing = [("m", root, i, d) for i, root in enumerate(roots) for d in sorted(dirs) if d == root or d.startswith(root + "/")]
        listing += [("m", "/r1", 1, None), ("n", "/r1", 0, "/r1"), ("n", "/r1", 0, "/r10"), ("n", "/q", 1, "/r1")]
        walked, capped = sweep.walked_dirs(spark.createDataFrame(listing, "machine string, root string, ord int, path string"), most=budget)
        got = sorted((tuple(x)[1:] for x in walked.where("machine = 'm'").collect()), key=lambda x: x[3])
        assert got == want
        assert [tuple(x)[1:] for x in walked.where("machine = 'n'").collect()] == [("/r1", "/r1", 0, 1)]
        assert [x.machine for x in capped.collect()] == (["m"] if len(want) == budget else [])


def test_installed_is_known_empty_or_not_known(spark):
    files = [
        ("a", "settings.json", '{"enabledPlugins": {"x@one": true, "two": 1}} // on'), ("a", "plugins/installed_plugins.json", '{"plugins": {"y@three@four": null, "z": {"marketplace": "five", "source": "no"}, "w": {"source": "six"}, "v": {"marketplace": 1, "source": "no"}}}'),
        ("b", "settings.json", "{}"), ("c", "settings.json", "{}"), ("c", "settings.local.json", "{broken"), ("d", "other.json", "{broken"), ("e", "settings.json", None), ("f", "settings.json", '{"enabledPlugins": "no"}'),
    ]
    known, names = sweep.installed_marketplaces(spark.createDataFrame(files, "root string, path string, text string"), ["root"])
    assert {r.root: r.known for r in known.collect()} == {"a": True, "b": True, "c": False, "f": True}
    assert sorted(r.marketplace for r in names.collect()) == sorted(["one", "two", "three@four", "z", "five", "w", "six", "v"])
    base = "plugins/marketplaces/"
    found = [("a", "v", base + "one/SKILL.md"), ("a", "v", base + "nine/SKILL.md"), ("b", "v", base + "one/SKILL.md"), ("c", "v", base + "one/SKILL.md"), ("g", "v", base + "one/SKILL.md"), ("c", "v", "x/.TMP/" + base + "one/SKILL.md"), ("c", "v", "skills/x/SKILL.md"), ("a", "w", "backup/SKILL.md"), ("a", "w", "mybackups/SKILL.md"), ("a", "w", None)]
    out = sweep.activations(spark.createDataFrame(found, "root string, vendor string, path string"), known, names, ["root"])
    got = {(r.root, r.path): (r.activation, r.catalogue) for r in out.collect()}
    assert [got[r, p] for r, _, p in found] == [("active", None), ("available", "nine"), ("available", "one"), ("unknown", None), ("available", "one"), ("available", "v:.tmp"), ("active", None), ("available", "w:backup"), ("active", None), ("active", None)]
    assert {(r.root, r.catalogue): r.n for r in sweep.available_counts(out, ["root"]).collect()} == {("a", "nine"): 1, ("b", "one"): 1, ("g", "one"): 1, ("c", "v:.tmp"): 1, ("a", "w:backup"): 1}


def budgets_by_hand(rows, bytes_, artifacts, bundled):
    out = {}
    for machine in {r[0] for r in rows}:
        left, count, closed = bytes_, 0, set()
        taken = {}
        for m, skill, site, place, size, charge in sorted((r for r in rows if r[0] == machine), key=lambda r: (-1 if r[1] is None else r[1], r[2], r[3])):
            group = (skill, site)
            full = taken.get(group, 0) >= bundled if skill is not None else count >= artifacts
            if group in closed or (charge is None and not full):
                out[m, place] = None
            elif full:
                closed.add(group)
                out[m, place] = "artifact-cap" if skill is None else "bundle-cap"
            elif size > left:
                out[m, place] = "byte-budget"
            else:
                left -= charge
                taken[group] = taken.get(group, 0) + 1
                count += skill is None
                out[m, place] = "kept"
    return out


def test_budgets_match_a_loop(spark):
    r = random.Random(9)
    rows = []
    for place in range(700):
        size = r.choice([0, 10, 500, 3000, 9000])
        skill = r.choice([None, None, 3, 5])
        rows.append((r.choice(["m", "n", None]), skill, 0 if skill is not None else r.randrange(3), place, size, r.choice([min(size, 2000), min(size, 2000), None])))
    schema = "machine string, skill bigint, site bigint, place bigint, size bigint, charge bigint"
    df = spark.createDataFrame(rows, schema).withColumn("path", F.col("place").cast("string"))
    for limits in ((20_000, 15, 4), (10**9, 10**9, 10**9), (0, 5, 0)):
        out = sweep.within_budgets(df, "machine", *limits)
        assert {(x.machine, x.place): x.outcome for x in out.collect()} == budgets_by_hand(rows, *limits)
    capped = sweep.capped_rows(sweep.within_budgets(df, "machine", 20_000, 15, 4), "machine").collect()
    want = {k: v for k, v in budgets_by_hand(rows, 20_000, 15, 4).items() if v not in (None, "kept")}
    assert {(x.machine, int(x.path)): x.reason for x in capped} == want and set(want.values()) == {"byte-budget", "artifact-cap", "bundle-cap"}
    assert sweep.within_budgets(df.limit(0), "machine").count() == 0
