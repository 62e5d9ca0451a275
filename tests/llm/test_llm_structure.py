"""Line dedup, conversation repair and the prefix trie against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievehouse.llm import lines, repair, trie

SPACE = " \t\n\x0b\x0c\r"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- lines


def lines_by_hand(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACE).translate(upper)
    last = lambda i: (i is None, i)
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10 and (k not in owner or last(i) < last(owner[k])):
                owner[k] = i
    out = []
    for i, t in rows:
        each = (t or "").split("\n")
        stay = [x for x in each if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((i, len(each), len(each) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def line_rows(seed, n):
    r = random.Random(seed)
    common = ["The Same Long Line", "  the same long line\t", "THE SAME LONG LINE\r", "short", "", "exactly 10", "Éxactly 10", "éxactly 10", "nine char", "😀" * 10, "\x0bthe same long line\x0c"]
    make = lambda: "\n".join(r.choice(common) if r.random() < 0.6 else f"line number {r.randrange(60)}" for _ in range(r.randrange(0, 9)))
    rows = [(i, make()) for i in r.sample(range(-n, 3 * n), n)]
    rows += [(5000, "repeated row of one id\nrepeated row of one id"), (5000, "repeated row of one id"), (5001, "repeated row of one id"), (None, "The same long line\nonly nulls have this"), (None, "only nulls have this"), (5002, None), (5003, ""), (5004, "\n\n")]
    rows += [(5005, "\n".join(f"line number {i}" for i in range(3000))), (5006, "x" * 50_000), (5007, "x" * 50_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_lines_match_brute_force_whatever_the_batches(spark, batches, fanout):
    rows = line_rows(batches, 120)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("key", "h", "g", "doc", "row", "owner", "fresh", "batch", "kept", "places"):
        df = df.withColumn(name, F.lit("clash"))
    out = lines.drop_repeated_lines(df, batches=batches, fanout=fanout)
    assert set(df.columns) < set(out.columns) and [r.owner for r in out.take(1)] == ["clash"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=repr)
    assert got == lines_by_hand(rows)
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_runs_are_levelled_and_a_batch_can_be_added_again(spark):
    index = lines.LineIndex(spark, fanout=2)
    batches = [spark.createDataFrame([(10 * b + i, f"common line of all\nline of batch {b}\nonly in document {b} {i}") for i in range(3)], "doc_id bigint, text string") for b in range(5)]
    gone = []
    for b in batches:
        gone.append({r.doc: sorted(r.places) for r in index.add(lines.hashed_lines(b)).collect()})
        assert all(len(level) <= 2 for level in index.levels)
    assert gone[0] == {1: [0, 1], 2: [0, 1]} and gone[3] == {30: [0], 31: [0, 1], 32: [0, 1]}
    assert len(index.levels) == 3 and sum(run.count() for run in index.runs()) == 1 + 5 + 15
    assert {r.doc: sorted(r.places) for r in index.add(lines.hashed_lines(batches[3])).collect()} == gone[3]
    index.close()
    assert index.levels == [[]]


def test_merging_a_batch_moves_no_run(spark):
    index = lines.LineIndex(spark, fanout=4)
    docs = spark.createDataFrame([(i, f"a line of document {i}") for i in range(50)], "doc_id bigint, text string")
    index.add(lines.hashed_lines(docs))
    index.add(lines.hashed_lines(docs.withColumn("doc_id", F.col("doc_id") + 50)))
    with lines._sorted_buckets(spark):
        keys = lines.hashed_lines(docs).groupBy("h", "g").count()
        for i, run in enumerate(index.runs()):
            keys = keys.join(run.withColumnRenamed("owner", f"o{i}").hint("merge"), ["h", "g"], "left")
        plan = keys._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    index.close()


# ---- repair


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        copies = {0: 0, 3: 2}.get(kind, 1)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * copies
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def repaired_by_hand(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(SPACE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    due = {"0": "u", "s": "u", "u": "a", "a": "u"}
    named = {"u": "user", "a": "assistant"}
    best = {"0": (0, "", ())}

    def inserts(best):
        for _ in range(4):
            for s, (cost, audit, said) in list(best.items()):
                to = (cost + 2, audit + "I", (*said, named[due[s]] + ":"))
                if due[s] not in best or to < best[due[s]]:
                    best[due[s]] = to
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def reach(s, cost, audit, said, after=after):
            if s not in after or (cost, audit) < after[s][:2]:
                after[s] = cost, audit, said

        for s, (cost, audit, said) in inserts(best).items():
            reach(s, cost + 3, audit + "D", said)
            if fault in ("blank", "duplicate"):
                continue
            add = fault == "truncated"
            if (s, role[:1]) in moves:
                reach(moves[s, role[:1]], cost + add, audit + "K", (*said, f"{role}:{text}"))
            reach(due[s], cost + 2 + add, audit + "R", (*said, f"{named[due[s]]}:{text}"))
        best = after
    cost, audit, said = min(v for s, v in inserts(best).items() if s in ("0", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, said


def conversation_rows(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "So be it!  \n", None, "and then", "é 😀.", "\xa0"]
    roles = ["user", "assistant", "system", "tool", "", None, "ugly"]
    rows = []
    for c in [*range(n), 3 * 10**9, -7, None]:
        size = r.choice([1, 2, 3, 4, 6, 8, 9, 20])
        turns = r.sample(range(40), size)
        for t in turns:
            role = r.choice(roles) if r.random() < 0.25 else ("user", "assistant")[t % 2]
            rows.append((c, t if r.random() < 0.95 else None, role, r.choice(texts) if r.random() < 0.4 else f"Sentence {r.randrange(30)}."))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)]
    rows += [(901, 0, "user", "x" * 100_000), (901, 1, "assistant", "y." * 50_000)]
    r.shuffle(rows)
    return rows


CONV = "conv_id bigint, turn bigint, role string, text string"


def clashing(df):
    for name in ("conv", "phase", "place", "live", "edit", "audit", "c", "pos", "a", "b", "k1", "span", "depth"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_repair_matches_brute_force(spark):
    rows = conversation_rows(3, 150)
    df = clashing(spark.createDataFrame(rows, CONV))
    edits = repair.repair_conversations(repair.damaged(df)).persist()
    want = {c: repaired_by_hand(v) for c, v in damaged_by_hand(rows).items()}
    got = {r.conv: r for r in repair.report_with_digest(edits).collect()}
    assert set(got) == set(want)
    for c, (*report, said) in want.items():
        assert list(got[c][1:8]) == report, c
        assert got[c].repaired_sha256 == sha("\n".join(said)), c
    turns = defaultdict(list)
    for r in repair.repaired_turns(edits).orderBy("place").collect():
        turns[r.conv].append(f"{r.role}:{r.text}")
    assert all(tuple(turns[c]) == v[-1] for c, v in want.items())
    assert repair.repair_report(edits).count() == len(want)
    edits.unpersist()
    empty = repair.repair_conversations(repair.damaged(df.limit(0)))
    assert repair.report_with_digest(empty).count() == 0


def test_conversations_that_lost_all_rows_keep_a_report(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in gone], CONV)
    out = repair.report_with_digest(repair.repair_conversations(repair.damaged(df))).collect()
    assert sorted(r.conv for r in out) == gone and gone
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for r in out)


def test_paths_don_t_depend_on_the_chunk(monkeypatch):
    r = random.Random(1)
    import numpy as np

    for n in (0, 1, 5, 30, 200):
        codes, must, cut = np.array([r.randrange(4) for _ in range(n)], int), np.array([r.random() < 0.2 for _ in range(n)], bool), np.array([r.random() < 0.3 for _ in range(n)], bool)
        whole = repair.cheapest_edits(codes, must, cut)
        assert sum(x in "DKR" for x in whole[1]) == n
        for size in (1, 3, 7):
            monkeypatch.setattr(repair, "CHUNK", size)
            assert repair.cheapest_edits(codes, must, cut) == whole
        monkeypatch.undo()


# ---- trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        cost = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += not children[node]
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))))
        for node, m in members.items()
    )


def test_trie_matches_brute_force(spark):
    r = random.Random(8)
    rows = []
    for c in range(80):
        size = r.choice([1, 2, 3, 7, 8, 9, 16, 17, 30])
        rows += [(c, t, ("user", "assistant")[t % 2], r.choice(["a", "b", "é", None, ""]) if r.random() < 0.5 else "same") for t in range(size)]
    rows += [(c, t, "user", "copy") for c in range(1000, 1040) for t in range(20)]
    rows += [(2000, None, "user", "no turn"), (2000, 5, None, None), (2000, 5000, "user", "far"), (None, 1, "user", "nobody's"), (10**12, 0, "user", "x" * 100_000)]
    r.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, CONV))
    out = trie.prefix_trie(df).collect()
    assert sorted((tuple(x) for x in out), key=lambda x: (x[0], x[1])) == [tuple(x) for x in trie_by_hand(rows)]
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_hot_parents_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr("sievehouse.llm.common.HOT_ROWS", 3)
    monkeypatch.setattr("sievehouse.llm.common.HOT_SHARE", 10)
    rows = [(c, t, "user", "all" if t == 0 else f"turn {c} {t}") for c in range(60) for t in range(3)] + [(100 + c, t, "user", f"pair {c % 2} {t}") for c in range(10) for t in range(9)]
    out = trie.prefix_trie(spark.createDataFrame(rows, CONV)).collect()
    assert sorted((tuple(x) for x in out), key=lambda x: (x[0], x[1])) == [tuple(x) for x in trie_by_hand(rows)]


def test_hot_lines_are_resolved_where_they_are(spark, monkeypatch):
    monkeypatch.setattr("sievehouse.llm.common.HOT_ROWS", 3)
    rows = line_rows(77, 60)
    out = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=repr) == lines_by_hand(rows)
