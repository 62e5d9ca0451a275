"""The training-data operators against brute force, on small tables with awkward rows."""

import base64
import glob
import gzip
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from sievehouse.llm import bpe, chat, decontam, fingerprint, langid, pii, quality, queries, simhash, substrings, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows, extra=False):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        for name in ("key", "fingerprint", "lang_pred", "score", "h", "item", "found", "root", "doc", "shingles"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [None, "", "   \n\t ", "one", "a b", "a b c", "é ß 日本語 😀", "x" * 30_000, " ".join(["same"] * 200)]


# ---- personal data


def spans_by_hand(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group()))
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in found)


def test_base_spans_match_brute_force(spark):
    r = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "😀", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000001.2.3.4", "4425414259157784", "4425-4142 5915-7784", "+1 (319) 555-5132", "+1", "+12345678901234567890", " ", ",", "_x@y.zz", "12", "-", ".", "\n", "+", "..", "a@b.co_x@y.zz", "é@é.fr"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 25))) for _ in range(400)] + [t for t in AWKWARD if t is not None] + ["1" * 5000, "a.b" * 4000 + "@", "1 " * 4000]
    df = docs_of(spark, [*enumerate(texts), (9999, None)], extra=True)
    out = pii.detect(df, pii.SpanModel()).select("doc_id", pii.spans_text(F.filter("found", lambda s: s["base"])).alias("s")).collect()
    assert {x.doc_id: x.s for x in out} == {**{i: spans_by_hand(t) for i, t in enumerate(texts)}, 9999: ""}


def test_span_model_adds_likely_spans_and_redacts(spark):
    rows = [(i, f"mail us: user{i}@example.com or call +1 (319) 555-{5000 + i} now") for i in range(60)]
    rows += [(100 + i, f"phone: (319) 555-{4000 + i} today, version 12.34 released") for i in range(20)]
    rows += [(200, None), (201, ""), (202, "plain words only")]
    df = docs_of(spark, rows)
    model = pii.train_span_model(df)
    assert 0 < model.prior["phone"] <= 1
    clean = {r.doc_id: r for r in pii.redact(df, model).collect()}
    assert clean[0].text == "mail us: [EMAIL] or call [PHONE] now" and clean[0].n_chars == len(clean[0].text)
    assert clean[200].text is None and clean[201].text == "" and clean[202].text == "plain words only"
    assert clean[100].text.startswith("phone: [PHONE] today, version 12.34")
    empty = docs_of(spark, [])
    assert pii.redact(empty, pii.train_span_model(empty)).count() == 0


# ---- language


def test_language_model_generalises_and_rejects(spark):
    r = random.Random(2)
    bits = {"aa": ["tha", "ing", "and", "the"], "bb": ["ção", "que", "os", "ña"], "cc": ["sch", "ung", "ein", "öß"]}
    rows = [(i, " ".join("".join(r.choice(bits[k]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 80))), k) for i, k in enumerate(list(bits) * 80)]
    df = spark.createDataFrame([*rows, (900, "no label", None), (901, None, "aa"), (902, "12 34", "bb"), (1, rows[1][1], "bb")], "doc_id bigint, text string, lang string")
    model = langid.train_language_model(df.where(queries.remainder("doc_id", 3) != 1))
    out = {x.doc_id: x for x in langid.identify_language(df.withColumn("score", F.lit("clash")), model).collect()}
    assert sum(out[i].lang_pred == k for i, _, k in rows) >= 0.97 * len(rows)
    assert out[901].lang_pred == "und" and out[902].lang_pred == "und" and out[902].score == 0
    assert all(0 <= x.score <= 1 for x in out.values())
    none = langid.train_language_model(df.limit(0))
    assert none is None and {x.lang_pred for x in langid.identify_language(df, none).collect()} == {"und"}


# ---- WARC


def test_archives_are_bounded_by_class(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", [(10, 4), (100, 2), (1 << 31, 1)])
    rows = [(i, f"http://a/{i}", ("x" if i % 3 else "y" * 50 if i % 2 else "z" * 500) + str(i)) for i in range(60)]
    records = warc.resolve_revisits(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2))
    warc.write_archives(records, str(tmp_path / "a"))
    seen = 0
    for f in glob.glob(str(tmp_path / "a" / "size=*" / "*" / "*.gz")):
        n = sum(1 for _ in warc.parse_archive(open(f, "rb").read()))
        seen += n
        assert 1 <= n <= {"size=0": 4, "size=1": 2, "size=2": 1}[f.split("/")[-3]]
    assert seen == 60 and warc.read_archives(spark, str(tmp_path / "a")).count() == 60
    assert warc.deduplicate_archives(spark.createDataFrame([], "page_id bigint, url string, html string"))[1].count() == 0


def test_archives_round_trip_and_resolve_revisits(spark):
    rows = [(5, "http://a/\r\nx", "<p>é\r\n\r\nWARC/1.1\r\n"), (3, None, "same"), (9, "http://b", "same"), (7, "http://c", "same"), (1, "u", None), (2, "u", ""), (None, "u", "same"), (3, None, "same"), (8, "z", "y" * 100_000)]
    folder, headers = warc.deduplicate_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")))
    got = sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in headers.collect()), key=str)
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = p is None or p > least[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None))
    assert got == sorted(want, key=str)
    blocks = [b for f in glob.glob(folder.removeprefix("file:") + "/size=*/*/*.gz") for _, b in warc.parse_archive(open(f, "rb").read())]
    assert len(blocks) == len(rows) and gzip.decompress(open(glob.glob(folder.removeprefix("file:") + "/size=*/*/*.gz")[0], "rb").read()).startswith(b"WARC/1.1\r\n")
    assert warc.deduplicate_archives(spark.createDataFrame([], "page_id bigint, url string, html string"))[1].count() == 0


# ---- BPE


def test_automaton_equals_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Library.from_file(path)
    r = random.Random(7)
    texts = ["".join(r.choice(r.choice(["abcdefgh", "aaab", "etaoin shrdlu", "éñß 123", "\n\t  ..!!", ["<|endoftext|>"], "日本語😀"])) for _ in range(r.randrange(60))) for _ in range(600)]
    texts += [t for t in AWKWARD if t is not None] + ["a" * 9000, " " * 500]
    out = {x.doc_id: x for x in bpe.encode_texts(docs_of(spark, [*enumerate(texts), (9999, None)], extra=True), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(out[i].token_ids) == ids and out[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert out[9999].n_tokens == 0 and out[9999].decoded == ""


def test_rare_words_share_few_contexts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = bpe.Tokenizer(f.read())
    library, r = Library.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    words = sorted({"".join(r.choices("abcdefgh", k=12)) for _ in range(3000)})
    ids = tokenizer.automaton.encode_sorted([w.encode() for w in words])
    assert ids == [x.ids for x in library.encode_batch(words, add_special_tokens=False)]
    assert len(tokenizer.automaton._near) <= 8 + 8**2 + 8**3


def test_both_engines_cut_the_same_words():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = bpe.Tokenizer(f.read())
    split, r = regex.compile(bpe.PRE_SPLIT), random.Random(4)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x20000)]):
        text = f"a{c} {c}{c}1 {c}a{c}"
        assert tokenizer._words(text) == split.findall(text), hex(ord(c))
    for _ in range(3000):
        text = "".join(r.choices("aZé日1٣ \n\t\u00a0\u2003\u0085\x1c'stdlrevm.,-[]^😀"[: r.choice([24, 99])], k=r.randrange(40)))
        assert tokenizer._words(text) == split.findall(text)


# ---- chat


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be [kind] \\ </s>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "[OUT]<s>\\[INST]"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (4, 1, "to[ol", "x"), (4, 0, None, "y"), (None, 0, "user", "n"), (5, 0, "user", "z" * 50_000), (5, 1, "assistant", "\n")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {x.conv_id: x for x in chat.parse_chats(chat.format_chats(df)).collect()}
    for conv in (1, 2, 3, 4, None, 5):
        rows = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert [(t.role, t.text) for t in out[conv].turns] == [(r, x) for _, r, x in rows]
        assert out[conv].loss_text == "".join(x for _, r, x in rows if r == "assistant")
        assert "".join(s.text for s in out[conv].segments) == out[conv].formatted
    assert [out[c].valid for c in (1, 2, 3, 4, None, 5)] == [True, True, False, False, False, True]
    assert chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(start="BOS")


# ---- MinHash


def test_fingerprints_estimate_likeness(spark):
    texts = [(i * 7, prose(i, 300)) for i in range(40)] + [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(5000, prose(1, 300)), (5000, prose(1, 300)), (None, "null key")]
    out = fingerprint.compare_with_edited(docs_of(spark, texts, extra=True)).collect()
    assert len(out) == len(texts)
    rows = sorted(((-1 if i is None else i, t or "") for i, t in texts))
    by_text, shingles = {}, lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set()
    want = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b = shingles(t), shingles(e)
        want.append((i, hashlib.sha256(e.encode()).hexdigest(), 1.0 if a == b else len(a & b) / len(a | b)))
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.edited_sha256, x.near_edited) for x in out)
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.mean([abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)]) < 0.06
    texts_of = dict((-1 if i is None else i, t or "") for i, t in texts)
    for x in out:
        assert by_text.setdefault(texts_of[-1 if x.doc_id is None else x.doc_id], x.fingerprint) == x.fingerprint
    assert fingerprint.compare_with_edited(docs_of(spark, [])).count() == 0


# ---- SimHash


def roots_by_hand(fps, keys):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if keys[i] is not None:
            least[find(i)] = min(keys[i], least.get(find(i), keys[i]))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_and_components(spark):
    base = prose(3, 400).split()
    texts = [(i, prose(i, 120)) for i in range(30)]
    for i in range(30):
        changed = base.copy()
        changed[i * 10] = "changed"
        texts.append((100 + i, " ".join(changed)))
    texts += [(200 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "lonely null"), (300, prose(1, 120)), (300, prose(1, 120))]
    out = simhash.near_duplicates(docs_of(spark, texts, extra=True)).collect()

    def by_hand(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    fps = [by_hand(t) for _, t in texts]
    want = sorted(zip([i for i, _ in texts], fps, roots_by_hand(fps, [i for i, _ in texts]), strict=True), key=str)
    assert sorted(((x.doc_id, x.fingerprint % (1 << 64), x.component_id) for x in out), key=str) == want
    kept = simhash.drop_near_duplicates(docs_of(spark, texts, extra=True))
    assert len(kept.columns) == 15 and sorted((x.doc_id for x in kept.select("doc_id").collect()), key=str) == sorted({c for _, _, c in want}, key=str)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_texts_of_near_duplicates_are_shuffled_once(spark):
    texts = [(7, "One two three four"), (7, "one two three FOUR"), (7, "one two three FOUR"), (3, "one two three four"), (3, "ONE two three four"), (None, None), (None, ""), (9, "quite another text, which stays")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    kept = simhash.drop_near_duplicates(docs)
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan, plan
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["3", "9", "None"]



def test_large_buckets_are_divided_without_loss(spark, monkeypatch):
    r = random.Random(1)
    fps = set()
    for _ in range(6):
        seed = r.getrandbits(64)
        for _ in range(150):
            x = seed
            for _ in range(r.randrange(7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fingerprint bigint")
    for size in (1, 2048):
        monkeypatch.setattr(simhash, "BUCKET", size)
        roots = {x.node % (1 << 64): x.root for x in simhash.components(simhash.links(nodes)).collect()}
        want = roots_by_hand(fps, list(range(len(fps))))
        groups = {}
        for x, w in zip(fps, want, strict=True):
            groups.setdefault(w, set()).add(roots.get(x, x - (1 << 64) if x >> 63 else x))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# ---- substrings


@pytest.mark.parametrize("window", [3, 12, 35])
def test_removed_words_equal_brute_force(spark, window):
    shared = prose(77, 60)
    texts = [(i, prose(i, 90, 60) + (" " + shared if i % 3 == 0 else "")) for i in range(40)] + [(100, shared), (101, shared), (101, shared), (102, " ".join(["same"] * 200)), (103, "p q r s t " * 20)]
    texts += [(200 + i, t) for i, t in enumerate(AWKWARD)] + [(None, shared)]
    df = docs_of(spark, texts, extra=True).withColumn("n_words", F.lit("clash"))
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in substrings.remove_repeats(df, window).collect()), key=str)
    count, words = {}, [(t or "").split() for _, t in texts]
    for w in words:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] = count.get(tuple(w[k : k + window]), 0) + 1
    want = []
    for (i, _), w in zip(texts, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert got == sorted(want, key=str)


def test_no_documents_no_repeats(spark):
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, prose(i, 30, 60), lang) for lang, n in (("en", 30), ("fr", 20), ("aa", 5), *((f"l{k}", 1) for k in range(40))) for i in range(n)]
    df = spark.createDataFrame([(k, t, x) for k, (_, t, x) in enumerate(rows)], "doc_id bigint, text string, lang string")
    assert langid.train_language_model(df, most_languages=3).languages == ["aa", "en", "fr"]


# ---- decontamination


def test_contained_items_equal_brute_force(spark):
    items = [(i, prose(500 + i, 12 + 3 * i, 5000)) for i in range(12)] + [(50, None), (51, ""), (52, "tiny item"), (53, prose(500, 12, 5000))]
    rows = []
    for i in range(60):
        words = prose(i, 200, 5000).split()
        if i % 4 == 0:
            item = items[i % 12][1].split()
            for k in range(i % 5):
                item[(k * 7) % len(item)] = "changed"
            words[50:50] = item
        rows.append((i, " ".join(words)))
    rows += [(200 + i, t) for i, t in enumerate(AWKWARD)] + [(300, "Tiny ITEM"), (None, items[3][1]), (4, rows[4][1])]
    item_df = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit("clash"))
    got = {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in decontam.contained_items(docs_of(spark, rows, extra=True), item_df).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for d, t in rows:
        for i, x in items:
            a, b = shingles(t), shingles(x)
            if b and 5 * len(a & b) >= 4 * len(b):
                want.add((d, i, len(a & b), len(b)))
    assert got == want and len(want) > 10
    kept = decontam.decontaminate(docs_of(spark, rows, extra=True), item_df)
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in {w[0] for w in want}), key=str)
    assert decontam.contained_items(docs_of(spark, rows), item_df.limit(0)).count() == 0


def test_sketches_leave_out_what_many_texts_hold(spark):
    common = "which of the following is true of"
    items = [(i, f"{common} {prose(700 + i, 9, 5000)}") for i in range(8)]
    rows = [(i, f"{prose(i, 40, 5000)} {common} {prose(90 + i, 40, 5000)}") for i in range(80)] + [(500, f"{prose(3, 30, 5000)} {items[5][1]}")]
    item_df = spark.createDataFrame(items, "item_id bigint, text string")
    shingles = decontam.item_shingles(item_df)
    in_texts = docs_of(spark, rows).select("doc_id", F.explode(F.array_distinct(decontam.shingle_hashes(F.col("text"), 5))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    sketches = decontam.item_sketches(shingles, in_texts)
    assert sketches.join(in_texts.where("n > 50"), "h").count() == 0 and sketches.select("item_id").distinct().count() == 8
    assert [(r.doc_id, r.item_id) for r in decontam.contained_items(docs_of(spark, rows), item_df).collect()] == [(500, 5)]


# ---- quality


def test_quality_model_on_held_out_rows(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = prose(i, r.randrange(20, 200))
        rows.append((i, text if good else r.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), "spam " * 50])))
        labels.append((i, int(good)))
    labels += [(None, 1), (5, None), (99999, 0)]
    df = docs_of(spark, [*rows, (None, None), (700, ""), (701, None)], extra=True)
    label_df = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.train_quality_model(df, label_df.where(queries.remainder("doc_id", 5) != 0), most=300)
    out = {x.doc_id: x for x in quality.score_quality(df, model).collect()}
    held = [x.doc_id for x in label_df.where(queries.remainder("doc_id", 5) == 0).where("doc_id < 600").collect()]
    truth = dict(labels[:600])
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.95 and model.pairs
    assert all(0 <= x.score <= 1 for x in out.values()) and len(out) == 603
    none = quality.train_quality_model(df, label_df.limit(0))
    assert none is None and quality.score_quality(df, none).where("score = 0.5").count() == 603


# ---- the methods by hand


def fingerprint_by_hand(text, size=5, bins=128):
    def h64(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def chained(values, seed=42):
        for v in values:
            seed = h64((v % (1 << 64)).to_bytes(8, "little"), seed)
        return seed

    words = [h64(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    if not words:
        return "0" * bins
    if len(words) < size:
        total = 7
        for w in words:
            total = chained([total, w])
        hashes = [total]
    else:
        hashes = [chained(words[i : i + size]) for i in range(len(words) - size + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    least = {}
    for x in map(signed, hashes):
        at = (x >> 57) + 64  # bins in the order of signed longs
        least[at] = min(x, least.get(at, x))
    out = []
    for i in range(bins):
        small = lambda salt, i=i: h64(salt.to_bytes(4, "little"), h64(i.to_bytes(4, "little")))
        start, step = small(1) % bins, small(2) % bins | 1
        value = least.get(i)
        k = 0
        while value is None:
            value = least.get((start + step * k) % bins)
            k += 1
        out.append("%x" % (h64(i.to_bytes(4, "little"), h64((value % (1 << 64)).to_bytes(8, "little"))) & 15))
    return "".join(out)


def test_fingerprints_and_likeness_equal_brute_force(spark):
    texts = [*enumerate(AWKWARD), *((100 + i, prose(i, i, 5000)) for i in (1, 4, 5, 6, 8, 12, 18, 24, 40, 90, 200, 900))]
    df = docs_of(spark, texts)
    got = {x.doc_id: x.f for x in df.select("doc_id", fingerprint.fingerprint(F.col("text")).alias("f")).collect()}
    assert got == {i: fingerprint_by_hand(t) for i, t in texts}
    a, b = got[100 + 200], got[100 + 900]
    raw = sum(x == y for x, y in zip(a, b, strict=True)) / 128
    near = spark.range(1).select(fingerprint.likeness(F.lit(a), F.lit(b)).alias("x"), fingerprint.likeness(F.lit(a), F.lit(a)).alias("y")).first()
    assert abs(near.x - min(1.0, max(0.0, (raw - 1 / 16) / (15 / 16)))) < 1e-12 and near.y == 1


def test_follow_the_leader_equals_brute_force():
    r = random.Random(8)
    idf = np.ones(langid.BUCKETS)
    examples = [(np.array(sorted(r.sample(range(9), 4))), np.array([r.randrange(1, 5) for _ in range(4)]), r.randrange(3)) for _ in range(40)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    model = langid._fit(examples, ["a", "b", "c"], idf, 2, alpha, beta, l1, l2)
    z = {(j, k): 0.0 for j in [*range(9), "bias"] for k in range(3)}
    n = dict(z)

    def weight(j, k):
        lasso = 0.0 if j == "bias" else l1
        if abs(z[j, k]) <= lasso:
            return 0.0
        return ((lasso if z[j, k] > 0 else -lasso) - z[j, k]) / ((beta + n[j, k] ** 0.5) / alpha + l2)

    for _ in range(2):
        for i, (found, counts, y) in enumerate(examples):
            if i % 5 == 0:
                continue
            x = [1 + np.log(c) for c in counts]
            norm = sum(v * v for v in x) ** 0.5
            x = {**{int(j): v / norm for j, v in zip(found, x, strict=True)}, "bias": 1.0}
            s = [sum(v * weight(j, k) for j, v in x.items()) for k in range(3)]
            p = [np.exp(v) / sum(np.exp(u) for u in s) for v in s]
            for j, v in x.items():
                for k in range(3):
                    g, w = v * (p[k] - (k == y)), weight(j, k)
                    z[j, k] += g - ((n[j, k] + g * g) ** 0.5 - n[j, k] ** 0.5) / alpha * w
                    n[j, k] += g * g
    for k in range(3):
        assert abs(model.bias[k] - weight("bias", k)) < 1e-9
        for j in range(9):
            assert abs(model.weights[j, k] - weight(j, k)) < 1e-9
    assert model.temperature > 0


def test_document_frequencies_cover_all_rows(spark):
    rows = [(i, prose(i, 5 + i), "aa" if i % 2 else "bb") for i in range(30)] + [(90, None, "aa"), (91, "x" * 40_000, "bb"), (91, "x" * 40_000, "bb")]
    model = langid.train_language_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    seen = np.zeros(langid.BUCKETS)
    for _, t, _ in rows:
        if t:
            seen[langid.ngram_counts(t)[0]] += 1
    assert np.allclose(model.idf, np.log(33 / (1 + seen)) + 1)


def test_reliabilities_equal_brute_force():
    """Expectation-maximisation over single spans in place of counted patterns."""
    r = random.Random(6)
    spans = [tuple(r.choice((-1, 0, 1)) if r.random() < 0.2 else (1 if y else -1) for _ in pii.VOTES) for y in (r.random() < 0.4 for _ in range(120))]
    counts = {}
    for v in spans:
        counts[v] = counts.get(v, 0) + 1
    model = pii.SpanModel()
    known = pii._estimate({"phone": counts}, model, 10)
    p = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v in spans]
    for _ in range(10):
        says = {}
        for j in range(len(pii.VOTES)):
            for y in (0, 1):
                mass = [0.5 + sum((q if y else 1 - q) for v, q in zip(spans, p, strict=True) if v[j] == x) for x in (-1, 0, 1)]
                says.update({(j, y, x): m / sum(mass) for x, m in zip((-1, 0, 1), mass, strict=True)})
        prior = (1 + sum(p)) / (2 + len(p))
        likely = lambda v, y, says=says: np.prod([says[j, y, x] for j, x in enumerate(v)])
        p = [prior * likely(v, 1) / (prior * likely(v, 1) + (1 - prior) * likely(v, 0)) for v in spans]
    assert abs(model.prior["phone"] - prior) < 1e-9
    assert all(abs(known["phone", v] - q) < 1e-9 for v, q in zip(spans, p, strict=True))


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(300, 4)), 1)  # with ties
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_additive_model(x, y, cycles=10, pair_cycles=20, pairs=2, bins=8)
    for row, score in zip(x, model.score(x), strict=True):
        at = [sum(float(v) >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        z = model.base + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12
    for j, edges in enumerate(model.edges):
        assert list(edges) == sorted(set(np.quantile(x[:, j], np.arange(1, 8) / 8)))
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == (y > 0.5)) > 0.9


def test_quality_of_repeated_keys_long_texts_and_ties(spark):
    rows = [(1, "a b"), (1, "a b"), (1, None), (2, "x" * 100_000), (3, " ".join(["word"] * 30_000)), (4, "a b")]
    df = docs_of(spark, rows)
    model = quality.train_quality_model(df, spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (4, 0)], "doc_id bigint, quality int"))
    out = quality.score_quality(df, model).collect()
    assert len(out) == len(rows) and len({x.score for x in out if x.text == "a b"}) == 1


def test_shared_folder_and_written_tables(spark):
    from sievehouse.llm import common

    df = common.written(spark.range(3), "drop-me")
    assert df.count() == 3 and common.drop_written(spark) >= 1 and common.drop_written(spark) == 0
