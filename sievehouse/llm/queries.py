"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, fingerprint, langid, lines, pii, quality, repair, simhash, substrings, trie, warc
from .common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(key: str, by: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.train_span_model(docs))
    base = F.filter("found", lambda s: s["base"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("found")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_language_model(docs.where(remainder("doc_id", 3) != 1))
    found = langid.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, headers = warc.deduplicate_archives(table(spark, sf_dir, "pages"))
    return headers.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT)
      >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest FROM h),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM w"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False, with_decoded=False)


PROBE = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    out = chat.parse_chats(chat.format_chats(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1] ELSE 'x' END, '' ORDER BY turn, role, text) AS roles,
    3 + sum(length(text) + length(regexp_replace(text, '[^\\\[<]', '', 'g')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
      ELSE 19 + length(role) + length(regexp_replace(role, '[^\\\[<]', '', 'g')) END) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM g"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edited(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, window=35, with_kept=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win SEMI JOIN again USING (k), range(0, 35) r(j)),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
v AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM benchmark),
d AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
b AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM v),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN b USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n_item)"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train_quality_model(docs, labels.where(remainder("doc_id", 5) != 0))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""


#: CTEs for CRC-32, as DuckDB has no such function, and the CRC of a text of ASCII characters.
CRC_TABLE = """bits AS (SELECT n, list_reduce(list_prepend(n, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(0, 256) r(n)),
crc_table AS (SELECT list(c ORDER BY n) AS crcs FROM bits),
"""


def crc_sql(name: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({name}) + 1), lambda i: CAST(ascii({name}[i]) AS BIGINT))),
    lambda a, b: xor(a // 256, crcs[1 + xor(a % 256, b)])), 4294967295)"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")))
    return repair.report_with_digest(edits).withColumnRenamed("conv", "conv_id")


OP12_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
""" + CRC_TABLE + r"""d AS (
  SELECT conv_id, turn, role, text, """ + crc_sql("name") + r""" % 20 AS kind FROM k, crc_table),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) t(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM r),
f AS (
  SELECT *, role[1] AS i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault FROM o),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (p > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS p, 's0' AS st, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, p, st, cost, audit, said FROM (
    WITH step AS (
      SELECT x.conv_id, f.p, a.st, x.cost + a.cost + CASE WHEN f.fault = 't' AND a.edit <> 'D' THEN 1 ELSE 0 END AS cost, x.audit || a.edit AS audit,
        CASE a.edit WHEN 'D' THEN x.said WHEN 'K' THEN list_append(x.said, f.role || ':' || f.text) ELSE list_append(x.said, CASE a.st WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text) END AS said
      FROM (
        SELECT conv_id, p, st, cost, audit, said FROM path
        UNION ALL SELECT conv_id, p, CASE st WHEN 'u' THEN 'a' ELSE 'u' END, cost + 2, audit || 'I', list_append(said, CASE st WHEN 'u' THEN 'assistant:' ELSE 'user:' END) FROM path
        UNION ALL SELECT conv_id, p, CASE st WHEN 'u' THEN 'u' ELSE 'a' END, cost + 4, audit || 'II', said || CASE st WHEN 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END FROM path) x
      JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.p = x.p + 1
      JOIN (VALUES ('s0', 's', 'K', 's1', 0), ('s0', 'u', 'K', 'u', 0), ('s1', 'u', 'K', 'u', 0), ('a', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0),
        ('s0', '', 'R', 'u', 2), ('s1', '', 'R', 'u', 2), ('a', '', 'R', 'u', 2), ('u', '', 'R', 'a', 2),
        ('s0', '', 'D', 's0', 3), ('s1', '', 'D', 's1', 3), ('u', '', 'D', 'u', 3), ('a', '', 'D', 'a', 3)) a(was, i, edit, st, cost)
      ON a.was = x.st AND (a.edit <> 'K' OR a.i = f.i) AND (a.edit = 'D' OR f.fault NOT IN ('b', 'd')))
    SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1)),
ends AS (
  SELECT path.conv_id, cost + CASE st WHEN 'u' THEN 2 WHEN 's1' THEN 4 ELSE 0 END AS cost, audit || CASE st WHEN 'u' THEN 'I' WHEN 's1' THEN 'II' ELSE '' END AS audit,
    said || CASE st WHEN 'u' THEN ['assistant:'] WHEN 's1' THEN ['user:', 'assistant:'] ELSE [] END AS said
  FROM path JOIN s ON s.conv_id IS NOT DISTINCT FROM path.conv_id AND path.p = s.n),
done AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH """ + CRC_TABLE + """t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, CAST(c AS VARCHAR) AS name, list(struct_pack(k := md5(role || chr(31) || text), n := octet_length(encode(text))) ORDER BY turn NULLS FIRST, role) AS turns FROM t GROUP BY c),
o AS (SELECT *, """ + crc_sql("name") + """ % 9 AS h FROM own, crc_table),
r AS (SELECT o.c, coalesce(b.turns[1:o.h], []) || o.turns[o.h + 1:] AS turns FROM o LEFT JOIN own b ON b.c = o.c - o.c % 5),
p AS (
  SELECT c, d, len(turns) AS n, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS bytes, md5(array_to_string(list_transform(turns[1:d], lambda x: x.k), ',')) AS k,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.k), ',')) END AS up
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
v AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, any_value(bytes) AS bytes, any_value(up) AS up,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY k, d),
s AS (
  SELECT p.k, p.d, count(*) FILTER (v.leaf) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved_tokens
  FROM v JOIN p ON p.c = v.conv_id AND p.d <= v.d GROUP BY p.k, p.d),
n AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY up, d)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (k, d) LEFT JOIN n ON n.up = v.k AND n.d = v.d LEFT JOIN v u ON u.k = v.up AND u.d = v.d - 1"""


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_language_id": op2_language_id,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_bpe": op4_bpe,
    "op5_chat": op5_chat,
    "op6_minhash": op6_minhash,
    "op7_simhash": op7_simhash,
    "op8_substrings": op8_substrings,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op3_warc_revisits": OP3_SQL,
    "op5_chat": OP5_SQL,
    "op8_substrings": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
