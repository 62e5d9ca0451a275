"""The trie of conversation prefixes, aggregated by ROLLUP over columns of turns.

A conversation is cut into blocks of WIDTH turns. A block is one row: the node
that the block before ended at, and the ids of the block's turns in columns.
One ROLLUP over these columns, keyed by the prior node, aggregates all
prefixes of all conversations at once; a long conversation has more rows, not
more columns. A turn's id is 96 bits of two hashes of role and text and the
length of the text; a node's is 128 bits over all its turns and their places.

The smallest member of a node is also the smallest of the nodes below on its
own path, so each conversation stands for the nodes from some depth on down
its path. Sums over the distinct nodes of a subtree are thus sums over its
members, and need no walk of the tree: a second ROLLUP takes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, written

#: Turns of a block; first turns that conversations can share, and conversations that share them.
WIDTH, SHARED, FAMILY = 8, 8, 5
#: Turn numbers of a span, in which turns are ranked.
SPAN = 256


def _turn_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, span, turn, role, a, b): a turn by its id; b's low 32 bits are the bytes of its text."""
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    b = F.shiftleft(F.crc32(F.concat(x, F.lit("\n"), r).cast("binary")), 32).bitwiseOR(F.octet_length(x).cast("bigint"))
    span = F.coalesce(F.floor(F.col(turn) / SPAN).cast("bigint"), F.lit(-(1 << 62)))
    return turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv"), span.alias("span"), F.col(turn).alias("turn"), r.alias("role"), F.xxhash64(r, x).alias("a"), b.alias("b"))


def shared_turns(conv: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return (F.crc32(conv.cast("string").cast("binary")) % (SHARED + 1)).cast("int")


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((c, pos, a, b), (c, length)): the turns of the rebuilt conversations,
    and all conversations. Conversation c has the first h turns of
    c - c % FAMILY, then its own after its first h; h is crc32(c) % (SHARED + 1).

    Turns are ranked within spans of turn numbers, and a span's place comes
    from the counts of the spans before it, so a long conversation is many groups."""
    rows = written(_turn_rows(turns, conv, turn, role, text), "turn-ids")
    counts = rows.groupBy("conv", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("conv", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    totals = counts.groupBy("conv").agg(F.sum("n").alias("n"))
    of_base = totals.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    c = F.col("conv")
    family = totals.withColumns({"base": c - c % FAMILY, "h": shared_turns(c)}).join(of_base, "base", "left")
    shared = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = written(family.select("conv", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length")), "rebuilt-convs")
    placed = spans.join(convs, "conv").select("conv", "span", "offset", "h", "shared")
    rank = F.row_number().over(Window.partitionBy("conv", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b"))
    numbered = rows.select("conv", "span", "a", "b", rank.alias("rank")).join(placed, ["conv", "span"])
    numbered = written(numbered.select("conv", "a", "b", (F.col("offset") + F.col("rank")).alias("p"), "h", "shared"), "numbered-turns")
    own = numbered.where("p > h").select(c.alias("c"), (F.col("p") - F.col("h") + F.col("shared")).alias("pos"), "a", "b")
    heads = numbered.where((F.col("p") <= SHARED) & (c % FAMILY == 0)).select(c.alias("base"), F.explode(F.sequence(c - FAMILY + 1, c + FAMILY - 1)).alias("c"), F.col("p").alias("pos"), "a", "b")
    heads = heads.where((F.col("c") - F.col("c") % FAMILY == F.col("base")) & (F.col("pos") <= shared_turns(F.col("c")))).drop("base")
    heads = heads.join(convs.select(c.alias("c")), "c", "left_semi")
    return own.unionByName(heads), convs.select(c.alias("c"), "length")


def _slots(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(1, WIDTH + 1)]


def _turn_hash(seed: int, pos: Column, a: str, b: str) -> Column:
    return F.xxhash64(F.lit(seed), pos, F.col(a), F.col(b))


def turn_blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each conversation and block: c, length, block, the turns
    a1, b1, ... (null after the last), the prior node (prior1, prior2) and the
    bytes of texts before the block, and the conversation's end node and bytes."""
    pos = F.col("pos")
    at = turns.withColumns({"block": F.floor((pos - 1) / WIDTH).cast("bigint"), "slot": (pos - 1) % WIDTH + 1})
    columns = [F.max(F.when(F.col("slot") == i, F.col(x))).alias(f"{x}{i}") for i in range(1, WIDTH + 1) for x in ("a", "b")]
    path = [F.bit_xor(_turn_hash(k, pos, "a", "b")).alias(f"x{k}") for k in (1, 2)]
    rows = at.groupBy("c", "block").agg(*columns, *path, F.sum(F.col("b").bitwiseAND((1 << 32) - 1)).alias("bytes"))
    rows = convs.join(rows, "c", "left").withColumn("block", F.coalesce("block", F.lit(0)))
    earlier, whole = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("c")
    over = lambda f, x, w: F.coalesce(f(x).over(w), F.lit(0))
    rows = rows.select(
        "c", "length", "block", *(x for pair in zip(_slots("a"), _slots("b"), strict=True) for x in pair),
        over(F.bit_xor, "x1", earlier).alias("prior1"), over(F.bit_xor, "x2", earlier).alias("prior2"), over(F.sum, "bytes", earlier).alias("bytes_before"),
        over(F.bit_xor, "x1", whole).alias("end1"), over(F.bit_xor, "x2", whole).alias("end2"), over(F.sum, "bytes", whole).alias("bytes_all"),
    )
    return written(rows, "turn-blocks")


def _all_prefixes(blocks: DataFrame, sums: list[str]) -> DataFrame:
    """The nodes: their key (k1, k2), their parent's (p1, p2), depth, bytes of
    the last text and of all before it, and the aggregates `sums`.

    One ROLLUP; grouping_id says how many of a block's turns a row has. A row
    whose last turn is null is of conversations that ended before and no node;
    that without a turn is the root in block 0 and the prior node elsewhere."""
    a, b = _slots("a"), _slots("b")
    grouped = blocks.sparkSession.sql(
        f"""SELECT block, prior1, prior2, bytes_before, {', '.join(a + b)}, grouping_id() AS gid, {', '.join(sums)}
        FROM {{blocks}} GROUP BY block, prior1, prior2, bytes_before, ROLLUP ({', '.join(f'({x}, {y})' for x, y in zip(a, b, strict=True))})""",
        blocks=blocks,
    )
    names = [s.rpartition(" AS ")[2] for s in sums]
    d = (F.lit(WIDTH) - F.bit_count("gid") / 2).cast("int")
    rows = grouped.withColumn("d", d).where((F.col("d") == 0) & (F.col("block") == 0) | F.get(F.array(*a), F.col("d") - 1).isNotNull())

    def key(k: int, upto: Column) -> Column:
        out = F.col(f"prior{k}")
        for i in range(1, WIDTH + 1):
            h = _turn_hash(k, F.col("block") * WIDTH + i, f"a{i}", f"b{i}")
            out = out.bitwiseXOR(F.when(upto >= i, h).otherwise(F.lit(0)))
        return out

    sizes = [F.coalesce(F.col(x).bitwiseAND((1 << 32) - 1), F.lit(0)) for x in b]
    before = sum((F.when(F.col("d") > i, size).otherwise(0) for i, size in enumerate(sizes, 1)), F.col("bytes_before"))
    last = F.coalesce(F.get(F.array(*sizes), F.col("d") - 1), F.lit(0))
    return rows.select(
        key(1, F.col("d")).alias("k1"), key(2, F.col("d")).alias("k2"), key(1, F.col("d") - 1).alias("p1"), key(2, F.col("d") - 1).alias("p2"),
        (F.col("block") * WIDTH + F.col("d")).alias("depth"), last.alias("bytes"), before.alias("bytes_before"), *names,
    )


def _end_digests(blocks: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes where conversations end. Ids go into
    texts of ranges of a thousand first; a task streams through a node's texts and holds none but one batch."""
    ends = blocks.where("block = 0").select(F.col("end1").alias("k1"), F.col("end2").alias("k2"), "c", F.floor(F.col("c") / 1000).alias("part"))
    parts = ends.groupBy("k1", "k2", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], ["k1", "k2", "ends_sha256"])

    return ordered.mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns go by number (null first), then role, then id; null roles and texts
    are empty. Rows without a conversation's id belong to none and are left
    out. Conversations with equal turns share all nodes; one without a turn is
    a member of the root alone. Other columns are left out, and an empty table
    has no node. Rows that are shuffled hold ids, never texts. Counts are
    summed up before each shuffle; nodes below a parent with very many of them
    are joined to it where they are.
    """
    blocks = turn_blocks(*rebuilt(turns, conv, turn, role, text))
    nodes = written(_all_prefixes(blocks, ["count(*) AS n_convs", "min(c) AS conv_id", "max(length) AS longest"]), "trie-nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("depth").alias("top"), F.sum("bytes").alias("own"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    of_conv = written(blocks.where("block = 0").select("c", "bytes_all").join(owned, "c", "left").na.fill(0, ["own", "leaf"]), "trie-convs")
    with_sums = blocks.drop("bytes_all").join(of_conv, "c")
    sums = _all_prefixes(with_sums, ["sum(leaf) AS n_leaves", "sum(bytes_all - own) AS all_bytes"]).select("k1", "k2", "n_leaves", "all_bytes")
    children = written(nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")), "trie-children")
    rows = nodes.join(sums, ["k1", "k2"]).join(children, ["k1", "k2"], "left").join(_end_digests(blocks), ["k1", "k2"], "left")
    rows = written(rows.join(of_conv.select(F.col("c").alias("conv_id"), "top", "own", F.col("bytes_all").alias("bytes_own")), "conv_id"), "trie-rows")
    by_parent = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    by_parent = by_parent.join(children.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "n_children"), ["p1", "p2"]).withColumnRenamed("n_children", "n")
    tops = rows.where("depth > 0 and depth = top")
    below = rows.where("depth = 0 or depth > top").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    named = below.unionByName(join_hot(tops, by_parent, ["p1", "p2"], "n", tops.count()))
    # all members' bytes from this node down, less those of each distinct node
    saved = F.col("all_bytes") - F.col("n_convs") * F.col("bytes_before") + F.col("own") - (F.col("bytes_own") - F.col("bytes_before"))
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
