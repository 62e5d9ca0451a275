"""Repair of damaged conversations by the cheapest edits.

A conversation's edits are a path through (rows read, state) nodes, where the
states are those of `(system? (user assistant)+)?`. A dynamic programme from
the end gives each node's cost to go. Among the arcs that keep to it, the path
with the least audit string is found by prefix doubling: arcs are ranked by
the audits of one letter that they begin, then of two, four, and so on, each
round from the ranks of the last and pointers of twice the length. The ranks
select the first arc, and the doubled pointers list the arcs after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What words aren't made of, as characters and as a class.
SPACE, WORD_CHAR = " \t\n\x0b\x0c\r", "[^\\x20\\x09-\\x0D]"
LETTERS = "DIKR"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing said, system said, user said, assistant said.
START, INSTRUCTED, ASKED, ANSWERED = range(4)
#: The state after an inserted or re-roled turn, and after a kept turn whose role begins with s, u, a or anything else (-1: not allowed).
EXPECTED = np.array([ASKED, ASKED, ANSWERED, ASKED])
KEPT = np.array([[INSTRUCTED, -1, -1, -1], [ASKED, ASKED, -1, ASKED], [-1, -1, ANSWERED, -1], [-1, -1, -1, -1]])
_EXPECTED, _KEPT = EXPECTED.tolist(), KEPT.tolist()
ROLE = {ASKED: "user", ANSWERED: "assistant"}
#: Rows whose arcs are ranked together.
CHUNK = 1 << 15
#: Rows of a conversation whose edits are kept for others like it.
SHORT = 32


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, live): the rows after damage by crc32 of
    `conv:turn`, modulo 20: 0 drops a row, which stays as one that isn't live,
    1 empties its text, 2 takes out its `.!?`, 3 repeats it, 4 makes it the
    user's. A null is one space in the key, the role and the text."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    said = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text))
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(shown(role)).alias("role"), said.alias("text"), (kind != 0).alias("live"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))),
    )
    return rows.drop("col")


def costs(codes: list[int], must: list[bool], cut: list[bool]) -> np.ndarray:
    """The cost to go from each (rows read, state)."""
    out = np.empty((len(codes) + 1, 4), np.int64)
    d = [0, 2 * INSERT, INSERT, 0]
    out[-1] = d
    for i in range(len(codes) - 1, -1, -1):
        c = [DELETE + x for x in d]
        if not must[i]:
            add, kept = TRUNCATED * cut[i], _KEPT[codes[i]]
            for s in range(4):
                c[s] = min(c[s], REROLE + add + d[_EXPECTED[s]])
                if kept[s] >= 0:
                    c[s] = min(c[s], add + d[kept[s]])
        asked, answered = c[ASKED], c[ANSWERED]
        c[ASKED], c[ANSWERED] = min(asked, INSERT + answered), min(answered, INSERT + asked)
        c[START], c[INSTRUCTED] = min(c[START], INSERT + c[ASKED]), min(c[INSTRUCTED], INSERT + c[ASKED])
        out[i] = d = c
    return out


def optimal_arcs(dist: np.ndarray, codes: np.ndarray, must: np.ndarray, cut: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, letter, next node) of the arcs that keep to the cost to go, by
    node and letter; a node is four times the rows read plus the state. The
    nodes of the last layer have arcs only where it ends the conversation."""
    n, add, found = len(codes), TRUNCATED * cut, []
    node = 4 * np.arange(n + 1)[:, None] + np.arange(4)
    layers = n + 1 if last else n

    def add_arcs(letter: str, on: np.ndarray, to: np.ndarray) -> None:
        found.append((node[: len(on)][on], np.full(int(on.sum()), LETTERS.index(letter)), to[on]))

    here, after = dist[:-1], dist[1:]
    add_arcs("D", here == DELETE + after, node[1:])
    add_arcs("I", dist[:layers] == INSERT + dist[:layers, EXPECTED], node[:layers, EXPECTED])
    kept = KEPT[codes].reshape(n, 4)
    keep_cost = add[:, None] + np.take_along_axis(after, np.maximum(kept, 0), 1)
    add_arcs("K", (kept >= 0) & ~must[:, None] & (here == keep_cost), node[1:, :1] + kept)
    add_arcs("R", ~must[:, None] & (here == REROLE + add[:, None] + after[:, EXPECTED]), node[1:, EXPECTED])
    source, letter, to = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((letter, source))
    return source[order], letter[order], to[order]


def least_path(source: np.ndarray, letter: np.ndarray, to: np.ndarray, start: int, nodes: int) -> np.ndarray:
    """The arcs of the path from start with the least audit.

    A node's arcs have different letters, so what follows an arc is settled by
    the first round's ranks; later rounds order arcs of different nodes."""
    end = len(source)
    first = np.full(nodes, end)
    first[source[::-1]] = np.arange(end)[::-1]
    pointer = np.append(first[to], end)
    rank = np.append(letter + 1, 0)
    pointers = [pointer]
    while (pointer[:-1] != end).any():
        _, rank = np.unique(rank * (end + 2) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
        pointers.append(pointer)
    begin, stop = np.searchsorted(source, [start, start + 1])
    if begin == stop:
        return np.zeros(0, np.int64)
    path = np.array([begin + int(np.argmin(rank[begin:stop]))])
    for pointer in pointers:
        path = np.concatenate([path, pointer[path]])
    return path[path != end]


def cheapest_edits(codes: np.ndarray, must: np.ndarray, cut: np.ndarray) -> tuple[int, str]:
    """(cost, audit) of one conversation, from each row's role (0 to 2: begins
    with s, u or a; 3: anything else), whether it must go, and whether it is truncated.

    Arcs are ranked by chunks of rows, so that memory beside the costs is
    bounded; a chunk begins where the path left the one before."""
    dist = costs(codes.tolist(), must.tolist(), cut.tolist())
    state, audit = START, []
    for at in range(0, max(len(codes), 1), CHUNK):
        stop = min(at + CHUNK, len(codes))
        part = slice(at, stop)
        source, letter, to = optimal_arcs(dist[at : stop + 1], codes[part], must[part], cut[part], stop == len(codes))
        path = least_path(source, letter, to, state, 4 * (stop - at + 1))
        audit.append("".join(LETTERS[x] for x in letter[path]))
        state = int(to[path[-1]]) % 4 if len(path) else state
    return int(dist[0, START]), "".join(audit)


@lru_cache(maxsize=1 << 14)
def _edits_of(rows: bytes) -> tuple[int, str]:
    """cheapest_edits of a short conversation, kept, as most are alike."""
    x = np.frombuffer(rows, np.int8)
    return cheapest_edits((x & 3).astype(np.int64), (x & 4) > 0, (x & 8) > 0)


#: What a conversation's last row says of it.
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Edits of each conversation: conv, place, edit, role, text, and one last
    row a conversation with edit null and REPORT.

    rows has conv, turn, role, text and live, as damaged returns; a role or
    text that is null counts as one space. A conversation's rows go by turn
    (null first), role and text. edit is K (kept), R (given another role), D
    (deleted, with the row as it was) or I (inserted, empty). The rows of a
    conversation are contiguous and in order.

    A row is blank, a duplicate (role and text seen earlier) or truncated (its
    last character but space isn't one of `.!?`), whichever comes first; blank
    ones and duplicates are deleted. gaps counts the turn numbers that lack
    between the first and the last; illegal the neighbours that no chat has.
    A conversation without a live row has an empty audit and zeros. Null conv
    is a conversation; other columns are left out; an empty table has no edits.

    Rows are shuffled once, by conversation. A task streams through a
    conversation twice: first through rows without texts, of which it holds 20
    bytes each and 32 of costs, then through the whole rows, of which it holds
    a batch; so a long conversation is sorted on disk, but never held.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    initial = F.left(role, F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~text.rlike(WORD_CHAR), 1).when(~F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1)).isin(".", "!", "?"), 2).otherwise(0)
    live = F.coalesce(F.col("live"), F.lit(True))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), role, text))
    numbered = rows.select("conv", "turn", role.alias("role"), text.alias("text"), live.alias("live"), place.alias("place"))
    narrow = F.struct(F.lit(0).alias("phase"), code.alias("code"), fault.alias("fault"), F.xxhash64("role", "text").alias("h"), F.xxhash64("text", "role").alias("g"), F.lit(None).cast("string").alias("text"))
    whole = F.struct(F.lit(1).alias("phase"), code.alias("code"), fault.alias("fault"), F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("g"), F.col("text").alias("text"))
    twice = numbered.select("conv", F.col("turn").cast("bigint").alias("turn"), "role", "live", "place", F.explode(F.array(narrow, whole)).alias("x")).where("live or x.phase = 0")
    stream = twice.select("conv", "turn", "role", "live", "place", "x.*").sortWithinPartitions("conv", "phase", "place")
    conv = rows.schema["conv"]
    longs = [T.StructField(c, T.LongType()) for c in REPORT[:-1]]
    schema = T.StructType([conv, T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text")), *longs, T.StructField("audit", T.StringType())])
    return stream.mapInArrow(_repair, schema)


class _Conversation:
    """What a task holds of one conversation between its two streams."""

    def __init__(self, conv):
        self.conv, self.parts, self.letters, self.at, self.state, self.place = conv, [], None, 0, START, 0

    def read(self, columns: dict[str, np.ndarray]) -> None:
        self.parts.append(columns)

    def decide(self) -> None:
        rows = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        self.parts, codes, fault = [], rows["code"], rows["fault"]
        order = np.lexsort((rows["g"], rows["h"]))
        h, g = rows["h"][order], rows["g"][order]
        again = np.zeros(len(codes), bool)
        again[order[1:][(h[1:] == h[:-1]) & (g[1:] == g[:-1])]] = True
        blank, duplicate = fault == 1, again & (fault != 1)
        cut = (fault == 2) & ~duplicate
        cost, audit = _edits_of((codes + 4 * (blank | duplicate) + 8 * cut).astype(np.int8).tobytes()) if len(codes) <= SHORT else cheapest_edits(codes, blank | duplicate, cut)
        turns = rows["turn"][rows["known"]]
        gaps = int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0
        illegal = int((~np.isin(4 * codes[:-1] + codes[1:], [1, 6, 9])).sum()) if len(codes) else 0
        self.letters = audit
        self.report = [gaps, int(blank.sum()), int(duplicate.sum()), int(cut.sum()), illegal, cost, audit]

    def _row(self, letter: str, role: str, text: str) -> tuple:
        self.place += 1
        return (self.conv, self.place, letter, role, text, *[None] * 7)

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.state = _EXPECTED[self.state]
            self.at += 1
            yield self._row("I", ROLE[self.state], "")

    def edited(self, code: int, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self.state = _EXPECTED[self.state]
            role = ROLE[self.state]
        elif letter == "K":
            self.state = _KEPT[code][self.state]
        yield self._row(letter, role, text)

    def ended(self) -> Iterator[tuple]:
        if self.letters is None:
            self.decide()
        yield from self.inserted()
        yield (self.conv, None, None, None, None, *self.report)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, schema, out, size = None, None, [], 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {name: batch.column(name) for name in batch.schema.names}
        if schema is None:
            strings, longs = [(n, pa.string()) for n in ("edit", "role", "text")], [(n, pa.int64()) for n in REPORT[:-1]]
            schema = pa.schema([("conv", c["conv"].type), ("place", pa.int64()), *strings, *longs, ("audit", pa.string())])
        convs, phases = c["conv"].to_pylist(), c["phase"].to_pylist()
        turn = c["turn"]
        columns = {"turn": np.asarray(turn.fill_null(0)), "known": np.asarray(turn.is_valid()), **{k: np.asarray(c[k]) for k in ("code", "fault", "h", "g")}}
        live = np.asarray(c["live"])
        at = 0
        while at < len(convs):
            stop = at + 1
            while stop < len(convs) and phases[stop] == phases[at] and convs[stop] == convs[at]:
                stop += 1
            if now is None or convs[at] != now.conv or (phases[at] == 0 and now.letters is not None):
                if now is not None:
                    out.extend(now.ended())
                now = _Conversation(convs[at])
            if phases[at] == 0:
                on = live[at:stop]
                now.read({k: v[at:stop][on] for k, v in columns.items()})
            else:
                if now.letters is None:
                    now.decide()
                for code, role, text in zip(c["code"][at:stop].to_pylist(), c["role"][at:stop].to_pylist(), c["text"][at:stop].to_pylist(), strict=True):
                    out.extend(now.edited(code, role, text))
                    size += len(text)
                    if size > 1 << 24:
                        yield flushed()
                        out, size = [], 0
            at = stop
        if len(out) > 10_000:
            yield flushed()
            out, size = [], 0
    if now is not None:
        out.extend(now.ended())
    if out:
        yield flushed()


def repaired_turns(edits: DataFrame) -> DataFrame:
    """(conv, place, role, text) of the conversations after repair."""
    return edits.where("edit != 'D'").select("conv", "place", "role", "text")


def repair_report(edits: DataFrame) -> DataFrame:
    """(conv, REPORT), one row for each conversation."""
    return edits.where("edit is null").select("conv", *REPORT)


def report_with_digest(edits: DataFrame) -> DataFrame:
    """repair_report with repaired_sha256, the digest of the repaired rows as
    `role:text`, joined by newlines. It goes on in the tasks that made the
    edits and holds one batch: edits must come from repair_conversations as they are."""
    schema = T.StructType([edits.schema["conv"], *(edits.schema[c] for c in REPORT), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, began = hashlib.sha256(), False
        for batch in batches:
            ends, hashes = [], []
            for i, (edit, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("edit", "role", "text")), strict=True)):
                if edit is None:
                    ends.append(i)
                    hashes.append(digest.hexdigest())
                    digest, began = hashlib.sha256(), False
                elif edit != "D":
                    digest.update(f"{chr(10) if began else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    began = True
            if ends:
                said = batch.select(["conv", *REPORT]).take(pa.array(ends))
                yield pa.RecordBatch.from_arrays([*said.columns, pa.array(hashes)], [*said.schema.names, "repaired_sha256"])

    return edits.mapInArrow(run, schema)

