"""Byte-level BPE by a tokenization automaton.

The automaton reads token sequences. It starts with one state that loops on
every byte. For each merge (u, v) -> w, in rank order, a gadget is added: from
every state from which u and then v can be read, an arc w leads where v led,
and the state behind u loses its arc v (it is split off first if other labels
lead to it as well). The automaton then accepts exactly one token sequence for
each byte string: the one that BPE makes.

It is deterministic, and all arcs with the same label lead to the same state.
So it is kept as tables: the state behind each token, and for each state the
arcs that were cut from it and when. A word is encoded from left to right: for
each prefix there is one token that ends it and that can be read in the state
behind the shorter prefix. Decoding emits the labels' bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts a text into words before merging.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"



def _near_split() -> re.Pattern[str]:
    """PRE_SPLIT for texts without characters beyond U+FFFF, for Python's own
    engine, which takes two thirds of the time. It has no classes of letters
    and numbers, so these are spelled out, as the other engine sees them."""
    chars = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    letter, number, space = ("".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for x in regex.findall(f"{kind}+", chars)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


#: A worker's cache holds at most so many words, or those of one run of texts.
CACHED_WORDS = 500_000
#: So many characters are encoded at once.
TOGETHER = 1_500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """The deterministic automaton of a list of merges."""

    START = 0
    #: So many bytes before a place select the tokens that may end there, unless a longer one is possible.
    #: Few, as words share short contexts: on 280,000 words of check_l 3 bytes make 9,000 contexts, 6 bytes 228,000.
    NEAR = 3

    def __init__(self, single: list[int], merges: list[tuple[int, int, int]], labels: dict[int, bytes]):
        """single: the token of each byte; merges: (left, right, merged) by rank; labels: each token's bytes."""
        self.labels = labels
        self.made: dict[int, tuple[int, int]] = {}  # token: left part, rank of its merge
        self.behind = dict.fromkeys(single, self.START)
        self.cut: list[dict[int, int]] = [{}]  # state: {token: rank of the cut}
        self.origin: list[tuple[int, int]] = [(-1, -1)]  # state: the state that it was split off, rank
        users = [len(single) + 1]  # the start itself uses its state, so it is never cut
        for rank, (left, right, merged) in enumerate(merges):
            if merged in self.behind or left not in self.behind or right not in self.behind:
                continue
            before, after = self.behind[left], self.behind[right]
            if not self._has(before, right, rank - 1):
                continue
            self.made[merged] = left, rank
            self.behind[merged] = after
            users[after] += 1
            if users[before] > 1:
                users[before] -= 1
                self.cut.append({})
                self.origin.append((before, rank))
                users.append(1)
                self.behind[left] = before = len(self.cut) - 1
            self.cut[before][right] = rank
        self._arcs: dict[int, bool] = {}
        self._near: dict[bytes, tuple[list[tuple[int, int]], int]] = {}
        self._ends: dict[int, int] = {}
        self._token: list[int] = [-1]
        for token in self.behind:
            node = 0
            for byte in reversed(labels[token]):
                nxt = self._ends.get(node << 8 | byte)
                if nxt is None:
                    nxt = self._ends[node << 8 | byte] = len(self._token)
                    self._token.append(-1)
                node = nxt
            self._token[node] = token

    def _has(self, state: int, token: int, rank: int) -> bool:
        """Whether the state has an arc of that label once the merges up to rank are added."""
        while True:
            at, until = state, rank
            while at >= 0:
                if self.cut[at].get(token, until + 1) <= until:
                    return False
                at, since = self.origin[at]
                until = min(until, since - 1)
            if token not in self.made:
                return True
            token, rank = self.made[token]

    def arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) > 2_000_000:
                self._arcs.clear()
            known = self._arcs[key] = self._has(state, token, 1 << 40)
        return known

    def _endings(self, word: bytes, end: int, start: int) -> tuple[list[tuple[int, int]], int]:
        """(length, token) of all tokens that end at end and begin at start or later, longest first, and the node there (-1: none)."""
        node, found = 0, []
        for at in range(end - 1, start - 1, -1):
            node = self._ends.get(node << 8 | word[at], -1)
            if node < 0:
                break
            if self._token[node] >= 0:
                found.append((end - at, self._token[node]))
        return found[::-1], node

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of pre-split words. What a word's run through the tables
        shares with the run of the word before is not run again, so sorted
        words are the fastest."""
        arcs, behind, near, width, ends, made = self._arcs, self.behind, self._near, self.NEAR, self._ends, self._token
        states, tokens, starts, before, out = [self.START], [-1], [0], b"", []
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], tokens[shared + 1 :], starts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - width if end > width else 0
                context = word[start:end]
                known = near.get(context)
                if known is None:
                    if len(near) > 1_000_000:
                        near.clear()
                    known = near[context] = self._endings(word, end, start)
                found, node = known
                if start and node >= 0:
                    at, longer = start, []
                    while at and (node := ends.get(node << 8 | word[at - 1], -1)) >= 0:
                        at -= 1
                        if made[node] >= 0:
                            longer.append((end - at, made[node]))
                    if longer:
                        found = longer[::-1] + found
                for length, token in found:
                    state = states[end - length]
                    allowed = arcs.get(state << 20 | token)
                    if allowed is None:
                        allowed = self.arc(state, token)
                    if allowed:
                        states.append(behind[token])
                        tokens.append(token)
                        starts.append(end - length)
                        break
                else:
                    raise ValueError("a byte has no token")
            before, end, ids = word, len(word), []
            while end:
                ids.append(tokens[end])
                end = starts[end]
            ids.reverse()
            out.append(ids)
        return out


class Tokenizer:
    """A byte-level BPE vocabulary file in the JSON form of the tokenizers library."""

    def __init__(self, definition: str):
        j = json.loads(definition)
        model, alphabet = j["model"], byte_alphabet()
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens") or []}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        single = [vocab[c] for c in alphabet]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(single, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], self.bytes_of)
        self._all_words, self._near_words = regex.compile(PRE_SPLIT), _near_split()
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._cache: dict[str, list[int]] = {}

    def _words(self, text: str) -> list[str]:
        """The pre-split words."""
        beyond = not text.isascii() and len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return (self._all_words if beyond else self._near_words).findall(text)

    def _pieces(self, text: str) -> list[str | int]:
        """The pre-split words; special tokens, which the library finds in texts as well, as their ids."""
        if self._specials is None or not self._specials.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self._specials.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._words(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cache, pieces = self._cache, [self._pieces(x) for x in texts]
        new = {w for x in pieces for w in x} - cache.keys()
        if len(cache) + len(new) > CACHED_WORDS:
            cache.clear()
            new = {w for x in pieces for w in x}
        special = [w for w in new if type(w) is int]
        cache.update((w, struct.pack("<I", w)) for w in special)
        words = sorted((w.encode("utf-8"), w) for w in new.difference(special))
        for (_, w), ids in zip(words, self.automaton.encode_sorted([raw for raw, _ in words]), strict=True):
            cache[w] = struct.pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(cache.__getitem__, x)) for x in pieces]

    def decode(self, ids: bytes) -> str:
        """Emits the label of each arc."""
        labels = map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(labels).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def _tokenizer(definition: str) -> Tokenizer:
    key = hashlib.md5(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(definition)
    return _LOADED[key]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of about TOGETHER characters."""
    begin = chars = 0
    for i, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        chars += size or 0
        if chars >= TOGETHER:
            yield batch.slice(begin, i + 1 - begin)
            begin, chars = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """Encodes every whole text and decodes it again.

    vocabulary: the path of the vocabulary file on the driver; its content, a
    few MB whatever the input, is broadcast. Returns key, n_tokens, ids_sha256
    (ids as little-endian unsigned 32-bit integers), decoded_sha256, and if
    asked for the columns token_ids and decoded. A null text counts as empty:
    no tokens. Repeated rows are encoded each for itself, other columns are not
    read. No row moves between tasks; a task holds its word cache and the
    tokens of about TOGETHER characters, or of one longer text.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids, *["decoded"] * with_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or _tokenizer(definition.value)
            for part in _portions(batch):
                ids = tokenizer.encode([v or "" for v in part.column(1).to_pylist()])
                decoded_hashes, texts = [], []
                for x in ids:
                    decoded = tokenizer.decode(x)
                    decoded_hashes.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_decoded:
                        texts.append(decoded)
                counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                columns = [part.column(0), pa.array(counts), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded_hashes, pa.string())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if with_decoded:
                    columns.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids array<int>" * with_ids + ", decoded string" * with_decoded
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
