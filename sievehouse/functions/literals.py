"""What every match of a pattern must hold, as plain texts to be looked for before it is tried."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regexes import holds, java

#: A set of texts larger than this is cut, no more groups than these are kept, and texts of large groups are cut to so many characters.
MOST_TEXTS, MOST_GROUPS, LARGE, HEAD = 32, 3, 16, 8

Group = frozenset[str]


def _useful(group: Group | None) -> bool:
    return bool(group) and all(len(x) > 1 or not x.isalnum() and x > " " for x in group)


def _shortest(group: Group) -> Group:
    """group without the texts that hold another one; of a large one the heads of its texts."""
    group = frozenset(x[:HEAD] for x in group) if len(group) > LARGE else group
    return frozenset(x for x in group if not any(y != x and y in x for y in group))


def _order(group: Group) -> tuple[int, int]:
    """Few texts first, as all of them are looked for where none is there; short ones, which most texts hold, last."""
    least = min(map(len, group))
    return (len(group) * (40 if least < 3 else 10 if least < 4 else 6 if least < 6 else 1), -least)


def _sequence(items) -> tuple[Group | None, list[Group]]:
    whole, run, groups = True, frozenset([""]), []
    for item in items:
        exact, inner = _read(item)
        if exact is not None and len(run) * len(exact) <= MOST_TEXTS:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        groups += [run, *inner]
        run = frozenset([""]) if exact is None else exact
    return (run, []) if whole else (None, [*groups, run])


def _read(item) -> tuple[Group | None, list[Group]]:
    """(all texts that the part may match, or None; groups of which each match holds one text each), lower-cased."""
    op, value = item
    if op is C.LITERAL:
        return (frozenset([chr(value).lower()]), []) if 32 <= value < 127 else (None, [])
    if op is C.IN:
        chars = [v for o, v in value if o is C.LITERAL]
        plain = len(chars) == len(value) <= 4 and all(32 <= v < 127 for v in chars)
        return (frozenset(chr(v).lower() for v in chars), []) if plain else (None, [])
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return frozenset([""]), []
    if op is C.SUBPATTERN:
        return _sequence(value[-1])
    if op is C.ATOMIC_GROUP:
        return _sequence(value)
    if op is C.BRANCH:
        read = [_sequence(x) for x in value[1]]
        if all(e is not None for e, _ in read):
            every = frozenset().union(*(e for e, _ in read))
            return (every, []) if len(every) <= MOST_TEXTS else (None, [_shortest(every)])
        best = [_best(e, g) for e, g in read]
        return None, [] if None in best else [frozenset().union(*best)]
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = value
        exact, groups = _sequence(body)
        if least == 0:
            return (exact | {""}, []) if most == 1 and exact is not None else (None, [])
        return (exact, groups) if least == most == 1 else (None, groups if exact is None else [exact])
    return None, []


def _best(exact: Group | None, groups: list[Group]) -> Group | None:
    found = sorted(filter(_useful, map(_shortest, groups if exact is None else [exact])), key=_order)
    return found[0] if found else None


@cache
def needs(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Groups of lower-cased texts: whatever matches the pattern, its letters
    folded or not, holds at least one text of each group once it is lower-cased.
    None are found for a pattern that can do without any."""
    exact, groups = _sequence(_parser.parse(pattern))
    found = sorted({g for g in map(_shortest, groups if exact is None else [exact]) if _useful(g)}, key=lambda g: (_order(g), sorted(g)))
    return tuple(tuple(sorted(g)) for g in found[:MOST_GROUPS])


def matches(text: Column, low: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the text matches; what every match holds is looked for first in
    low, the lower-cased text, as patterns with word boundaries are slow."""
    return holds(low, needs(pattern)) & text.rlike(java(pattern, ignore_case))


def _any_of(texts) -> str:
    return "(?i:" + "|".join(re.escape(x) for x in sorted(texts)) + ")"


def candidates(wanted: list[tuple[tuple[str, ...], ...] | str]):
    """A function of texts: a number whose bit i is set where a text holds one
    text of each group of wanted[i], or matches it, a pattern without looks
    around. As one automaton looks for all texts of a group, or for those of all
    first groups, this costs little more than reading."""
    if len(wanted) > 63:
        raise ValueError("63 patterns at most")
    always = sum(1 << i for i, x in enumerate(wanted) if not x)
    sets = [(1 << i, [x] if isinstance(x, str) else [_any_of(g) for g in x]) for i, x in enumerate(wanted) if x]
    some = "|".join([_any_of({x for w in wanted if w and not isinstance(w, str) for x in w[0]} or {"\0"}), *(w for w in wanted if w and isinstance(w, str))]) if sets else None

    @F.arrow_udf(T.LongType())
    def mask(texts: pa.Array) -> pa.Array:
        out = np.full(len(texts), always, np.int64)
        if some is None:
            return pa.array(out)
        rows = np.flatnonzero(pc.match_substring_regex(texts, some).fill_null(False).to_numpy(zero_copy_only=False))
        left = texts.take(pa.array(rows))
        for bit, tests in sets:
            at, rest = rows, left
            for test in tests:
                if len(at):
                    hit = pc.match_substring_regex(rest, test)
                    at, rest = at[hit.to_numpy(zero_copy_only=False)], rest.filter(hit)
            out[at] |= bit
        return pa.array(out)

    return mask


def bit(mask: Column, i: int) -> Column:
    return F.getbit(mask, F.lit(i)) == 1
