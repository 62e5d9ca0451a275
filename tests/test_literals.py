"""What must be there before a pattern is tried never hides a match."""

import random
import re
from re import _constants as C
from re import _parser

from pyspark.sql import functions as F

from sievehouse.functions import literals as L
from sievehouse.operators import models, usage
from sievehouse.operators import source_code as SRC
from sievehouse.plans import prose as P
from sievehouse.plans import signals as S

PATTERNS = (
    [r[4] for rules in SRC.LANGUAGES.values() for r in rules] + [*SRC.MODEL_CALL.values(), *SRC.FLOW_SINK.values()] + [p for _, _, p in P.CAPABILITIES]
    + [getattr(P, x) for x in ("PERSISTENCE", "OVERRIDE", "PRECEDENCE", "AUTHORITY", "LIFECYCLE", "IMPERATIVE", "NEGATION", "DESCRIPTIVE", "SELF", "RECREATE", "PROPAGATE", "UNDELETABLE", "DISCLAIMER", "ACTION", "GOAL")]
    + [x[1] for x in P.SABOTAGE + P.EXFIL] + [s.pattern for some in (S.SHELL, S.INJECTIONS, S.SECRETS, S.PERSONAL) for s in some] + [c for p in usage.PROVIDERS for c in p.call]
    + [getattr(models, x) for x in ("LOADER", "QUOTED", "PRETRAINED", "SENTENCE", "KEYWORD", "YAML", "REVISION", "URL", "OLLAMA", "TORCH")]
)


def sample(items, r):
    """A text that the parts may match, as far as looks around it allow."""
    out = ""
    for op, value in items:
        if op is C.LITERAL:
            out += chr(value).upper() if r.random() < 0.3 else chr(value)
        elif op in (C.NOT_LITERAL, C.ANY):
            out += r.choice("a b")
        elif op is C.IN:
            one = r.choice(value)
            out += chr(one[1]) if one[0] is C.LITERAL else chr(r.randint(*one[1])) if one[0] is C.RANGE else " " if one[1] is C.CATEGORY_SPACE else r.choice("a1_")
        elif op is C.SUBPATTERN:
            out += sample(value[-1], r)
        elif op is C.ATOMIC_GROUP:
            out += sample(value, r)
        elif op is C.BRANCH:
            out += sample(r.choice(value[1]), r)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            out += "".join(sample(value[2], r) for _ in range(r.randint(value[0], min(value[1], value[0] + 2))))
    return out


def matching_texts():
    r = random.Random(5)
    for i, pattern in enumerate(PATTERNS):
        try:
            test = re.compile(pattern, re.I | re.A)
        except re.error:  # a look behind of any length
            continue
        texts = [x for _ in range(200) if test.search(x := sample(_parser.parse(pattern), r))]
        yield i, pattern, texts


def test_matches_hold_what_is_needed(spark):
    tried, rows = 0, []
    for i, pattern, texts in matching_texts():
        tried += bool(texts)
        rows += [(i, x) for x in texts[:20]]
        assert all(any(n in x.lower() for n in group) for x in texts for group in L.needs(pattern)), pattern
    assert tried > 0.9 * len(PATTERNS)
    for start in range(0, len(PATTERNS), 60):
        part = PATTERNS[start : start + 60]
        df = spark.createDataFrame([(i - start, x) for i, x in rows if start <= i < start + 60], "i int, text string")
        mask = L.candidates([L.needs(p) for p in part])
        assert df.select("i", mask("text").alias("m")).where(F.getbit("m", F.col("i")) != 1).count() == 0


def test_needs_of_small_patterns(spark):
    assert L.needs(r"\bfoo(bar|baz)?\s*\(") == (("foo",), ("(",)) and L.needs(r"a?\w+") == () and L.needs("x|yes") == ()
    assert L.needs(r"(?i)e-?mails?") == (("e-mail", "email"),) and L.needs("(one|two)[^.]{0,3}three") == (("three",), ("one", "two"))
    df = spark.createDataFrame([("say One then three",), ("three",), ("",), (None,), ("line\nEMAIL",)], "t string")
    got = [r.m for r in df.select(L.candidates([L.needs("(one|two).*three"), L.needs("e-?mail"), L.needs("")])("t").alias("m")).collect()]
    assert got == [5, 4, 4, 4, 6]
