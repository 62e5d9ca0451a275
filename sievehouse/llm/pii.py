"""Personal data by weak supervision: labelers vote on candidate spans,
expectation-maximisation estimates how reliable each is, and a span classifier
is trained on the estimated labels. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
_TOKEN = "[^\\s@<>()\\[\\],;\"]"
#: Where a match may begin so that no character is scanned twice: leftmost matches begin there anyway.
_EMAIL = f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
_IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}+"
_CARD = "[0-9](?:[\\x20-]?[0-9])++"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
BASE = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: Shapes that may be personal data though the base patterns don't take them.
WIDE = {
    "email": f"(?:\\G|(?<!{_TOKEN})){_TOKEN}++@{_TOKEN}++|(?:\\G|(?<!{_LOCAL})){_LOCAL}++\\x20?(?:\\(at\\)|\\[at\\])\\x20?[A-Za-z0-9-]++(?:\\x20?(?:\\.|\\(dot\\)|\\[dot\\])\\x20?[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": "(?<![0-9])[0-9]{4}(?:[\\x20./-][0-9]{4}){3}(?![0-9])",
    "phone": "(?<![0-9+(.-])(?:\\([0-9]{2,4}\\)|[0-9]{2,4})(?:[\\x20.-][0-9]{2,4}){2,4}(?![0-9])",
}
_MAYBE = {"email": "@", "ip": "."}

#: Gazetteers: what a value of the kind commonly ends or begins with.
GAZETTEER = {
    "email": "(?i)\\.(?:com|org|net|edu|gov|info|io|co|eu|de|fr|es|uk|it|nl|ch|at|be|us|ca|mx|br|jp|cn|in)$",
    "ip": "^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\\.|:",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": "^(?:\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\\(?0?[2-9])",
}
CONTEXT = {
    "email": "(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt|adresse)\\W*(?:\\w+\\W+){0,2}$",
    "ip": "(?i)(?:\\bip\\b|address|host|server|client|login|from|via|servidor|serveur)\\W*(?:\\w+\\W+){0,2}$",
    "card": "(?i)(?:card|visa|credit|debit|payment|karte|tarjeta|carte)\\W*(?:\\w+\\W+){0,2}$",
    "phone": "(?i)(?:phone|tel|telefon|mobile|call|fax|whatsapp|ruf|llam\\w*|appel\\w*)\\W*(?:\\w+\\W+){0,2}$",
}
AGAINST = "(?i)(?:version|ver|v|release|isbn|issn|section|chapter|page|id|no|nr|build|order|invoice|sha|md5)[\\s.:#=]*$"
VOTES = ("regex", "gazetteer", "context", "boundary", "check")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(10, 15)


def _matches(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Array of (start, end, kind, base, value, before, after) of the leftmost,
    non-overlapping matches, in code points, end exclusive."""

    def starts(found: Column, gaps: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

        def step(s: Column, i: Column) -> Column:
            begin = s["at"] + F.length(F.get(gaps, i))
            return F.struct((begin + F.length(F.get(found, i))).alias("at"), F.array_append(s["all"], begin).alias("all"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda s: s["all"])

    def span(found: Column, gaps: Column, begins: Column) -> Column:
        return F.transform(
            found,
            lambda x, i: F.struct(
                F.get(begins, i).alias("start"), (F.get(begins, i) + F.length(x)).alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                x.alias("value"), F.right(F.get(gaps, i), F.lit(40)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
            ),
        )

    def some(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.when(F.size(found) > 0, let(gaps, lambda g: let(starts(found, g), lambda b: span(found, g, b)))).otherwise(_none())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string,base:boolean,value:string,before:string,after:string>>")


def candidates(text: Column) -> Column:
    """All candidate spans of a whole text: the valid base matches, and wide
    matches that overlap none of them."""

    def of(patterns: dict[str, str], base: bool) -> list[Column]:
        return [F.when(F.instr(text, _MAYBE[k]) > 0 if base and k in _MAYBE else F.lit(True), _matches(text, p, k, base)).otherwise(_none()) for k, p in patterns.items()]

    def valid(kind: str, spans: Column) -> Column:
        return F.filter(spans, lambda s: _valid(kind, s["value"]))

    checked = [valid(kind, spans) for kind, spans in zip(BASE, of(BASE, True), strict=True)]

    def more(base: Column) -> Column:
        wide = F.concat(*of(WIDE, False))
        return F.concat(base, F.filter(wide, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))

    # Every pattern needs an @, an "at" in brackets, or a digit; few texts have one.
    return F.when(text.rlike("[0-9@]|[(\\[]at[)\\]]"), let(F.concat(*checked), more)).otherwise(_none())


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def votes(s: Column) -> list[Column]:
    """What each labeler says of a span: 1 personal data, -1 not, 0 nothing."""
    value, kind = s["value"], s["kind"]
    yes = lambda c: F.when(c, 1)
    listed = _by_kind(kind, {k: value.rlike(p) for k, p in GAZETTEER.items()})
    near = _by_kind(kind, {k: s["before"].rlike(p) for k, p in CONTEXT.items()})
    joined = s["before"].rlike("[\\p{L}\\p{N}_/=-]$") | s["after"].rlike("^[\\p{L}\\p{N}_/=@]")
    check = _by_kind(
        kind,
        {
            "email": value.rlike("^[^@]{1,64}@[^@]+\\.[A-Za-z]{2,}$|[(\\[]at[)\\]]"),
            "ip": value.rlike("^[0-9.]+$|^[0-9A-Fa-f:]+$") & ~value.rlike("^(?:0|127)\\."),
            "card": F.when(F.length(_digits(value)).between(13, 19), luhn(_digits(value))).otherwise(F.lit(False)),
            "phone": F.length(_digits(value)).between(9, 15),
        },
    )
    return [
        yes(s["base"]).otherwise(0),
        yes(listed).otherwise(-1),
        yes(near).when(s["before"].rlike(AGAINST), -1).otherwise(0),
        yes(~joined).otherwise(-1),
        yes(check).otherwise(-1),
    ]


def _shape(s: Column) -> Column:
    """A coarse class of the span's length, 0 to 3."""
    n = F.length(s["value"])
    return F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3)


@dataclass
class SpanModel:
    """Reliabilities of the labelers, and the weights of the span classifier."""

    prior: dict[str, float] = field(default_factory=dict)
    says: dict[tuple[str, int, int, int], float] = field(default_factory=dict)  # (kind, labeler, class, vote)
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, s: Column) -> Column:
        """Log odds of a span."""

        def of(kind: str) -> Column:
            total = F.lit(self.weights.get(kind, 0.0))
            for j, v in enumerate(votes(s)):
                total = total + F.when(v == 1, F.lit(self.weights.get(f"{kind}:{j}:1", 0.0))).when(v == -1, F.lit(self.weights.get(f"{kind}:{j}:-1", 0.0))).otherwise(F.lit(0.0))
            shape = _shape(s)
            for c in range(4):
                total = total + F.when(shape == c, F.lit(self.weights.get(f"{kind}:s{c}", 0.0))).otherwise(F.lit(0.0))
            return total

        return _by_kind(s["kind"], {k: of(k) for k in KINDS})


def _estimate(table: dict[str, dict[tuple[int, ...], float]], model: SpanModel, rounds: int) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over counts of vote patterns, kind by kind; the
    first guess is the majority. Returns the probability of each pattern."""
    known = {}
    for kind, counts in table.items():
        p = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v in counts}
        for _ in range(rounds):
            mass = [1.0, 1.0]
            says = {(j, y, x): 0.5 for j in range(len(VOTES)) for y in (0, 1) for x in (-1, 0, 1)}
            for v, n in counts.items():
                for y, w in ((1, p[v] * n), (0, (1 - p[v]) * n)):
                    mass[y] += w
                    for j, x in enumerate(v):
                        says[j, y, x] += w
            total = {(j, y): sum(says[j, y, x] for x in (-1, 0, 1)) for j in range(len(VOTES)) for y in (0, 1)}
            says = {(j, y, x): s / total[j, y] for (j, y, x), s in says.items()}
            prior = mass[1] / sum(mass)
            for v in counts:
                odds = math.log(prior / (1 - prior)) + sum(math.log(says[j, 1, x] / says[j, 0, x]) for j, x in enumerate(v))
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        model.prior[kind] = prior
        model.says |= {(kind, j, y, x): s for (j, y, x), s in says.items()}
        known |= {(kind, v): q for v, q in p.items()}
    return known


def train_span_model(docs: DataFrame, text: str = "text", rounds: int = 25, epochs: int = 300) -> SpanModel:
    """Votes on the candidates of all texts are counted by pattern (kind, votes,
    length class), so the driver gets 4 * 3^5 * 4 rows at most. The classifier,
    a logistic regression for each kind, is fitted to the estimated labels.
    Null texts have no candidates, repeated rows count again, and without a
    candidate of a kind no span of it is added. The first guess of a tie of votes is one half."""
    spans = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("s"))
    pattern = spans.select(F.col("s.kind").alias("kind"), *[v.alias(f"v{j}") for j, v in enumerate(votes(F.col("s")))], _shape(F.col("s")).alias("shape"))
    rows = pattern.groupBy(*pattern.columns).count().collect()
    rows.sort(key=lambda r: tuple(r))
    model, table = SpanModel(), {}
    cells = [(r["kind"], tuple(r[f"v{j}"] for j in range(len(VOTES))), r["shape"], r["count"]) for r in rows]
    for kind, v, _, n in cells:
        table.setdefault(kind, {})
        table[kind][v] = table[kind].get(v, 0) + n
    known = _estimate(table, model, rounds)
    for kind in table:
        data = []
        for k, v, shape, n in cells:
            if k == kind:
                names = [kind, *(f"{kind}:{j}:{x}" for j, x in enumerate(v) if x), f"{kind}:s{shape}"]
                data.append((names, known[kind, v], math.log1p(n)))
        size = sum(n for _, _, n in data)
        weights: dict[str, float] = {}
        for _ in range(epochs):
            slope: dict[str, float] = {}
            for names, y, n in data:
                z = sum(weights.get(x, 0.0) for x in names)
                error = (y - 1 / (1 + math.exp(-z))) * n / size
                for x in names:
                    slope[x] = slope.get(x, 0.0) + error
            for x, g in slope.items():
                weights[x] = weights.get(x, 0.0) + 1.5 * (g - 1e-3 * weights.get(x, 0.0))
        model.weights |= weights
    return model


def find_spans(text: Column, model: SpanModel) -> Column:
    """Array of (start, end, kind, base): base matches, and candidates that the
    classifier takes for personal data, by start, then kind as listed."""
    taken = F.filter(candidates(text), lambda s: s["base"] | (model.score(s) > 0))
    order = lambda k: _by_kind(k, {name: F.lit(i) for i, name in enumerate(KINDS)})
    keyed = F.transform(taken, lambda s: F.struct(s["start"].alias("start"), order(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return F.array_distinct(F.sort_array(keyed))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """docs with found, the array of spans of the whole text. A null or empty
    text has none; repeated rows have the same; of spans that tie in start the
    kind as listed decides; other columns are kept, one named found is replaced."""
    return docs.withColumn("found", find_spans(F.coalesce(F.col(text), F.lit("")), model))


def redact(docs: DataFrame, model: SpanModel, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping
    spans the first stands, up to the end of the last. chars, if there, is
    counted anew. Null texts stay null; each row, repeated ones too, is
    redacted for itself; all other columns stay, whatever their names."""
    marked = docs.withColumn("__spans", find_spans(F.coalesce(F.col(text), F.lit("")), model))
    x = F.col(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        fresh = span["start"] >= s["at"]
        return F.struct(
            F.greatest(s["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(s["out"], F.substring(x, s["at"] + 1, span["start"] - s["at"]), F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(s["out"]).alias("out"),
        )

    clean = F.aggregate("__spans", zero, step, lambda s: F.concat(s["out"], F.substring(x, s["at"] + 1, F.length(x))))
    out = marked.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(x))
    if chars and chars in docs.columns:
        out = out.withColumn(chars, F.when(F.size("__spans") > 0, F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return out.select(*docs.columns)
