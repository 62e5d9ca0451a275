"""Chat formatting by a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """How turns of one role are marked, and whether their text is trained on."""

    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of a chat format. Every mark begins with one of openers, which
    texts only hold behind an escape, so no text can pass for a mark."""

    start: str = "<s>"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("[SYS]", "[/SYS]"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("[OUT]", "</s>", loss=True),
        }
    )
    #: For any other role: its name stands between prefix and named.
    other: Role = Role("[ROLE]", "[/ROLE]")
    named: str = "[SAYS]"
    openers: str = "[<"
    escape: str = "\\"
    #: (state, role) -> state; what isn't listed is an error.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    begin: str = "start"
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        marks = [self.start, self.named]
        for role in [*self.roles.values(), self.other]:
            marks += [role.prefix, role.suffix]
        if not all(m and m[0] in self.openers for m in marks):
            raise ValueError("every mark must begin with an opener")
        prefixes = [r.prefix for r in [*self.roles.values(), self.other]]
        if any(a is not b and a.startswith(b) for a in prefixes for b in prefixes):
            raise ValueError("no prefix may begin with another")

    def quoted(self, text: str) -> str:
        """As a literal inside a Java pattern."""
        return "".join(c if c.isalnum() else "\\" + c for c in text)

    @property
    def _special(self) -> str:
        return "[" + self.quoted(self.escape + self.openers) + "]"

    @property
    def body(self) -> str:
        """A Java pattern for an escaped text."""
        plain = "[^" + self.quoted(self.escape + self.openers) + "]*+"
        return f"{plain}(?:{self.quoted(self.escape)}[\\s\\S]{plain})*+"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._special})", self.quoted(self.escape) + "$1")

    def unescaped(self, text: Column) -> Column:
        return F.when(
            F.instr(text, self.escape) > 0, F.regexp_replace(text, self.quoted(self.escape) + "([\\s\\S])", "$1")
        ).otherwise(text)


def _by_role(template: Template, role: Column, known, other) -> Column:
    out = None
    for name, r in template.roles.items():
        out = F.when(role == name, known(r)) if out is None else out.when(role == name, known(r))
    return other if out is None else out.otherwise(other)


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, formatted, segments, valid.

    formatted is the concatenation of the segments' text; segments is an array
    of (text, loss), where loss marks the assistant texts and nothing else.
    valid says whether the machine accepts the order of roles. Turns go by
    turn, then role, then text; repeated rows are turns of their own; null
    turns come first. A null text or role counts as empty, null conversation
    ids make one conversation. An invalid order is flagged, its rows stay.
    Marks are put on before the shuffle; a conversation is then one row.
    """
    t = template
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    head = _by_role(t, r, lambda k: F.lit(k.prefix), F.concat(F.lit(t.other.prefix), t.escaped(r), F.lit(t.named)))
    tail = _by_role(t, r, lambda k: F.lit(k.suffix), F.lit(t.other.suffix))
    loss = _by_role(t, r, lambda k: F.lit(k.loss), F.lit(t.other.loss))
    rows = turns.select(
        F.col(conv).alias(conv),
        F.struct(F.col(turn).alias("turn"), r.alias("role"), x.alias("text"), head.alias("head"), t.escaped(x).alias("body"), tail.alias("tail"), loss.alias("loss")).alias("row"),
    )
    grouped = rows.groupBy(conv).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    moves = F.create_map(*[F.lit(v) for (s, name), to in t.moves.items() for v in (f"{s}>{name}", to)])
    state = F.aggregate(F.col("rows"), F.lit(t.begin), lambda s, x: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), x["role"])), F.lit("error")))
    mark = lambda value: F.struct(value.alias("text"), F.lit(False).alias("loss"))
    segments = F.concat(
        F.array(mark(F.lit(t.start))),
        F.flatten(F.transform("rows", lambda x: F.array(mark(x["head"]), F.struct(x["body"].alias("text"), x["loss"].alias("loss")), mark(x["tail"])))),
    )
    return grouped.select(
        conv,
        F.concat(F.lit(t.start), F.array_join(F.transform("rows", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")).alias("formatted"),
        segments.alias("segments"),
        state.isin(*t.final).alias("valid"),
    )


def parse_chats(chats: DataFrame, template: Template = Template(), formatted: str = "formatted") -> DataFrame:
    """Adds turns, an array of (role, text) read back from formatted, and
    loss_text, all unescaped text under the loss mask of segments."""
    t = template
    prefixes = "|".join(t.quoted(r.prefix) for r in t.roles.values())
    suffixes = "|".join(dict.fromkeys(t.quoted(r.suffix) for r in [*t.roles.values(), t.other]))
    named = f"{t.quoted(t.other.prefix)}{t.body}{t.quoted(t.named)}"
    each = F.regexp_extract_all(F.col(formatted), F.lit(f"(?:{named}|{prefixes}){t.body}(?:{suffixes})"), F.lit(0))

    def turn(x: Column) -> Column:
        other = F.startswith(x, F.lit(t.other.prefix))
        prefix = F.regexp_extract(x, f"^({prefixes})", 1)
        name = None
        for key, r in t.roles.items():
            name = F.when(prefix == r.prefix, F.lit(key)) if name is None else name.when(prefix == r.prefix, F.lit(key))
        named_role = t.unescaped(F.regexp_extract(x, f"^{t.quoted(t.other.prefix)}({t.body})", 1))
        return F.struct(
            F.when(other, named_role).otherwise(name).alias("role"),
            t.unescaped(F.regexp_extract(x, f"^(?:{named}|{prefixes})({t.body})", 1)).alias("text"),
        )

    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescaped(s["text"])), "")
    return chats.withColumns({"turns": F.transform(each, turn), "loss_text": lost})
