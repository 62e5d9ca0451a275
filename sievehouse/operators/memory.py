"""Standing instructions in memory and rules files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions.regexes import before_first, java, matches
from ..functions.text import lines_of
from ..plans import prose as P
from ..plans import signals as S
from . import findings as FN
from . import scan as SC


def is_descriptive(line: Column) -> Column:
    """A line that names a technique and asks for nothing."""
    return matches(line, P.DESCRIPTIVE, True) & ~matches(line, P.IMPERATIVE, True)


def _words(needles: list[str]) -> str:
    return "(?i)(?:" + "|".join(f"(?<!\\w){re.escape(n)}" for n in needles).replace("\\ ", " ") + ")"


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def _prefix(text: Column, needle: Column) -> Column:
    """The text before the first 80 characters of a line, wherever they first occur."""
    probe = F.left(F.trim(needle), F.lit(80))
    at = F.instr(F.lower(text), F.lower(probe))
    return F.when(F.length(probe) >= 3, F.left(text, at - 1))


def _flow_needs() -> tuple[tuple[str, ...], ...]:
    return (*L.needs(P.IMPERATIVE), tuple(P.NETWORK), tuple(P.SENSITIVE))


_FLOW = "flow"
_PATTERNS = [P.OVERRIDE, f"{P.OVERRIDE}|{P.PRECEDENCE}", P.AUTHORITY, P.PERSISTENCE, P.LIFECYCLE, P.SELF, *[x[1] for x in P.SABOTAGE + P.EXFIL], _FLOW]
#: A number of a text that says which of these it may hold, for standing_instructions.
may_hold = L.candidates([_flow_needs() if p == _FLOW else L.needs(p) for p in _PATTERNS])


def _may(held: Column | None, pattern: str) -> Column:
    return F.lit(True) if held is None else L.bit(held, _PATTERNS.index(pattern))


def directives(lines: Column, held: Column | None = None) -> tuple[Column, Column]:
    """(sabotage, exfiltration) labels of a document's lines, in catalogue order."""

    def any_line(test) -> Column:
        return F.exists(lines, test)

    def sabotage(rule) -> Column:
        label, pattern, guarded, also = rule

        def test(line: Column) -> Column:
            hit = matches(line, pattern, True)
            if guarded:
                hit = hit & ~matches(line, P.NEGATION, True) & ~is_descriptive(line)
            return hit & matches(line, also, True) if also else hit

        return F.when(_may(held, pattern) & any_line(test), F.lit(label))

    def exfil(rule) -> Column:
        label, pattern, severity, guarded = rule

        def test(line: Column) -> Column:
            hit = matches(line, pattern, True) & ~matches(line, P.NEGATION, True)
            if guarded:
                hit = hit & ~is_descriptive(line)
            if label == "send-to-external":
                hit = hit & (~matches(line, P.LOCAL_URL, True) | matches(line, P.HOSTILE, True))
            return hit

        return F.when(_may(held, pattern) & any_line(test), F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity")))

    return F.array_compact(F.array(*map(sabotage, P.SABOTAGE))), F.array_compact(F.array(*map(exfil, P.EXFIL)))


def self_reinforcement(lines: Column, rules_file: Column) -> Column:
    """recreate, propagate or undeletable: how an entry arranges to survive; null if it doesn't."""
    own = F.filter(lines, lambda x: matches(x, P.SELF, True) & ~is_descriptive(_without_first(x)))
    strong = _first(own, lambda x: matches(x, P.RECREATE, True) | matches(x, P.PROPAGATE, True))
    weak = F.exists(own, lambda x: matches(x, P.UNDELETABLE, True))
    return F.when(strong.isNotNull(), F.when(matches(strong, P.RECREATE, True), "recreate").otherwise("propagate")).when(weak & ~rules_file, "undeletable")


def _without_first(line: Column) -> Column:
    found = F.regexp_substr(line, F.lit(java(P.SELF, True)))
    at = F.instr(line, found)
    return F.concat(F.left(line, at - 1), F.lit(" "), F.substring(line, at + F.length(found), F.length(line)))


def standing_instructions(text: Column, rules_file: Column, held: Column | None = None, signals: Column | None = None) -> Column:
    """Findings of a memory text, or of a rules file where rules_file is true.
    Rules files may give instructions; only what is hostile in any file counts
    there. Titles occur once. held and signals are may_hold and scan.may_hold of
    the text, which save most of the work."""
    text = F.coalesce(text, F.lit(""))
    lines = lines_of(text)
    noun = F.when(rules_file, "rules file").otherwise("memory")

    def directive(pattern: str) -> Column:
        return _may(held, pattern) & F.exists(lines, lambda x: matches(x, pattern, True) & ~matches(x, P.NEGATION, True) & ~is_descriptive(x))

    wide = f"{P.OVERRIDE}|{P.PRECEDENCE}"
    override = F.when(rules_file, directive(P.OVERRIDE)).otherwise(directive(wide))
    authority = directive(P.AUTHORITY)
    persistent, imperative = _may(held, P.PERSISTENCE) & matches(text, P.PERSISTENCE, True), matches(text, P.IMPERATIVE, True)
    durable = F.when(_may(held, P.PERSISTENCE), _first(lines, lambda x: matches(x, P.PERSISTENCE, True) & matches(x, P.IMPERATIVE, True)))
    title = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    found = lambda *a: FN.finding(*a)
    poisoned = F.when(authority, before_first(text, P.AUTHORITY, True)).when(rules_file, before_first(text, P.OVERRIDE, True)).otherwise(before_first(text, wide, True))
    out = [
        F.when(
            override | authority,
            found(title("Poisoned ", noun, ": ", F.when(authority, "system-authority spoofing").otherwise("injected override directive")), "CRITICAL", "directive", poisoned),
        ).when(~rules_file & durable.isNotNull() & ~is_descriptive(durable), found(F.lit("Suspicious standing instruction in memory"), "HIGH", "directive", _prefix(text, durable)))
    ]
    sabotage, exfil = directives(lines, held)
    out.append(F.when(F.size(sabotage) > 0, found(title("Guardrail-sabotage directive in ", noun, " (", F.array_join(sabotage, ", "), ")"), "CRITICAL", "directive", None)))
    worst = F.when(F.exists(exfil, lambda x: x["severity"] == "CRITICAL"), "CRITICAL").otherwise("HIGH")
    out.append(F.when(F.size(exfil) > 0, found(title("Exfiltration directive in ", noun, " (", F.array_join(F.transform(exfil, lambda x: x["label"]), ", "), ")"), worst, "directive", None)))
    staged = None
    for s in S.SHELL:
        hit = SC._may(signals, s.name) & matches(text, s.pattern, s.fold)
        if s.name == S.FORCE_DELETE:
            hit = hit & SC._any_real_delete(text, s)
        value = found(title("Executable payload staged in ", noun, f": {s.name}"), "HIGH" if s.severity in ("MEDIUM", "LOW") else "CRITICAL", "shell", before_first(text, s.pattern, s.fold))
        staged = F.when(hit, value) if staged is None else staged.when(hit, value)
    out.append(staged)
    host = F.when(SC._may(signals, "hosts"), SC.egress_host(text))
    out.append(F.when(host.isNotNull(), found(title(F.when(rules_file, "Rules file").otherwise("Memory"), " references a data-exfiltration host (", host, ")"), "HIGH", "egress", F.left(text, F.instr(F.lower(text), host) - 1))))
    flow = F.when(_may(held, _FLOW), _first(lines, lambda x: matches(x, P.IMPERATIVE, True) & ~matches(x, P.NEGATION, True) & x.rlike(_words(P.SENSITIVE)) & x.rlike(_words(P.NETWORK)) & ~is_descriptive(x)))
    out.append(F.when(flow.isNotNull(), found(title("Toxic instruction in ", noun, ": reads sensitive data + reaches the network"), "HIGH", "directive", _prefix(text, flow))))
    out.append(F.when(_may(held, P.LIFECYCLE) & matches(text, P.LIFECYCLE, True), found(title(F.when(rules_file, "Rules file").otherwise("Memory"), " references a package-lifecycle hook (MemoryTrap vector)"), "MEDIUM", "directive", before_first(text, P.LIFECYCLE, True))))
    form = F.when(_may(held, P.SELF), self_reinforcement(lines, rules_file))
    out.append(F.when(form.isNotNull(), found(title("Self-reinforcing ", noun, " entry (", form, ")"), F.when(form == "undeletable", "HIGH").otherwise("CRITICAL"), "directive", None)))
    seen = override | authority | (~rules_file & persistent & imperative)
    shared = SC.scan(text, ("injection", "secret", "pii"), signals)
    named = {"injection": ("Injected instruction in ", "HIGH"), "secret": ("Live credential stored in ", "CRITICAL"), "pii": ("Personal data stored in ", "MEDIUM")}

    def retitle(x: Column) -> Column:
        label = reduce(lambda a, kv: F.when(x["category"] == kv[0], title(kv[1][0], noun, ": ", x["label"])).otherwise(a), named.items(), x["label"])
        level = reduce(lambda a, kv: F.when(x["category"] == kv[0], kv[1][1]).otherwise(a), named.items(), x["severity"])
        return x.withField("label", label).withField("severity", level)

    kept = F.transform(F.filter(shared, lambda x: ~(seen & (x["category"] == "injection"))), retitle)
    return F.concat(FN.gather(out), kept)


def governed_kind(kind: Column, path: Column) -> Column:
    """INSTRUCTION, MEMORY or null, by an explicit kind or else by the path."""
    p = F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), "[\\\\/]+", "/"))
    base = F.substring_index(p, "/", -1)
    rules = base.isin(*P.RULES_FILES) | p.rlike("(^|/)\\.cursor/rules/.+\\.mdc\\z") | (p.rlike("(^|/)\\.clinerules/") & p.endswith(".md"))
    memory = base.isin(*P.MEMORY_FILES) | p.rlike("(^|/)(\\.mem0|\\.letta|\\.memgpt|memory)/")
    by_path = F.when(rules, "INSTRUCTION").when(memory, "MEMORY")
    return F.when(kind == "rules", "INSTRUCTION").when(kind == "memory", "MEMORY").when(F.coalesce(kind, F.lit("auto")) == "auto", by_path)


def grade_memory(docs: DataFrame, kind: str = "kind", text: str = "text") -> DataFrame:
    """docs with findings (titles once), verdict, risk_score."""
    found = standing_instructions(F.col(text), F.col(kind) == "INSTRUCTION", F.col("__held"), F.col("__signals"))
    out = docs.withColumns({"__held": may_hold(text), "__signals": SC.may_hold(text)}).withColumn("findings", found).drop("__held", "__signals")
    out = out.withColumn("findings", FN.keep_first(F.col("findings"), lambda x: x["label"]))
    return out.withColumn("grade", FN.grade(F.col("findings"))).select("*", "grade.verdict", "grade.risk_score").drop("grade")
