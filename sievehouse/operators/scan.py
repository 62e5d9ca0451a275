"""The flat scan of a text: shell, injection, secret, pii, config and egress signals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals as L
from ..functions import regexes as R
from ..functions.regexes import before_first, java, matches
from ..functions.text import mark_at, mask_of
from ..plans import signals as S
from . import findings as FN

CATEGORIES = ("shell", "injection", "secret", "pii", "config", "egress")
DEFAULT = ("shell", "injection", "secret", "config", "egress")


def decoded_blobs(text: Column) -> Column:
    """Texts hidden in long base64 runs that read like a payload."""

    def decode(blob: Column) -> Column:
        clean = F.rtrim(blob, F.lit("="))
        padded = F.rpad(clean, (F.ceil(F.length(clean) / 4) * 4).cast("int"), F.lit("="))
        return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    texts = F.transform(F.regexp_extract_all(text, F.lit(java(S.BLOB)), F.lit(0)), decode)
    readable = lambda t: F.length(F.regexp_replace(t, "[^\\x09\\x0a\\x0d\\x20-\\x7e]", "")) >= F.length(t) * 0.85
    return F.filter(texts, lambda t: t.isNotNull() & (F.length(t) > 0) & readable(t) & matches(t, S.BLOB_PAYLOAD, True))


def deletes_real_data(line: Column) -> Column:
    """Whether a line that deletes by force has a target that can't be built again."""
    shape = java(r"\brm\s+((?:-[a-zA-Z]+\s+)+)(.*)$")
    rest = F.split(F.regexp_extract(line, shape, 2), "&&|\\|\\||[;|>&]", 2)[0]
    targets = F.filter(F.split(rest, "\\s+"), lambda t: (t != "") & ~t.startswith("-"))
    bare = lambda t: F.regexp_replace(t, "^[\"']|[\"']\\z", "")
    return ~line.rlike(shape) | (F.size(targets) == 0) | F.exists(targets, lambda t: ~matches(bare(t), S.BUILD_OUTPUT, True))


_BLOB_LIKE = "[A-Za-z0-9+/]{32}"
#: What a text may hold, by the bits of may_hold: signals by name, and whole lists.
_WANTED = {s.name: s.gate or (*s.needs, *L.needs(s.pattern)) for some in (S.SHELL, S.INJECTIONS, S.SECRETS, S.PERSONAL) for s in some} | {
    "blob": _BLOB_LIKE, "phrases": (tuple(S.PHRASES),), "invisible": S.INVISIBLE, "settings": (tuple(S.SETTINGS),), "hosts": (tuple(S.HOSTS),),
}
_PLACE = {name: i for i, name in enumerate(_WANTED)}
#: A number of a text that says which signals it may hold, for scan.
may_hold = L.candidates(list(_WANTED.values()))


def _may(held: Column | None, name: str) -> Column:
    return F.lit(True) if held is None else L.bit(held, _PLACE[name])


def _hit(text: Column, low: Column, s: S.Signal, held: Column | None = None) -> Column:
    """Whether the text matches: what every match holds is looked for first, as
    the patterns with their word boundaries are slow."""
    gate = _may(held, s.name) if held is not None else text.rlike(s.gate) if s.gate else R.holds(low, s.needs)
    return gate & matches(text, s.pattern, s.fold)


def _placed(label: Column, severity: str, category: str, prefix: Column) -> Column:
    return R.let(prefix, lambda p: FN.finding(label, severity, category, p))


def _shell(text: Column, low: Column, held: Column | None = None) -> list[Column]:
    """The findings in the text and in what its base64 runs hide, which is decoded once a row."""
    loose_blob = text.rlike(_BLOB_LIKE) if held is None else _may(held, "blob")
    hidden = F.when(loose_blob & matches(text, S.BLOB), F.array_join(decoded_blobs(text), "\n")).otherwise("")

    def found(blobs: Column) -> Column:
        """(decoded, signals): what is in the blobs alone has no place."""
        none = lambda s: FN.finding(F.lit(s.name), s.severity, "shell", None)
        here = lambda s: _placed(F.lit(s.name), s.severity, "shell", before_first(text, s.pattern, s.fold))
        real = lambda x, s: _any_real_delete(x, s) if s.name == S.FORCE_DELETE else F.lit(True)
        plain = [F.when(_hit(text, low, s, held) & real(text, s), here(s)) for s in S.SHELL]
        both = F.concat(text, F.lit("\n"), blobs)
        mixed = [F.when(matches(both, s.pattern, s.fold) & real(both, s), F.when(matches(text, s.pattern, s.fold), here(s)).otherwise(none(s))) for s in S.SHELL]
        decoded = FN.finding(F.lit("Base64-encoded shell / RCE payload"), "CRITICAL", "shell", None)
        return F.when(blobs == "", FN.gather(plain)).otherwise(FN.gather([decoded, *mixed]))

    return R.let(hidden, found)


def _any_real_delete(text: Column, s: S.Signal) -> Column:
    return F.exists(F.split(text, "\n"), lambda line: matches(line, s.pattern, s.fold) & deletes_real_data(line))


def _negated(prefix: Column) -> Column:
    return matches(F.right(prefix, F.lit(20)), S.NEGATED, True)


def _injection(text: Column, low: Column, held: Column | None = None) -> Column:
    phrase = None
    for p in S.PHRASES:
        prefix = F.left(text, F.instr(low, p) - 1)
        value = _placed(F.lit(f'Injected instruction: "{p}"'), "HIGH", "injection", prefix)
        hit = F.contains(low, F.lit(p)) & ~_negated(prefix)
        phrase = F.when(hit, value) if phrase is None else phrase.when(hit, value)
    out = [F.when(_may(held, "phrases"), phrase)]
    for s in S.INJECTIONS:
        hit = _hit(text, low, s, held) & ~_negated(before_first(text, s.pattern, s.fold))
        if s.name == S.BULK_DELETE:
            hit = hit & ~matches(F.regexp_substr(text, F.lit(java(s.pattern, s.fold))), S.BUILD_STEP, True)
        out.append(F.when(hit, _placed(F.lit(s.name), s.severity, "injection", before_first(text, s.pattern, s.fold))))
    invisible = (text.rlike("[^\\x{0}-\\x{61B}]") if held is None else _may(held, "invisible")) & text.rlike(S.INVISIBLE)
    out.append(F.when(invisible, _placed(F.lit("Invisible / zero-width characters"), "MEDIUM", "injection", F.split(text, S.INVISIBLE, 2)[0])))
    return FN.gather(out)


def is_placeholder(value: Column) -> Column:
    """Sample words, masks, runs of one character and trivial sequences are no credentials."""

    def of(value: Column) -> Column:
        low, tail = F.lower(value), F.regexp_replace(value, "^\\w{1,10}[-_]", "")
        out = F.lit(False)
        for p in S.PLACEHOLDERS:
            out = out | matches(low, p)
        return out | matches(tail, S.PLACEHOLDER_TAILS[0]) | matches(tail, S.PLACEHOLDER_TAILS[1], True)

    return R.let(value, of)


def _secret(text: Column, low: Column, held: Column | None = None) -> Column:
    out = []
    for s in S.SECRETS:
        hit = _hit(text, low, s, held) & ~is_placeholder(F.regexp_substr(text, F.lit(java(s.pattern, s.fold))))
        out.append(F.when(hit, _placed(F.lit(f"Live credential: {s.name}"), s.severity, "secret", before_first(text, s.pattern, s.fold))))
    return FN.gather(out)


def luhn_valid(value: Column) -> Column:
    def checked(digits: Column) -> Column:
        def worth(i: Column) -> Column:
            d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
            return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

        total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + worth(i))
        return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))

    return R.let(F.regexp_replace(value, "[^0-9]", ""), checked)


def personal_value(text: Column, s: S.Signal) -> Column:
    """The first match of a personal-data signal, or null if it is vetoed. Only the first match is looked at."""

    def kept(value: Column) -> Column:
        if s.name == "Credit card number":
            return F.when(luhn_valid(value), value)
        if s.name == "IPv4 address":
            context = F.right(before_first(text, s.pattern, s.fold), F.lit(12))
            return F.when(~matches(value, S.RESERVED_IP) & ~matches(context, S.VERSION_BEFORE, True), value)
        if s.name == "Phone number":
            return F.when(~value.rlike("^[0-9]+\\z"), value)
        return value

    return R.let(F.regexp_substr(text, F.lit(java(s.pattern, s.fold))), kept)


def _pii(text: Column, low: Column, held: Column | None = None) -> Column:
    parts = [
        F.when(_hit(text, low, s, held), F.when(personal_value(text, s).isNotNull(), _placed(F.lit(f"Personal data: {s.name}"), s.severity, "pii", before_first(text, s.pattern, s.fold))))
        for s in S.PERSONAL
    ]
    return FN.gather(parts)


def setting_pattern(marker: str) -> str:
    """A marker where it is switched on: as a flag, as a key, or as the value after one delimiter."""
    word = re.escape(marker).replace("\\ ", " ")
    return f"(?<!\\w)(?:(?<=(?:^|\\s)--?[\\w-]{{0,20}}){word}(?!\\w)|{word}(?!\\w)(?=[\"'`\\]]?\\s{{0,10}}[:=])|(?<=[:=]\\s{{0,8}}[\"'`\\[]?\\s{{0,8}}){word}(?!\\w))"


def _config(text: Column, low: Column, held: Column | None = None) -> Column:
    out = None
    for m in S.SETTINGS:
        p = "(?i)" + setting_pattern(m)
        value = _placed(F.lit(f'Risky setting: "{m}"'), "MEDIUM", "config", F.split(text, p, 2)[0])
        hit = F.contains(low, F.lit(m)) & text.rlike(p)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return FN.gather([F.when(_may(held, "settings"), out)])


def host_pattern(host: str) -> str:
    return r"(^|[^a-z0-9-])" + host.replace(".", r"\.") + r"($|[^a-z0-9.-])"


def egress_host(text: Column) -> Column:
    """The first listed sink host that the text names, or null."""
    return R.let(F.lower(text), _host_in)


def _host_in(low: Column) -> Column:
    out = None
    for h in S.HOSTS:
        hit = F.contains(low, F.lit(h)) & matches(low, host_pattern(h))
        out = F.when(hit, F.lit(h)) if out is None else out.when(hit, F.lit(h))
    return out


def _egress(text: Column, low: Column, held: Column | None = None) -> Column:
    def found(host: Column) -> Column:
        prefix = F.left(text, F.instr(low, host) - 1)
        return FN.gather([F.when(host.isNotNull(), _placed(F.concat(F.lit("Exfiltration sink host: "), host), "HIGH", "egress", prefix))])

    return R.let(F.when(_may(held, "hosts"), _host_in(low)), found)


_DETECTORS = {"shell": _shell, "injection": _injection, "secret": _secret, "pii": _pii, "config": _config, "egress": _egress}


def scan(text: Column, categories: tuple[str, ...] = DEFAULT, held: Column | None = None) -> Column:
    """The findings of a text, in the order of the catalogue (null: none). held
    is may_hold of the text, which saves most of the work."""

    def of(pair: Column) -> Column:
        return F.concat(*[_DETECTORS[c](pair["text"], pair["low"], held) for c in CATEGORIES if c in categories])

    text = F.coalesce(text, F.lit(""))
    found = R.let(F.struct(text.alias("text"), F.lower(text).alias("low")), of)
    return found if held is None else F.when(held == 0, FN.none()).otherwise(found)


def scan_documents(docs: DataFrame, categories: tuple[str, ...] = DEFAULT, text: str = "text", masked: bool = True) -> DataFrame:
    """docs with findings; with masked, each has mark: 0 live, 1 quoted, 2
    concealed. The mask is computed only for texts that have a finding."""
    out = docs.withColumn("__held", may_hold(text)).withColumn("findings", scan(F.col(text), categories, F.col("__held"))).drop("__held")
    if not masked:
        return out
    out = out.withColumn("__mask", mask_of(F.when(F.size("findings") > 0, F.coalesce(text, F.lit("")))))
    marked = F.transform("findings", lambda x: x.withField("mark", F.when(x["offset"].isNull(), 0).otherwise(mark_at(F.col("__mask"), x["offset"]))))
    return out.withColumn("findings", marked).drop("__mask")
