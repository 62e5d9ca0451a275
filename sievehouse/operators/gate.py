"""The gate: one verdict for an artifact by its kind, path and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import entries, frontmatter
from ..functions.regexes import before_first, java, let, matches
from ..plans import prose as P
from ..plans import signals as S
from . import findings as FN
from . import memory as M
from . import scan as SC
from . import urls as U

_SERVER = "map<string,struct<command:string,args:array<string>,url:string,env:map<string,string>>>"
SERVERS = f"mcpServers {_SERVER}, servers {_SERVER}, context_servers {_SERVER}, mcp struct<servers:{_SERVER}>"
CARD = "url string, endpoints array<string>, endpoint string, securitySchemes string, authentication string, security string, auth string, skills array<struct<url:string>>"
# Runners of packages, and words of theirs that are no package.
RUNNERS = ["npx", "npm", "pnpm", "yarn", "bunx", "bun"]
SKIPPED = ["exec", "dlx", "run", "install", "add", "create", "-y", "--yes"]


# The fields that grant tools, in the order read.
GRANTS = ["allowed-tools", "tools", "allowedTools"]


def tool_grants(text: Column) -> Column:
    """Tools that a frontmatter grants, from inline values and lists."""
    return let(frontmatter(text), lambda data: F.concat(*[entries(data, k) for k in GRANTS]))


def grant_findings(text: Column) -> Column:
    grants = tool_grants(text)
    wild = F.exists(grants, lambda t: F.regexp_replace(F.lower(t), "^[\"']|[\"']\\z", "").isin("*", "all", "any"))
    high = F.filter(F.transform(grants, lambda t: F.lower(F.trim(F.split(t, "[(:\\s]", 2)[0]))), lambda t: t.isin(*P.HIGH_IMPACT_TOOLS))
    broad = F.concat(F.lit("Broad tool grant ("), F.size(high), F.lit(" high-impact tools: "), F.array_join(F.slice(F.array_distinct(high), 1, 5), ", "), F.lit(")"))
    return FN.gather([
        F.when(wild, FN.finding(F.lit("Wildcard tool grant (grants every capability)"), "HIGH", "grant", None))
        .when(F.size(high) >= 3, FN.finding(broad, "MEDIUM", "grant", None))
    ])


def launched_package(command: Column, args: Column) -> Column:
    """The package that a package runner is asked to run; its scope stays, its version goes."""
    runner = F.substring_index(F.coalesce(command, F.lit("")), "/", -1).isin(*RUNNERS)
    name = F.get(F.filter(F.coalesce(args, F.array().cast("array<string>")), lambda a: ~a.startswith("-") & ~a.isin(*SKIPPED)), F.lit(0))
    scoped = F.substring_index(name, "/", 2)
    return F.when(runner, F.regexp_replace(F.when(name.startswith("@"), scoped).otherwise(F.split(name, "@", 2)[0]), "@[0-9^~].*\\z", ""))


def server_findings(text: Column) -> Column:
    """Plain HTTP, fixed credentials, and bad or look-alike packages of the servers that a configuration declares."""
    j = F.from_json(text, SERVERS)
    servers = F.coalesce(j["mcpServers"], j["servers"], j["mcp"]["servers"], j["context_servers"])

    def of(e: Column) -> Column:
        name, v = e["key"], e["value"]
        line = F.concat_ws(" ", v["command"], F.array_join(v["args"], " "))
        blob = F.concat_ws("\n", line, F.to_json(v["env"]))
        secret = F.lit(False)
        for s in S.SECRETS:
            secret = secret | matches(blob, s.pattern, s.fold)
        package = launched_package(v["command"], v["args"])
        squat = F.get(F.filter(F.array(*map(F.lit, P.POPULAR_PACKAGES)), lambda p: F.levenshtein(package, p) == 1), F.lit(0))
        said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        bad = package.isin(*P.MALICIOUS_PACKAGES)
        return F.array_compact(F.array(
            F.when(v["url"].startswith("http://"), FN.finding(said('MCP server "', name, '" uses plaintext HTTP'), "MEDIUM", "mcp", None)),
            F.when(secret, FN.finding(said('Static credential in MCP server "', name, '"'), "CRITICAL", "mcp", None)),
            F.when(bad, FN.finding(said('MCP server "', name, '" runs a known-malicious package (', package, ")"), "CRITICAL", "mcp", None))
            .when(squat.isNotNull(), FN.finding(said('Possible typosquat in "', name, '": ', package, ' (looks like "', squat, '")'), "MEDIUM", "mcp", None)),
        ))

    return F.coalesce(F.flatten(F.transform(F.map_entries(servers), of)), FN.none())


def card_findings(text: Column) -> Column:
    """Addresses of a card by class, the first of each, and a card without authentication."""
    j = F.from_json(text, CARD)
    found = F.array_compact(F.concat(F.array(j["url"], j["endpoint"]), F.coalesce(j["endpoints"], F.array().cast("array<string>")), F.coalesce(F.transform(j["skills"], lambda s: s["url"]), F.array().cast("array<string>"))))
    web = F.filter(F.array_distinct(found), lambda u: U.host_of(u).isNotNull())
    private = lambda u: matches(U.host_of(u), U.PRIVATE, True)
    metadata = lambda u: U.host_of(u).isin(*U.METADATA)
    classes = [
        ("CRITICAL", "Agent card targets the cloud metadata endpoint", metadata),
        ("MEDIUM", "Agent card declares a private-network endpoint", lambda u: private(u) & ~metadata(u)),
        ("HIGH", "Agent card points at an exfiltration-style endpoint", lambda u: F.coalesce(F.exists(F.array(*map(F.lit, S.HOSTS)), lambda h: (U.host_of(u) == h) | U.host_of(u).endswith(F.concat(F.lit("."), h))), F.lit(False))),
        ("MEDIUM", "Agent card uses plaintext HTTP", lambda u: F.lower(u).startswith("http://") & ~private(u)),
        ("LOW", "Agent card addresses its endpoint by raw IP", lambda u: matches(U.host_of(u), U.RAW_IP) & ~private(u)),
    ]
    out = []
    for severity, title, test in classes:
        first = F.get(F.filter(web, test), F.lit(0))
        out.append(F.when(first.isNotNull(), FN.finding(F.concat(F.lit(title + " ("), first, F.lit(")")), severity, "card", None)))
    auth = F.coalesce(j["securitySchemes"], j["authentication"], j["security"], j["auth"])
    out.append(F.when(j["url"].isNotNull() & auth.isNull(), FN.finding(F.lit("Agent card declares no authentication scheme"), "MEDIUM", "card", None)))
    return FN.gather(out)


def command_findings(text: Column) -> Column:
    """Shell lines and sensitive attachments of a slash command."""
    bangs = F.size(F.regexp_extract_all(text, F.lit("(?m)^!\\s*`?([^`\\n]+)`?"), F.lit(0)))
    refs = F.regexp_extract_all(text, F.lit("(?:^|\\s)@([~./][^\\s`]+)"), F.lit(1))
    bad = F.get(F.filter(refs, lambda r: r.rlike("(?i)(\\.env|\\.ssh|id_rsa|secret|credential|\\.pem|\\.key)")), F.lit(0))
    return FN.gather([
        F.when(bangs > 0, FN.finding(F.concat(F.lit("Command runs "), bangs, F.lit(" shell command(s) before the prompt")), "LOW", "command", None)),
        F.when(bad.isNotNull(), FN.finding(F.concat(F.lit("Command attaches a sensitive file (@"), bad, F.lit(")")), "MEDIUM", "command", None)),
    ])


def lure_finding(text: Column) -> Column:
    first = None
    for s in S.LURES:
        value = FN.finding(F.lit(s.name), s.severity, "lure", before_first(text, s.pattern, s.fold))
        hit = matches(text, s.pattern, s.fold)
        first = F.when(hit, value) if first is None else first.when(hit, value)
    return FN.gather([first])


def gate(artifacts: DataFrame, kind: str = "kind", path: str = "path", text: str = "text") -> DataFrame:
    """artifacts with findings, verdict and risk_score.

    Memory and rules files are graded as standing instructions, everything
    else by the flat scan; then come lures, tool grants and the checks of the
    kind. A title counts once. Null kinds count as auto, null texts as empty.
    The two branches are separate plans over the same rows.
    """
    k = F.coalesce(F.col(kind), F.lit("auto"))
    x = F.coalesce(F.col(text), F.lit(""))
    rows = artifacts.withColumn("__governed", M.governed_kind(k, F.col(path)))
    governed = rows.where("__governed is not null")
    governed = governed.withColumn("findings", F.concat(M.standing_instructions(x, F.col("__governed") == "INSTRUCTION"), SC.scan(x, ("config",))))
    infrastructure = k.isin("mcp", "agent-card")
    flat = rows.where("__governed is null").withColumn("findings", SC.scan(x, SC.CATEGORIES))
    flat = flat.withColumn("findings", F.filter("findings", lambda f: ~(infrastructure & (f["label"] == "Personal data: IPv4 address"))))

    def extra(df: DataFrame) -> DataFrame:
        when = lambda kinds, found: F.when(k.isin(*kinds), found).otherwise(FN.none())
        return df.withColumn(
            "findings",
            F.concat(
                "findings", lure_finding(x), when(("skill", "command", "subagent", "auto"), grant_findings(x)), when(("mcp", "auto"), server_findings(x)),
                when(("agent-card", "auto"), card_findings(x)), when(("command", "auto"), command_findings(x)),
            ),
        )

    both = extra(governed).unionByName(extra(flat)).drop("__governed")
    both = both.withColumn("findings", FN.keep_first(F.col("findings"), lambda f: f["label"]))
    return both.withColumn("__grade", FN.grade(F.col("findings"))).withColumns({"verdict": F.col("__grade.verdict"), "risk_score": F.col("__grade.risk_score")}).drop("__grade")
