"""Traffic between an assistant and its tool servers: replies, listings, results, calls, connections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import sum_before
from ..operators import findings as FN
from ..operators.scan import scan, scan_documents

# Methods whose answers are lists of entries, and methods whose answers are read by the model.
LISTINGS = ["tools/list", "resources/list", "resources/templates/list", "prompts/list"]
RESULTS = ["resources/read", "prompts/get", "completion/complete"]
COOLDOWN_SECONDS = 30.0


def match_replies(frames: DataFrame, session: str = "session", seq: str = "seq", frame_id: str = "id", method: str = "method", result: str = "has_result") -> DataFrame:
    """(session, id, seq, request_seq, method) of each answer to a request for a
    listing or a result. A frame with a method is a request, one without an
    answer. The latest request with its id is answered, and once only; an answer
    without a result answers nothing. Frames with a null id are notifications
    and are left out. Each id is a group of its own, so a session with many
    requests is spread over tasks."""
    asks, answers = F.col("method").isin(*LISTINGS, *RESULTS), F.col("method").isNull() & F.col("result")
    rows = frames.select(F.col(session).alias("session"), F.col(frame_id).alias("id"), F.col(seq).alias("seq"), F.col(method).alias("method"), F.col(result).alias("result"))
    rows = rows.where(F.col("id").isNotNull() & (asks | answers))
    w = W.partitionBy("session", "id").orderBy("seq")
    before = rows.withColumns({"asked": F.lag("method").over(w), "request_seq": F.lag("seq").over(w)})
    return before.where("method is null and asked is not null").select("session", "id", "seq", "request_seq", F.col("asked").alias("method"))


def screen_listing(entries: DataFrame, denied: DataFrame, session: str = "session", name: str = "name", method: str = "method", text: str = "text") -> DataFrame:
    """entries with outcome: denied (a tool that the table denied (session,
    name) names), withheld (its text holds a HIGH or CRITICAL injection,
    credential or sink host) or kept. A denied tool isn't counted as a poisoned
    one. Empty and null texts are kept; a null name is never denied."""
    refused = denied.select(F.col(session).alias("__s"), F.col(name).alias("__n")).distinct().withColumn("__denied", F.lit(True))
    on = (entries[session] == F.col("__s")) & (entries[name] == F.col("__n")) & (entries[method] == "tools/list")
    found = scan(F.col(text), ("injection", "secret", "egress"))
    bad = F.exists(found, lambda x: x["severity"].isin("HIGH", "CRITICAL"))
    outcome = F.when(F.col("__denied"), "denied").when(bad, "withheld").otherwise("kept")
    return entries.join(refused, on, "left").withColumn("outcome", outcome).drop("__s", "__n", "__denied")


def screen_results(results: DataFrame, text: str = "text") -> DataFrame:
    """results with blocked and label: a result is withheld for a CRITICAL
    finding or any injection that isn't quoted; the label is that of the first
    such CRITICAL finding, else injection."""
    live = F.filter("findings", lambda x: x["mark"] != 1)
    worst = F.get(F.filter(live, lambda x: x["severity"] == "CRITICAL"), F.lit(0))["label"]
    injected = F.get(F.filter(live, lambda x: x["category"] == "injection"), F.lit(0))["label"]
    out = scan_documents(results, text=text).withColumn("label", F.coalesce(worst, injected))
    return out.withColumn("blocked", F.col("label").isNotNull()).drop("findings")


def screen_calls(calls: DataFrame, arguments: str = "arguments") -> DataFrame:
    """calls with findings of their serialised arguments and refused: only a
    CRITICAL one refuses a call, quoted or not."""
    found = scan(F.col(arguments), ("shell", "injection", "secret"))
    out = calls.withColumn("findings", found)
    return out.withColumn("refused", FN.grade(F.col("findings"))["verdict"] == "BLOCK")


def connect_decision(decision: Column, reachable: Column, configured: Column, skipped: Column, strict: Column) -> Column:
    """(action, verified) of a connection, decided before its server starts.
    Failures let it start unverified, or refuse it where the policy is strict;
    a strict policy never skips the question. A flagged server starts with a warning."""
    asked = configured & ~skipped
    action = (
        F.when(strict & ~configured, "refuse").when(asked & ~reachable & strict, "refuse").when(asked & reachable & (decision == "BLOCK"), "refuse")
        .when(asked & reachable & (decision == "FLAG"), "warn").otherwise("connect")
    )
    return F.struct(action.alias("action"), (asked & reachable).alias("verified"))


def _sessions(rows: DataFrame, micros: int) -> DataFrame:
    """rows (server, at, seq, ...) with session: how many pauses of so many
    microseconds or more lie before or at a row of its server. Times are cut
    into spans, so no window holds all rows of one server."""
    span = max(64 * micros, 3_600_000_000)
    rows = rows.withColumn("__cut", F.floor(F.col("at") / span))
    last = rows.groupBy("server", "__cut").agg(F.max("at").alias("__last"))
    before = F.max("__last").over(W.partitionBy("server").orderBy("__cut").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(last.select("server", "__cut", before.alias("__before")), ["server", "__cut"])
    earlier = F.coalesce(F.lag("at").over(W.partitionBy("server", "__cut").orderBy("at", "seq")), "__before")
    rows = rows.withColumn("__pause", F.coalesce(F.col("at") - earlier >= micros, F.lit(True)).cast("int")).drop("__cut", "__before")
    counted = sum_before(rows, ["server"], F.col("at"), ["at", "seq"], "__pause", "__n", span)
    return counted.withColumn("session", F.col("__n") + F.col("__pause")).drop("__n", "__pause")


def break_circuit(attempts: DataFrame, server: str, ts: str, seq: str, reachable: str, cooldown: float = COOLDOWN_SECONDS) -> DataFrame:
    """(server, ts, seq, reachable, skipped): an attempt is skipped for cooldown
    seconds after a failure of one that was made. After a pause of that length
    nothing is left of what was before, so a server's attempts are cut there,
    and each session passes in order, a batch at a time, with one time as the
    state. Rows without a time or a server are left out; an unknown
    reachability is a failure."""
    rows = attempts.select(F.col(server).alias("server"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.coalesce(reachable, F.lit(False)).alias("reachable"))
    schema = rows.withColumn("skipped", F.lit(False)).schema
    rows = rows.where("server is not null and ts is not null").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    micros = int(cooldown * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, until = None, 0
        for batch in batches:
            skipped = []
            for name, session, at, ok in zip(batch["server"], batch["session"], batch["at"].tolist(), batch["reachable"]):
                if (name, session) != current:
                    current, until = (name, session), at
                skip = at < until
                if not skip and not ok:
                    until = at + micros
                skipped.append(skip)
            yield batch[["server", "ts", "seq", "reachable"]].assign(skipped=skipped)

    return _sessions(rows, micros).repartition("server", "session").sortWithinPartitions("server", "session", "at", "seq").mapInPandas(run, schema)


def channel_decision(channel: Column, verdict: Column) -> Column:
    """What becomes of a text by its channel: a plan is only commented on, a
    prompt is passed with a note unless it holds a credential, calls and
    results are stopped where they are bad."""
    return (
        F.when(channel == "plan", F.when(verdict == "ALLOW", "pass").otherwise("inform"))
        .when(channel == "prompt", F.when(verdict == "BLOCK", "refuse").when(verdict == "FLAG", "annotate").otherwise("pass"))
        .when(verdict == "BLOCK", "refuse").when(verdict == "FLAG", "ask").otherwise("pass")
    )
