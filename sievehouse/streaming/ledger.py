"""Screening gaps: windows in which calls ran without a verdict of the server."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE_SECONDS, MOST_GAPS = 6 * 3600, 50
SPAN_SECONDS = 3600


def _islands(rows: DataFrame, machine: str, ts: str, order: str, span: int) -> DataFrame:
    """rows with island: how many closes (c) of their machine come before them.
    A machine's rows are cut into spans of time, so no window holds all of one
    machine: closes before a span come from a table with a row a span, and only
    those within it are counted in order. Rows without a time come first."""
    since = F.col(ts) - F.lit("1970-01-01").cast("timestamp_ntz")
    wall = F.extract(F.lit("DAY"), since) * 86_400 + F.extract(F.lit("HOUR"), since) * 3_600 + F.extract(F.lit("MINUTE"), since) * 60
    # A time without a zone must not go through the session's, where clocks are set back.
    seconds = wall if isinstance(rows.schema[ts].dataType, T.TimestampNTZType) else F.unix_micros(ts) / 1_000_000
    block = F.coalesce(F.floor(seconds / span), F.lit(-(2**62)))
    rows = rows.withColumn("__block", block).withColumn("__machine", F.struct(F.col(machine)))
    spans = rows.groupBy("__machine", "__block").agg(F.sum("c").alias("__n"))
    earlier = F.sum("__n").over(W.partitionBy("__machine").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select("__machine", "__block", F.coalesce(earlier, F.lit(0)).alias("__before"))
    inside = W.partitionBy("__machine", "__block").orderBy(ts, order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(spans, ["__machine", "__block"]).withColumn("island", F.col("__before") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    return out.drop("__machine", "__block", "__before")


def gap_windows(events: DataFrame, machine: str, ts: str, order: str, unscreened: Column, local: Column, closes: Column, span: int = SPAN_SECONDS) -> DataFrame:
    """(machine, island, opened_at, closed_at, unscreened_calls,
    locally_decided_calls, state). The first call after a close opens a window,
    the next close ends it; windows without a call are dropped, one not yet
    closed is open, and one older than six hours has no known end. Conditions
    that are null don't hold; rows without a machine are those of one. span, in
    seconds, changes no result: it bounds what is sorted together."""
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    rows = events.select(machine, ts, order, flag(unscreened).alias("u"), flag(local).alias("l"), flag(closes).alias("c"))
    rows = _islands(rows, machine, ts, order, span)
    call = (F.col("u") == 1) | (F.col("l") == 1)
    rolled = rows.groupBy(machine, "island").agg(
        F.min(F.when(call, F.col(ts))).alias("opened_at"), F.max(F.when(F.col("c") == 1, F.col(ts))).alias("end"), F.sum("u").alias("unscreened_calls"), F.sum("l").alias("locally_decided_calls")
    )
    fresh = F.col("end") - F.col("opened_at") <= F.expr(f"INTERVAL {STALE_SECONDS} SECONDS")
    return rolled.where("unscreened_calls + locally_decided_calls > 0").select(
        machine, "island", "opened_at", F.when(fresh, F.col("end")).alias("closed_at"), "unscreened_calls", "locally_decided_calls",
        F.when(F.col("end").isNull(), "open").when(fresh, "closed").otherwise("end not observed").alias("state"),
    )


def compact(gaps: DataFrame, machine: str, most: int = MOST_GAPS) -> DataFrame:
    """At most `most` gaps a machine: the oldest beyond that are merged into
    one, whose end is known only if all theirs are. Gaps are ordered by opening
    time, then island; bucket counts them from the newest, which is 1. Only the
    newest are ranked, which Spark limits before it moves rows; the merged ones
    are summed before they are moved."""
    newest = F.row_number().over(W.partitionBy(machine).orderBy(F.desc("opened_at"), F.desc("island")))
    at = F.struct("opened_at", "island")
    cut = gaps.withColumn("__nth", newest).where(F.col("__nth") <= most)
    cut = cut.select(F.struct(F.col(machine)).alias("__machine"), F.col("__nth"), at.alias("__at"))
    # The first of what is merged: the gap before which most - 1 newer ones stand alone.
    oldest = cut.where(F.col("__nth") == most).select("__machine", F.col("__at").alias("__last"))
    marked = gaps.withColumn("__machine", F.struct(F.col(machine))).withColumn("__at", at).join(oldest, "__machine", "left")
    own = marked.where(F.col("__last").isNull() | (F.col("__at") > F.col("__last"))).join(cut.select("__machine", "__at", "__nth"), ["__machine", "__at"])
    merged = marked.where(F.col("__at") <= F.col("__last")).withColumn("__nth", F.lit(most))
    return own.select(*gaps.columns, "__nth").unionByName(merged.select(*gaps.columns, "__nth")).groupBy(machine, F.col("__nth").alias("bucket")).agg(
        F.min("opened_at").alias("opened_at"), F.when(F.count("closed_at") == F.count("*"), F.max("closed_at")).alias("closed_at"),
        F.sum("unscreened_calls").alias("unscreened_calls"), F.sum("locally_decided_calls").alias("locally_decided_calls"), F.count("*").alias("windows"),
    )


def acknowledge(pending: DataFrame, sent: DataFrame, machine: str) -> DataFrame:
    """pending without what was sent, by machine and opening time."""
    return pending.join(sent.select(machine, "opened_at"), [machine, "opened_at"], "left_anti")


STATE = "opened_at timestamp, unscreened bigint, local bigint, island bigint"
OUTPUT = "machine bigint, island bigint, opened_at timestamp, closed_at timestamp, unscreened_calls bigint, locally_decided_calls bigint, state string"


def stream_gaps(events: DataFrame) -> DataFrame:
    """The same windows from a stream of (machine, ts, seq, kind), kind being
    unscreened, local or close: each window is sent out when it ends. State is
    one open window a machine. Rows of a trigger are taken by ts, then seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, unscreened, local, island = state.get if state.exists else (None, 0, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
            if r.kind in ("unscreened", "local"):
                opened = r.ts if opened is None else opened
                unscreened, local = unscreened + (r.kind == "unscreened"), local + (r.kind == "local")
            elif r.kind == "close":
                if opened is not None:
                    fresh = (r.ts - opened).total_seconds() <= STALE_SECONDS
                    out.append((key[0], island, opened, r.ts if fresh else None, unscreened, local, "closed" if fresh else "end not observed"))
                opened, unscreened, local, island = None, 0, 0, island + 1
        state.update((opened, unscreened, local, island))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"opened_at": "datetime64[ns]", "closed_at": "datetime64[ns]"})

    return events.groupBy("machine").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


class _TimedWindows(StatefulProcessor):
    """The windows of one machine over a stream with a watermark: one open
    window as state, and a timer at the time from which its end can't be known any more."""

    def __init__(self, stale_millis: int):
        self.stale = stale_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened_at timestamp, unscreened bigint, local bigint, island bigint")

    @staticmethod
    def _millis(at) -> int:
        return int(pd.Timestamp(at).value // 1_000_000)

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"opened_at": "datetime64[ns]", "closed_at": "datetime64[ns]"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, unscreened, local, island = self.window.get() if self.window.exists() else (None, 0, 0, 0)
        known, out = opened, []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            if r.kind in ("unscreened", "local"):
                opened = r.ts if opened is None else opened
                unscreened, local = unscreened + (r.kind == "unscreened"), local + (r.kind == "local")
            elif r.kind == "close":
                if opened is not None:
                    fresh = (r.ts - pd.Timestamp(opened)).total_seconds() * 1000 <= self.stale
                    out.append((key[0], island, opened, r.ts if fresh else None, unscreened, local, "closed" if fresh else "end not observed"))
                opened, unscreened, local, island = None, 0, 0, island + 1
        if known is not None and known != opened:
            self.handle.deleteTimer(self._millis(known) + self.stale + 1)
        if opened is not None and opened != known:
            self.handle.registerTimer(self._millis(opened) + self.stale + 1)
        self.window.update((opened, int(unscreened), int(local), int(island)))
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, unscreened, local, island = self.window.get()
        yield self._out([] if opened is None else [(key[0], island, opened, None, unscreened, local, "open")])

    def close(self) -> None:
        pass


def stream_windows(events: DataFrame, delay: str = "10 minutes", stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """gap_windows over a stream of (machine, ts, seq, kind), as stream_gaps,
    but a window that nothing closes is sent too, as open, once the watermark
    (delay behind the newest event) has passed the time from which its end
    can't be known. Its close sends it again with all its calls, under the same
    machine and opening time. Events later than the watermark are left out. The
    session must use RocksDB's state store."""
    timed = events.withWatermark("ts", delay)
    return timed.groupBy("machine").transformWithStateInPandas(
        statefulProcessor=_TimedWindows(stale_seconds * 1000), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def commit_gaps(folder: str):
    """A sink for foreachBatch: each batch is one subfolder, written anew if the
    batch comes again, so a replay changes nothing."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return commit


def committed_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps that were committed, each machine and opening time once: as it ended, else as it was sent while open."""
    rows = spark.read.schema(OUTPUT).option("basePath", folder).parquet(f"{folder}/batch=*")
    ended = (F.col("state") != "open").cast("int")
    best = rows.groupBy("machine", "opened_at").agg(F.max(F.struct(ended.alias("ended"), "unscreened_calls", "locally_decided_calls", "closed_at", "state", "island")).alias("g"))
    return best.select("machine", "g.island", "opened_at", "g.closed_at", "g.unscreened_calls", "g.locally_decided_calls", "g.state")


MOST_VERSION = 40


def _instant(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def envelopes(machines: DataFrame, gaps: DataFrame, machine: str, version: str | None = None, reason: str = "breaker-open", most: int = MOST_GAPS) -> DataFrame:
    """(machine, n_gaps, envelope): what each machine sends, as JSON: always a
    list gaps, of the oldest `most` by opening time, then the client's version.

    gaps is what compact returns, `windows` telling how many each stands for. A
    gap without a known end has no closed_at, and says so in its reason; a
    merged one says how many it stands for. Times are in UTC, as the session's
    must be. Machines without a gap send an empty list; a null machine is one."""
    why = F.when(F.col("windows") > 1, F.concat(F.col("windows").cast("string"), F.lit(" earlier windows, merged"))).when(F.col("closed_at").isNull(), f"{reason} (end not observed)").otherwise(reason)
    body = F.to_json(F.struct(_instant(F.col("opened_at")).alias("opened_at"), _instant(F.col("closed_at")).alias("closed_at"), "unscreened_calls", "locally_decided_calls", why.alias("reason")))
    nth = F.row_number().over(W.partitionBy(machine).orderBy("opened_at", "bucket"))
    sent = gaps.withColumn("__nth", nth).where(F.col("__nth") <= most).groupBy(machine).agg(F.sort_array(F.collect_list(F.struct("__nth", body.alias("body")))).alias("__sent"))
    sent = sent.select(F.col(machine).alias("__machine"), F.transform("__sent", lambda x: x["body"]).alias("__sent"))
    listed = F.coalesce(F.array_join("__sent", ","), F.lit(""))
    tail = "}" if not version else ',"client_version":"' + version[:MOST_VERSION].replace("\\", "\\\\").replace('"', '\\"') + '"}'
    joined = machines.select(machine).distinct().join(sent, F.col(machine).eqNullSafe(F.col("__machine")), "left")
    return joined.select(machine, F.greatest(F.size("__sent"), F.lit(0)).cast("long").alias("n_gaps"), F.concat(F.lit('{"gaps":['), listed, F.lit("]" + tail)).alias("envelope"))
