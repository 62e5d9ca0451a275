"""Frames between a client and its server: lines out of chunks, requests that wait for an answer, and what becomes of each frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.json_text import compact, texts_of
from ..functions.spans import sum_before
from ..operators import findings as FN
from ..operators.scan import scan
from .channels import LISTINGS, RESULTS, screen_results

#: Requests of a session that may wait; one more, and all are forgotten.
MOST_PENDING = 1000
#: How long a session's waiting requests are kept without a frame.
KEEP_MILLIS = 24 * 3600 * 1000
CLIENT, SERVER = "client", "server"


def frame_lines(chunks: DataFrame, session: str = "session", direction: str = "direction", seq: str = "seq", chunk: str = "chunk", span: int = 4096) -> DataFrame:
    """(session, direction, seq, line): the lines of each direction's chunks,
    whatever the chunks' bounds; seq is that of the chunk that ends the line.
    Lines are trimmed, empty ones and what no newline has ended are left out.
    Chunks go by seq, null chunks are empty. A chunk's pieces know the number of
    their line from a running sum, so only one line's pieces are gathered."""
    rows = chunks.select(F.col(session).alias("session"), F.col(direction).alias("direction"), F.col(seq).alias("seq"), F.split(F.coalesce(chunk, F.lit("")), "\n", -1).alias("parts"))
    rows = rows.withColumn("n", F.size("parts") - 1)
    placed = sum_before(rows, ["session", "direction"], F.col("seq"), ["seq"], "n", "before", span)
    pieces = placed.select("session", "direction", "seq", "before", F.posexplode("parts").alias("at", "piece"), "n")
    pieces = pieces.select("session", "direction", (F.col("before") + F.col("at")).alias("nth"), "seq", "at", "piece", (F.col("at") < F.col("n")).alias("ends"))
    lines = pieces.groupBy("session", "direction", "nth").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "piece"))).alias("parts"), F.bool_or("ends").alias("ended"))
    line = F.trim(F.array_join(F.transform("parts", lambda p: p["piece"]), ""), F.lit(" \t\r\n\x0b\x0c"))
    return lines.where("ended").select("session", "direction", "nth", F.element_at("parts", -1)["seq"].alias("seq"), line.alias("line")).where("line != ''")


def messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with id (as JSON text, null where a frame has none), method,
    asks (a request whose answer is screened), answers (a frame with an id and a
    result) and result. What is no JSON object is neither."""
    v = F.try_parse_json(F.col(line))
    is_object = F.coalesce(F.col(line).startswith("{") & v.isNotNull(), F.lit(False))
    id_ = F.when(is_object, F.to_json(F.try_variant_get(v, "$.id", "variant")))
    method = F.when(is_object, F.try_variant_get(v, "$.method", "string"))
    result = F.when(is_object, F.get_json_object(F.col(line), "$.result"))
    shown = F.to_json(F.try_variant_get(v, "$.result", "variant"))
    has_result = F.coalesce(shown.isNotNull() & ~shown.isin("null", "false", "0", '""'), F.lit(False))
    quoted = F.when(F.startswith(shown, F.lit('"')), shown).otherwise(result)
    return lines.withColumns({
        "id": id_, "method": method, "asks": F.coalesce(id_.isNotNull() & method.isin(*LISTINGS, *RESULTS), F.lit(False)),
        "answers": is_object & id_.isNotNull() & has_result, "result": F.when(has_result, quoted),
    })


class _Pending:
    """The requests of one session that wait, as a fold over its frames in order."""

    def __init__(self, waiting: dict[str, tuple[str, int]], most: int):
        self.waiting, self.most = waiting, most

    def take(self, direction: str, seq: int, id_: str | None, method: str | None, asks: bool, answers: bool) -> tuple[str, int] | None:
        """(method, seq) of the request that a frame answers; null for all other frames."""
        if direction == CLIENT and asks:
            if len(self.waiting) >= self.most:
                self.waiting.clear()
            self.waiting[id_] = (method, seq)
        elif direction == SERVER and answers:
            return self.waiting.pop(id_, None)
        return None


PAIR = "session {session}, seq bigint, id string, method string, request_seq bigint, result string"
_NAMES = ["session", "seq", "id", "method", "request_seq", "result"]
_IN_ORDER = ["seq", "direction"]


def _rows(frames: DataFrame) -> DataFrame:
    wanted = (F.col("direction") == CLIENT) & F.col("asks") | (F.col("direction") == SERVER) & F.col("answers")
    return frames.where(wanted).select("session", F.col("seq").cast("bigint").alias("seq"), "direction", "id", "method", "asks", "answers", F.when(F.col("direction") == SERVER, F.col("result")).alias("result"))


def _schema(frames: DataFrame) -> str:
    return PAIR.format(session=frames.schema["session"].dataType.simpleString())


def pair_answers(frames: DataFrame, most: int = MOST_PENDING) -> DataFrame:
    """(session, seq, id, method, request_seq, result) of the server's frames
    that answer a request, over messages with session, seq and direction.

    A request waits until it is answered, or until another with its id takes
    its place. When a request comes and `most` wait, all of them are forgotten
    first. A session's frames go by seq, the client's before the server's; a
    task holds its waiting requests and one batch. Answers without a result
    leave their request waiting. Rows without a session are one session."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pending = object(), _Pending({}, most)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                session = None if pd.isna(r.session) else r.session
                if session != now:
                    now, pending = session, _Pending({}, most)
                found = pending.take(r.direction, r.seq, r.id, r.method, r.asks, r.answers)
                if found:
                    out.append((session, r.seq, r.id, *found, r.result))
            yield pd.DataFrame(out, columns=_NAMES)

    rows = _rows(frames)
    return rows.repartition("session").sortWithinPartitions("session", *_IN_ORDER).mapInPandas(run, _schema(frames))


class _Mediator(StatefulProcessor):
    """The same fold over a stream: a session's waiting requests are a map whose entries are forgotten after a time."""

    def __init__(self, most: int, keep: int):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "id string", "method string, request_seq bigint", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        pending, out = _Pending(dict(before), self.most), []
        for r in pd.concat(list(rows)).sort_values(_IN_ORDER).itertuples(index=False):
            found = pending.take(r.direction, r.seq, r.id, r.method, r.asks, r.answers)
            if found:
                out.append((key[0], r.seq, r.id, *found, r.result))
        for k in before.keys() - pending.waiting.keys():
            self.waiting.removeKey((k,))
        for k, v in pending.waiting.items():
            if before.get(k) != v:
                self.waiting.updateValue((k,), (v[0], int(v[1])))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_answers(client: DataFrame, server: DataFrame, most: int = MOST_PENDING, keep_millis: int = KEEP_MILLIS) -> DataFrame:
    """pair_answers over two streams of messages (session, seq and what
    messages adds), one of each direction. State is a map of at most `most`
    requests a session, each dropped keep_millis after it came. A trigger's
    frames of a session go by seq; an answer that comes in an earlier trigger
    than its request isn't paired. The session must use RocksDB's state store
    (STATE_STORE); as times are those of the clock, a query that ends when its
    input does needs spark.sql.streaming.noDataMicroBatches.enabled off."""
    both = client.withColumn("direction", F.lit(CLIENT)).unionByName(server.withColumn("direction", F.lit(SERVER)))
    return _rows(both).groupBy("session").transformWithStateInPandas(
        statefulProcessor=_Mediator(most, keep_millis), outputStructType=_schema(both), outputMode="Append", timeMode="ProcessingTime"
    )


def answer_actions(pairs: DataFrame) -> DataFrame:
    """pairs of methods whose results the model reads, with text (all texts of
    the result), blocked and label: what is blocked is answered by an error
    that names the label alone and never quotes the text."""
    results = pairs.where(F.col("method").isin(*RESULTS)).withColumn("text", texts_of(F.col("result")))
    return screen_results(results)


def call_actions(frames: DataFrame) -> DataFrame:
    """The client's calls of tools (session, seq, id, label, refused): a CRITICAL
    finding of the serialised arguments refuses a call before it is sent on."""
    calls = frames.where((F.col("direction") == CLIENT) & (F.col("method") == "tools/call") & F.col("id").isNotNull())
    arguments = compact(F.get_json_object("line", "$.params.arguments"))
    found = calls.select("session", "seq", "id", scan(arguments, ("shell", "injection", "secret")).alias("findings"))
    critical = F.get(F.filter("findings", lambda x: x["severity"] == "CRITICAL"), F.lit(0))["label"]
    return found.select("session", "seq", "id", critical.alias("label"), (FN.grade(F.col("findings"))["verdict"] == "BLOCK").alias("refused"))


def refusal(id_: Column, label: Column, server: Column) -> Column:
    """The frame that is sent in place of one that was blocked."""
    error = F.struct(F.lit(-32001).alias("code"), F.concat(F.lit("withheld: "), label).alias("message"), F.struct(server.alias("server"), F.lit("content").alias("refusedBy")).alias("data"))
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), id_, F.lit(',"error":'), F.to_json(error), F.lit("}"))
