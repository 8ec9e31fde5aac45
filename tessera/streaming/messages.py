"""Answers as streams: tokens assembled in state, and clients that come back.

``assemble_stream`` keeps the tokens of each message in list state until it ends.
A message that stalls is given out as it is when its timer expires; what comes
after a message has ended is told apart for as long as the state remembers it.

``serve`` runs a stream under a name: its checkpoint and its output have that name,
a batch writes its own folder and replaces it when it is run again, so after a
stop anywhere each event is there once. ``events_after`` gives a client what it
has not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.session import share_code
from tessera.streaming.events import session_settings

#: State with timers and lists needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Types of the events of a message.
START, TEXT_START, DELTA, TEXT_END, FINISH, ERROR = "start", "text-start", "text-delta", "text-end", "finish", "error"
ENDS = {FINISH: "finished", ERROR: "failed"}

ASSEMBLED = "message_id string, status string, full_text string, n_deltas long"


def assembled(parts: list[tuple[int, str]]) -> str:
    """Non-empty deltas in order of their numbers."""
    return "".join(text for _, text in sorted(parts))


class Assembler(StatefulProcessor):
    """Tokens of one message: rows (message_id, seq, type, delta) in any order within a batch.

    Gives one row when the message ends: ``finished`` or ``failed`` with its whole
    text. Without an event for ``stall_ms`` it gives ``stalled`` with the text so far, and
    keeps the tokens: if the message goes on it still ends with its whole text. A delta
    after the end gives ``late`` with that delta alone, while the end is remembered (``forget_ms``).
    """

    def __init__(self, stall_ms: int, forget_ms: int) -> None:
        self.stall_ms, self.forget_ms = stall_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", StructType([StructField("seq", LongType()), StructField("delta", StringType())]))
        self.ended = handle.getValueState("ended", StructType([StructField("status", StringType())]), self.forget_ms)

    def _rows(self, key: tuple, status: str, parts: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"message_id": [key[0]], "status": [status], "full_text": [assembled(parts)], "n_deltas": [len(parts)]})

    def _held(self) -> list[tuple[int, str]]:
        return [(int(p[0]), p[1]) for p in self.parts.get()]

    def _stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names are Spark's
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        deltas = [(int(s), d) for s, kind, d in zip(events["seq"], events["type"], events["delta"], strict=True) if kind == DELTA and d]
        if self.ended.exists():
            if deltas:
                yield self._rows(key, "late", deltas)
            return
        for part in deltas:
            self.parts.appendValue(part)
        ends = [kind for kind in events["type"] if kind in ENDS]
        self._stop_timers()
        if ends:
            yield self._rows(key, ENDS[ends[0]], self._held())
            self.parts.clear()
            self.ended.update((ends[0],))
        else:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.ended.exists():
            yield self._rows(key, "stalled", self._held())

    def close(self) -> None:
        pass


def assembling(idle: bool = False) -> dict[str, str]:
    """Settings that a query over ``assemble_stream`` needs at its start.

    Timers are looked at in each batch. With ``idle`` there are batches without events, so a
    stalled message is told when nothing else comes either; a query over what is there now
    would never end then.
    """
    return {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}


def assemble_stream(events: DataFrame, stall_ms: int = 30_000, forget_ms: int = 3_600_000) -> DataFrame:
    """``events (message_id, seq, type, delta)``, a stream, as (message_id, status, full_text, n_deltas); see ``Assembler`` and ``assembling``."""
    share_code(events.sparkSession)
    narrow = events.select(F.col("message_id").cast("string").alias("message_id"), F.col("seq").cast("long").alias("seq"), "type", "delta")
    return narrow.groupBy("message_id").transformWithStateInPandas(Assembler(stall_ms, forget_ms), outputStructType=ASSEMBLED, outputMode="append", timeMode="processingTime")


def message_events(tokens: DataFrame) -> DataFrame:
    """``tokens (message_id, seq, delta)`` of answers as the events a client gets: start, text-start, one text-delta for each non-empty token, text-end, finish.

    Adds the numbers of the frame around the tokens: seq is 2 + seq of the token, counted from 0.
    """
    some = tokens.filter(F.coalesce("delta", F.lit("")) != "")
    last = tokens.groupBy("message_id").agg(F.max("seq").alias("last"))
    none = F.lit(None).cast("string")
    frame = last.select("message_id", F.inline(F.array(*[F.struct((F.lit(at) if at < 2 else F.col("last") + 1 + at).cast("long").alias("seq"), F.lit(kind).alias("type")) for at, kind in ((0, START), (1, TEXT_START), (2, TEXT_END), (3, FINISH))])), none.alias("delta"))
    return some.select("message_id", (F.col("seq") + 2).cast("long").alias("seq"), F.lit(DELTA).alias("type"), "delta").unionByName(frame)


def serve(stream: DataFrame, base: str, name: str, mode: str = "append", after_batch: Callable[[int], None] | None = None, settings: dict[str, str] | None = None, **trigger) -> StreamingQuery:
    """Start ``stream``, or go on where the query of this name was stopped; output is ``served(spark, base, name)``.

    ``base`` is a folder that all executors share. ``after_batch`` is called with the number of a batch
    once it is written; ``settings`` hold for this query alone. The default trigger takes what is there and stops.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{name}/events/batch={number}")
        if after_batch:
            after_batch(number)

    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/{name}/checkpoint")
    with session_settings(stream.sparkSession, settings or {}):
        return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()


def served(spark: SparkSession, base: str, name: str, schema: StructType) -> DataFrame:
    """All events that the query has written, with the number of their batch."""
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.fieldNames() else schema).parquet(f"{base}/{name}/events")


def events_after(events: DataFrame, seen: DataFrame, by: str = "message_id", order: str = "seq") -> DataFrame:
    """Rows of ``events`` that clients have not seen: ``seen`` has one row (by, order) a client's stream, the last that reached it; a stream without one is new."""
    last = seen.select(by, F.col(order).alias("__seen"))
    return events.join(last, by, "left").filter(F.col("__seen").isNull() | (F.col(order) > F.col("__seen"))).drop("__seen")
