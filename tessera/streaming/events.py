"""Streams: server-sent events, token assembly, progress, event-time windows.

Each operator takes a batch or a streaming DataFrame alike, except where it says
otherwise. ``run_to_table`` runs a streaming query over what is there now and
gives its result as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import scratch_base

#: Progress of the stages of an answer.
STAGES = {"fetching": 0.1, "processing": 0.25, "chunking": 0.35, "embedding": 0.45, "storing vectors": 0.55, "searching": 0.75, "complete": 1.0}

EVENT_SCHEMA = "type string, id string, messageId string, delta string, finishReason string, error string, status string, message string, step string"


def decode_sse(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Lines of server-sent events: columns of ``chunks`` but the text, plus pos, channel, body, event, malformed.

    A text holds whole lines; ``carry_tails`` makes them whole first. Lines
    without a known prefix are left out; a body that is no JSON object is
    malformed and has a null event.
    """
    keep = [c for c in chunks.columns if c != text]
    lines = chunks.select(*keep, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line"))
    channel = F.regexp_extract("line", "^(source|status|data):", 1)
    known = lines.withColumn("channel", channel).filter("channel <> ''").withColumn("body", F.btrim(F.regexp_replace("line", "^(source|status|data):", ""))).drop("line")
    event = F.from_json("body", EVENT_SCHEMA)
    is_object = F.try_parse_json("body").isNotNull()
    return known.withColumns({"event": F.when(is_object, event), "malformed": ~is_object})


def carry_tails(chunks: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """Batch: network chunks joined for each stream, so events that were cut are whole; what follows the last blank line is the tail."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    whole = chunks.groupBy(by).agg(joined.alias("__all"))
    from_end = F.instr(F.reverse("__all"), "\n\n")
    cut = F.when(from_end == 0, 0).otherwise(F.length("__all") - from_end + 1)
    return whole.select(by, F.substring("__all", F.lit(1), cut).alias(text), F.substring("__all", cut + 1, F.length("__all")).alias("tail"))


def carry_tails_stream(chunks: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """As ``carry_tails`` on a stream: the tail of each stream waits in the state for what completes it.

    ``by`` and ``order`` are long columns; chunks of a stream must arrive in
    order between micro-batches and may come in any order inside one. Emits
    (by, text) whenever whole events are there; the state is one tail a stream.
    """

    def whole(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else ""
        found = pd.concat(list(parts)).sort_values(order)
        joined = tail + "".join(x for x in found[text] if x)
        cut = joined.rfind("\n\n")
        state.update((joined[cut + 2 :] if cut >= 0 else joined,))
        if cut >= 0:
            yield pd.DataFrame({by: [key[0]], text: [joined[: cut + 2]]})

    narrow = chunks.select(F.col(by).cast("long").alias(by), F.col(order).cast("long").alias(order), F.col(text).alias(text))
    return narrow.groupBy(by).applyInPandasWithState(whole, f"{by} long, {text} string", "tail string", "append", GroupStateTimeout.NoTimeout)


def assemble_text(deltas: DataFrame, by: str, order: str, delta: str) -> DataFrame:
    """(by, full_text, n_deltas): non-empty deltas of each message in order. A group is one message's tokens."""
    some = deltas.filter(F.coalesce(delta, F.lit("")) != "")
    parts = F.sort_array(F.collect_list(F.struct(order, delta)))
    return some.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x[delta]), "").alias("full_text"), F.count("*").alias("n_deltas"))


def latest_progress(events: DataFrame, by: str, stage: str) -> DataFrame:
    """(by, stage, progress): the furthest stage of each conversation; unknown stages are ignored."""
    table = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    known = events.withColumn("progress", F.element_at(table, F.col(stage))).filter("progress is not null")
    best = F.max(F.struct("progress", F.col(stage).alias("stage"))).alias("b")
    return known.groupBy(by).agg(best).select(by, "b.stage", "b.progress")


def event_time(events: DataFrame, time: str = "ts", delay: str | None = None) -> DataFrame:
    """``time`` as a timestamp (watermarks need one) with a watermark if a delay is given."""
    typed = events.withColumn(time, F.col(time).cast("timestamp"))
    return typed.withWatermark(time, delay) if delay else typed


def windowed(events: DataFrame, window: Column, *keys: str, value: str = "value") -> DataFrame:
    """(window_start, window_end, keys, n, total) of event-time windows."""
    counted = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def tumbling(events: DataFrame, length: str, *keys: str) -> DataFrame:
    return windowed(events, F.window("ts", length), *keys)


def sliding(events: DataFrame, length: str, step: str, *keys: str) -> DataFrame:
    return windowed(events, F.window("ts", length, step), *keys)


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    return windowed(events, F.session_window("ts", gap), *keys)


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """Stateful dedup within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one in local mode."""
    return f"{scratch_base(spark)}/stream-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream; its schema is the table's."""
    table = spark.read.parquet(path)
    files = spark.readStream.schema(table.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    one_file = table.select("_metadata.file_path").first()
    if one_file and one_file[0].rstrip("/").endswith(f"/{name}"):  # a stream reads folders
        return files.option("pathGlobFilter", name).parquet(folder)
    return files.parquet(path)


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` while a query starts, which takes them with it; then those before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_table(stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Run a streaming DataFrame over the input that is there and read what it wrote.

    ``append`` keeps all that was emitted, ``complete`` the last full result.
    Every batch is written to its own folder, so a batch that is tried again
    replaces its own output.
    """
    spark, base, schema = stream.sparkSession, scratch(stream.sparkSession), stream.schema

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    with session_settings(spark, settings or {}):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema.add("batch", "long")).parquet(f"{base}/out") if schema.fieldNames() else None
    if mode == "complete":
        found = found.filter(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")


def error_events(rows: DataFrame, failed: Column, message: Column) -> DataFrame:
    """JSON error events of the rows that failed; the stream goes on."""
    return rows.filter(failed).select(F.to_json(F.struct(F.lit("error").alias("type"), message.alias("error"))).alias("event"))


def source_events(groups: DataFrame) -> DataFrame:
    """One JSON event for each source group."""
    return groups.select(F.to_json(F.struct(F.lit("rag-source").alias("type"), F.struct(*groups.columns).alias("data"))).alias("event"))


def response_stats(events: DataFrame, by: str, time: str) -> DataFrame:
    """(by, chunks_sent, duration_s) of each response."""
    span = F.max(time).cast("double") - F.min(time).cast("double")
    return events.groupBy(by).agg(F.count("*").alias("chunks_sent"), span.alias("duration_s"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds position (from 0) of rows within ``by``."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
