"""Token streams assembled in state, and queries that are stopped and go on."""

import time

import pytest

from tessera.streaming import events as S
from tessera.streaming import messages as M

EVENT = "message_id string, seq long, type string, delta string"


def streamed(spark, path, batches, pause=0.0):
    """A stream whose batches come one after the other; files are named in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{path}/in{k}")
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in*")


def test_messages_are_assembled_over_batches(spark, tmp_path):
    batches = [
        [("a", 0, "start", None), ("a", 1, "text-start", None), ("a", 3, "text-delta", "lo "), ("a", 2, "text-delta", "Hel"), ("b", 0, "start", None), ("b", 2, "text-delta", "x")],
        [("a", 5, "text-delta", ""), ("a", 4, "text-delta", "you"), ("b", 3, "error", None), ("c", 2, "text-delta", "never ends")],
        [("a", 6, "text-end", None), ("a", 7, "finish", None)],
        [("a", 8, "text-delta", "too late"), ("a", 9, "finish", None), ("d", 0, "finish", None)],
    ]
    found = S.run_to_table(M.assemble_stream(streamed(spark, tmp_path, batches)), settings=M.assembling())
    assert sorted(tuple(r) for r in found.collect()) == [("a", "finished", "Hello you", 3), ("a", "late", "too late", 1), ("b", "failed", "x", 1), ("d", "finished", "", 0)]


def test_a_stalled_message_is_told_and_can_still_end(spark, tmp_path):
    batches = [[("a", 2, "text-delta", "one ")], [("b", 2, "text-delta", "x"), ("b", 3, "finish", None)], [("a", 3, "text-delta", "two"), ("a", 4, "finish", None)]]
    stream = M.assemble_stream(streamed(spark, tmp_path, batches), stall_ms=1)
    query = M.serve(stream, f"file://{tmp_path}/out", "stalled", after_batch=lambda n: time.sleep(0.2), settings=M.assembling())
    query.awaitTermination()
    found = sorted(tuple(r)[:4] for r in M.served(spark, f"file://{tmp_path}/out", "stalled", stream.schema).collect())
    assert ("a", "finished", "one two", 2) in found and ("b", "finished", "x", 1) in found and ("a", "stalled", "one ", 1) in found


def test_events_of_a_message(spark):
    tokens = spark.createDataFrame([("m", 0, "a"), ("m", 1, ""), ("m", 2, "b"), ("n", 0, None)], "message_id string, seq long, delta string")
    found = [tuple(r) for r in M.message_events(tokens).orderBy("message_id", "seq").collect()]
    assert found == [("m", 0, "start", None), ("m", 1, "text-start", None), ("m", 2, "text-delta", "a"), ("m", 4, "text-delta", "b"), ("m", 5, "text-end", None), ("m", 6, "finish", None), ("n", 0, "start", None), ("n", 1, "text-start", None), ("n", 3, "text-end", None), ("n", 4, "finish", None)]


@pytest.mark.parametrize("stop_at", [0, 1, 2])
def test_a_stopped_query_goes_on_and_gives_each_event_once(spark, tmp_path, stop_at):
    batches = [[("a", 2 * k, "text-delta", str(2 * k)), ("a", 2 * k + 1, "text-delta", str(2 * k + 1)), ("b", k, "text-delta", "b")] for k in range(4)]
    stream = streamed(spark, tmp_path, batches)
    base = f"file://{tmp_path}/out"

    def killed(number):
        if number == stop_at:  # the batch is written but not committed
            raise RuntimeError("the driver dies here")

    with pytest.raises(Exception, match="the driver dies here"):
        M.serve(stream, base, "q", after_batch=killed).awaitTermination()
    before = M.served(spark, base, "q", stream.schema)
    seen = before.filter("message_id = 'a'").groupBy("message_id").agg({"seq": "max"}).toDF("message_id", "seq")
    seen = spark.createDataFrame(seen.collect(), "message_id string, seq long")
    M.serve(stream, base, "q").awaitTermination()
    whole = M.served(spark, base, "q", stream.schema)
    assert sorted((r.message_id, r.seq) for r in whole.collect()) == sorted((r[0], r[1]) for rows in batches for r in rows)
    rest = M.events_after(whole, seen)
    assert sorted(r.seq for r in rest.filter("message_id = 'a'").collect()) == list(range(2 * stop_at + 2, 8))
    assert rest.filter("message_id = 'b'").count() == 4  # this client saw nothing yet
