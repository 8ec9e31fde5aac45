"""Bucketed points and tables over JDBC."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import buckets
from tessera.sources.database import Database

POINT = "id string, vector array<double>, payload string"


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_rewrites_only_the_buckets_of_its_ids(spark, tmp_path):
    store = buckets.open_store("buckets", spark, f"file://{tmp_path}", "c", 2, buckets=16)
    rows = {f"p{i}": ([float(i), 1.0], "old") for i in range(400)}
    table = lambda rows: spark.createDataFrame([(i, *v) for i, v in rows.items()], POINT)
    assert store.upsert(table(rows)) == 16
    before = files_of(f"{tmp_path}/c/points")
    new = {"p7": ([0.0, 0.0], "new"), "p8": ([0.5, 0.5], "new"), "q1": ([1.0, 2.0], "new"), "q2": ([1.0, 3.0], "new")}
    touched = store.upsert(table(new))
    after = files_of(f"{tmp_path}/c/points")
    assert touched <= 4 and len(before.keys() - after.keys()) <= touched and all(after[f] == before[f] for f in before.keys() & after.keys()) and len(before.keys() & after.keys()) >= 12
    shown = lambda: {r.id: (r.vector, r.payload) for r in store.read().collect()}
    assert shown() == rows | new and store.read().count() == 402
    assert store.delete(spark.createDataFrame([("p7",), ("none",)], "id string")) <= 2
    assert shown() == {k: v for k, v in (rows | new).items() if k != "p7"}
    store.delete(store.read().select("id"))
    assert store.read().count() == 0
    store.upsert(table({"x": ([1.0, 1.0], "a")}), mode="append")
    store.upsert(table({"x": ([1.0, 1.0], "b")}), mode="append")
    assert sorted(r.payload for r in store.read().collect()) == ["a", "b"] and store.info().first().points_count == 2


def test_random_upserts_and_deletes_against_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    store, held = buckets.BucketedPointsStore(spark, f"file://{tmp_path}", "r", 1, buckets=5), {}
    for step in range(4):
        new = {f"k{rng.randrange(12)}": ([float(step)], str(step)) for _ in range(6)}
        store.upsert(spark.createDataFrame([(i, *v) for i, v in new.items()], POINT))
        gone = [f"k{rng.randrange(12)}" for _ in range(3)]
        store.delete(spark.createDataFrame([(i,) for i in gone], "id string"))
        held = {k: v for k, v in (held | new).items() if k not in gone}
        assert {r.id: (r.vector, r.payload) for r in store.read().collect()} == held


def test_two_writers_cannot_lose_an_update(spark, tmp_path):
    store = buckets.BucketedPointsStore(spark, f"file://{tmp_path}", "w", 1)
    other = buckets.BucketedPointsStore(spark, f"file://{tmp_path}", "w", 1, buckets=7)
    assert other.buckets == store.buckets == buckets.BUCKETS
    row = spark.createDataFrame([("a", [1.0], "x")], POINT)
    with store._locked(), pytest.raises(RuntimeError, match="another writer"):
        other.upsert(row)
    other.upsert(row)
    with pytest.raises(ValueError, match="parts"):
        store.upsert(spark.createDataFrame([("a", [1.0, 2.0], "x")], POINT))
    with pytest.raises(ValueError, match="dimension"):
        buckets.BucketedPointsStore(spark, f"file://{tmp_path}", "w", 2)
    with pytest.raises(FileNotFoundError):
        buckets.BucketedPointsStore(spark, f"file://{tmp_path}", "none", 1).read()
    files, lock = store._file("lock")
    files.createNewFile(lock)  # of a writer that died
    store.break_lock()
    store.upsert(row)


def test_stores_by_name(spark, tmp_path):
    assert buckets.available_stores() == ["buckets", "versions"]
    with pytest.raises(ValueError, match="store must be"):
        buckets.open_store("none", spark, "", "x", 1)
    assert buckets.open_store("versions", spark, f"file://{tmp_path}", "v", 1).name == "v"


@pytest.fixture
def database(spark, tmp_path):
    return Database(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")


def test_messages_to_a_database_and_back(spark, database):
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", F.substring("text", 1, 200).alias("body"))
    rows = messages.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).dropDuplicates(["id"]).repartition(3)
    database.append(rows, "messages")
    back = database.read("messages")
    shown = lambda df: sorted(tuple(r) for r in df.select("id", "conv_id", "turn", "role", "body").collect())
    assert shown(back) == shown(rows)
    plan = back.filter("turn = 1").select("id", "role")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(turn), *EqualTo(turn,1)]" in plan and "body" not in plan.split("ReadSchema")[1]
    assert back.filter("turn = 1").count() == rows.filter("turn = 1").count()


def test_partitioned_reads(spark, database):
    database.execute("CREATE TABLE things (id INT, kind VARCHAR(9))")
    database.append(spark.createDataFrame([(i, f"k{i % 3}") for i in range(50)] + [(None, "none")], "ID int, KIND string"), "things")
    for tasks in (1, 4, None):
        found = database.read("things", by="ID", tasks=tasks)
        assert found.rdd.getNumPartitions() == (tasks or 1) and found.count() == 51
    with pytest.raises(ValueError, match="no name"):
        database.read("things", by="id; drop table things")


def test_upsert(spark, database):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, name string, score double")
    database.append(rows((1, "a", 1.0), (2, "b", 2.0)), "scores")
    database.upsert(rows((2, "B", 2.5), (3, "c", None), (3, "c", None)).repartition(2), "scores", "id")
    shown = lambda: sorted((r.id, r.name, r.score) for r in database.read("scores").collect())
    assert shown() == [(1, "a", 1.0), (2, "B", 2.5), (3, "c", None)]
    database.upsert(rows((2, "B", 2.5)), "scores", "id")
    assert shown() == [(1, "a", 1.0), (2, "B", 2.5), (3, "c", None)]
    with pytest.raises(Exception, match="(?i)exist"):
        database.upsert(rows((1, "x", 0.0)), "nothing", "id")
    with pytest.raises(Exception, match="(?i)syntax|exist"):
        database.execute('DELETE FROM scores WHERE "id" = 1', "nonsense")
    assert len(shown()) == 3  # rolled back
