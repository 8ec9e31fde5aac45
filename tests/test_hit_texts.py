"""Texts of results: documents that no result names are not shuffled."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.plans import base, search_queries, text_queries  # noqa: F401  (they register themselves)


def _shuffled(spark) -> int:
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_of_results_are_shuffled(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with texts that are too large for it
    try:
        _compare(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _compare(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors, documents = 120, 4_000
    pq.write_table(
        pa.table({"vec_id": pa.array(range(vectors), pa.int64()), "embedding": pa.array(rng.normal(size=(vectors, 4)).astype("f4").tolist(), pa.list_(pa.float32())), "label": pa.array([1] * vectors, pa.int32())}),
        tmp_path / "embeddings.parquet",
    )
    ids = [*range(60), 100, 0, *range(1_000, documents)]  # some results and no document; one id twice
    texts = [rng.bytes(1_000).hex() for _ in ids]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "source": ["s"] * len(ids)}), tmp_path / "documents.parquet")
    before = _shuffled(spark)
    rows = base.hits_with_text(spark, str(tmp_path), top_k=5).collect()
    assert _shuffled(spark) - before < sum(map(len, texts)) / 20
    held: dict = {}
    for i, text in zip(ids, texts):
        held.setdefault(i, []).append(text)
    found = base.hits(spark, str(tmp_path), top_k=5).collect()
    assert {r["query_id"] for r in found} == {0, 100}
    wanted = [(h["query_id"], h["result_rank"], c, q) for h in found for c in held.get(h["chunk_id"], [None]) for q in held.get(h["query_id"], [None])]
    assert sorted(map(str, wanted)) == sorted(str((r["query_id"], r["result_rank"], r["contents"], r["query_text"])) for r in rows)


def test_documents_mode_reads_no_text(spark, monkeypatch):
    made = []
    monkeypatch.setattr(base, "written", lambda df, name: made.append(name) or df)
    found = search_queries.retrieve_documents_mode(spark, "/root/testdata/sf0.001")
    assert not made
    assert "text:string" not in found._jdf.queryExecution().executedPlan().toString()
