"""A file is parsed once on its way to points, and the search of an answer may go in many blocks."""

from pyspark.sql import functions as F

from tessera.operators import chunking, pipeline, retrieval
from tessera.sources import files


def test_parser_stands_once_in_the_plan(spark, monkeypatch):
    monkeypatch.setattr(files, "_parsers", dict(files._parsers))
    files.register_parser("marking", "x/marked")(lambda text: F.concat(text, F.lit(" ONCEMARK")))
    given = spark.createDataFrame([(1, "x/marked", "a b"), (2, "x/other", "c"), (3, "x/marked", None)], "source_id long, media_type string, content string")
    parsed = files.parse_with_fallback(given, "marking").select("source_id", F.col("parsed").alias("content"))
    chunks = chunking.chunk_token(parsed)
    assert sorted((r.source_id, r.text) for r in chunks.collect()) == [(1, "a b ONCEMARK"), (3, "ONCEMARK")]
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("ONCEMARK") == 1


def test_answers_of_many_blocks(spark, monkeypatch):
    texts = [(i, f"h{i}", "text/plain", f"word{i} word{i % 5} common") for i in range(40)] + [(99, "h", "text/plain", " ")]
    points = pipeline.index_files(spark.createDataFrame(texts, "source_id long, source_hash string, media_type string, content string"))
    questions = spark.createDataFrame([(i, f"word{i} common") for i in range(6)] + [(7, None)], "query_id long, query_text string")
    rows = lambda: sorted((r.query_id, r.chunk_id, r.source_id, r.contents, r.new_rank, r.query_text) for r in pipeline.answer(points, questions).collect())
    whole = rows()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert rows() == whole and {r[0] for r in whole} == set(range(6))
    chosen = retrieval.RetrievalConfig(filters={"contents": lambda c: c.contains("word3")})
    assert {r.source_id for r in pipeline.answer(points, questions, chosen).collect()} <= {3, *range(8, 40, 5), *range(30, 40)}
    assert pipeline.answer(points, questions, chosen).count() > 0
