"""The vector index against search over all points: equal rows for every metric, fewer points compared where there are clusters."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.operators.vector_index import VectorIndex, build_vector_index

POINT = "chunk_id long, vector array<double>, source_id long"
QUERY = "query_id long, query_vector array<double>"


def clustered(rng, n, clusters=12, dimension=6, spread=0.05):
    centres = [[rng.gauss(0, 3) for _ in range(dimension)] for _ in range(clusters)]
    return [[x + rng.gauss(0, spread) for x in centres[i % clusters]] for i in range(n)]


def rows_of(df):
    return sorted((r.query_id, r.result_rank, r.chunk_id, r.source_id, r.similarity_score) for r in df.collect())


def compared(spark, tmp_path, vectors, asked, name="i", cells=None, directions=False, **config):
    pts = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], POINT)
    queries = spark.createDataFrame(list(enumerate(asked)), QUERY)
    config = retrieval.RetrievalConfig(**config)
    report = {}
    index = build_vector_index(pts, f"file://{tmp_path}/{name}", cells, directions)
    found = rows_of(index.search(queries, config, report=report))
    assert found == rows_of(retrieval.vector_search(pts, queries, config))
    assert sorted(VectorIndex(spark, f"file://{tmp_path}/{name}").points().columns) == sorted([*pts.columns, "cell", "ring", "distance", "row"])
    return found, report


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_index_equals_search_and_skips(spark, tmp_path, metric):
    rng = random.Random(1)
    vectors = clustered(rng, 400)
    found, report = compared(spark, tmp_path, vectors, vectors[:9], metric=metric, top_k=5)
    assert len(found) == 45 and report["pairs"] == 3600 and report["compared"] < 0.6 * report["pairs"]


@pytest.mark.parametrize(("metric", "config"), [("cosine", {"min_score": 0.9}), ("cosine", {"min_score": 0.2, "threshold_stage": "after"}), ("euclidean", {"min_score": 2.0}), ("dot", {"filters": {"source_id": [1]}, "top_k": 30}), ("cosine", {"top_k": 1000})])
def test_index_honours_the_config(spark, tmp_path, metric, config):
    rng = random.Random(2)
    vectors = clustered(rng, 90, 4, 3, 0.8)
    compared(spark, tmp_path, vectors, vectors[5:12], metric=metric, **config)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_odd_vectors_ties_and_repeats(spark, tmp_path, metric):
    rng = random.Random(3)
    same = [[1.0, 2.0, 0.0]] * 40  # more ties than top_k, all in one ring
    odd = [None, [], [1.0], [0.0, 0.0, 0.0], [1.0, None, 2.0]]
    vectors = same + clustered(rng, 50, 3, 3) + odd
    compared(spark, tmp_path, vectors, [[1.0, 2.0, 0.0], [0.0, 0.0, 0.0], [5.0, 5.0, 5.0], None, [1.0]], metric=metric, top_k=7)


def test_index_of_few_points(spark, tmp_path):
    asked = [[1.0, 0.0]]
    assert compared(spark, tmp_path, [], asked, "none")[0] == []
    assert len(compared(spark, tmp_path, [[1.0, 1.0], [2.0, 1.0]], asked, "two")[0]) == 1  # the query's own id is no result
    with pytest.raises(ValueError, match="row"):
        build_vector_index(spark.createDataFrame([(1, [1.0], 2)], "chunk_id long, vector array<double>, row long"), f"file://{tmp_path}/x")


def test_queries_in_several_blocks_and_string_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    vectors = clustered(rng, 120, 5, 4)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    compared(spark, tmp_path, vectors, vectors[:11], top_k=3)
    pts = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(vectors)], "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(f"p{i}", vectors[i]) for i in range(5)], "query_id string, query_vector array<double>")
    shown = lambda df: sorted(tuple(r) for r in df.select("query_id", "result_rank", "chunk_id", "similarity_score").collect())
    index = build_vector_index(pts, f"file://{tmp_path}/text")
    assert shown(index.search(queries)) == shown(retrieval.vector_search(pts, queries))


def test_only_visited_cells_are_read(spark, tmp_path):
    vectors = clustered(random.Random(5), 300, 10, 4, 0.01)
    index = build_vector_index(spark.createDataFrame(list(enumerate(vectors)), "chunk_id long, vector array<double>"), f"file://{tmp_path}/p", 10)
    plan = index.points().filter(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_an_index_of_directions(spark, tmp_path):
    rng = random.Random(6)
    vectors = [[x * scale for x in v] for v, scale in zip(clustered(rng, 300), [rng.uniform(0.1, 9) for _ in range(300)])]
    _, plain = compared(spark, tmp_path, vectors, vectors[:8], "plain", top_k=5)
    _, report = compared(spark, tmp_path, vectors, vectors[:8], "scaled", directions=True, top_k=5)
    assert report["compared"] < 0.3 * report["pairs"] and report["compared"] < plain["compared"]
    odd = [None, [0.0] * 6, [1.0], *vectors[:40]]
    compared(spark, tmp_path, odd, [[0.0] * 6, vectors[3], [1.0]], "odd", directions=True, top_k=7)
    index = VectorIndex(spark, f"file://{tmp_path}/scaled")
    with pytest.raises(ValueError, match="cosine"):
        index.search(spark.createDataFrame([(1, [1.0])], QUERY), retrieval.RetrievalConfig(metric="dot"))
