"""How the tables stand for the reference's entities, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import doubles
from tessera.operators.retrieval import RetrievalConfig, vector_search
from tessera.scratch import few, written
from tessera.session import table


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as stored points: chunk_id, source_id, vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("source_id"), doubles(F.col("embedding")).alias("vector"))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 100."""
    return points(spark, sf_dir).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))


def hits(spark: SparkSession, sf_dir: str, **config) -> DataFrame:
    """Search results: query_id, chunk_id, source_id, similarity_score, result_rank."""
    return vector_search(points(spark, sf_dir), query_points(spark, sf_dir), RetrievalConfig(**config)).select("query_id", "chunk_id", "source_id", "similarity_score", "result_rank")


def hits_with_text(spark: SparkSession, sf_dir: str, **config) -> DataFrame:
    """Search results with contents and source_name of the document of the same id, and the query's own text.

    The narrow results come first; of the documents only those that they name are kept, in one scan, and shuffled.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("contents"), F.col("source").alias("source_name"))
    tasks = spark.sparkContext.defaultParallelism  # results are small without their texts, and would be left in few tasks
    found = written(hits(spark, sf_dir, **config).repartition(tasks, "query_id"), "hits")
    named = found.select("chunk_id").union(found.select("query_id")).distinct()
    texts = written(docs.join(few(named), "chunk_id", "left_semi"), "hit-texts")
    asked = texts.select(F.col("chunk_id").alias("query_id"), F.col("contents").alias("query_text"))
    return found.join(texts, "chunk_id", "left").join(asked, "query_id", "left")


def hits_with_source(spark: SparkSession, sf_dir: str, **config) -> DataFrame:
    """The rows of ``hits_with_text`` with source_name alone; no text is read."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"))
    asked = docs.select(F.col("chunk_id").alias("query_id"))
    return hits(spark, sf_dir, **config).join(docs, "chunk_id", "left").join(asked, "query_id", "left")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: the parent is the turn before."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("convo_id"),
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("parent_id"),
        "turn",
        "role",
        "text",
    )


SCORES = {
    "cosine": "CASE WHEN list_inner_product(v, v) * list_inner_product(qv, qv) > 0 THEN list_cosine_similarity(v, qv) END",
    "dot": "list_inner_product(v, qv)",
    "euclidean": "list_distance(v, qv)",
}


def hits_cte(k: int = 10, metric: str = "cosine", where: str = "true", after: str = "true", name: str = "hits") -> str:
    """CTEs p, q, ``name``_all and ``name`` with the columns of ``hits``."""
    direction = "ASC" if metric == "euclidean" else "DESC"
    return f"""
{name}_p AS (SELECT vec_id AS chunk_id, label::BIGINT AS source_id, embedding::DOUBLE[] AS v FROM embeddings),
{name}_q AS (SELECT chunk_id AS query_id, v AS qv FROM {name}_p WHERE chunk_id % 100 = 0),
{name}_all AS (SELECT query_id, chunk_id, source_id, {SCORES[metric]} AS similarity_score FROM {name}_p, {name}_q WHERE chunk_id <> query_id),
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score {direction}, chunk_id) - 1 AS result_rank
  FROM {name}_all WHERE similarity_score IS NOT NULL AND {where}),
{name} AS (SELECT * FROM {name}_ranked WHERE result_rank < {k} AND {after})"""


#: CTE ``texted``: hits with contents, source_name and query_text.
def texted_cte(k: int = 10) -> str:
    return (
        hits_cte(k)
        + """,
texted AS (
  SELECT h.*, d.text AS contents, d.source AS source_name, a.text AS query_text
  FROM hits h LEFT JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN documents a ON a.doc_id = h.query_id)"""
    )


#: SQL text of the characters that a strip removes, and of words of a text.
BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(trim({text}, {BLANKS_SQL}), '\\s+'), lambda w: w <> '')"
