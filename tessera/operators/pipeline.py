"""End to end: files to searchable points, and questions to reranked, grouped results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stripped
from tessera.operators import chunking, post
from tessera.operators.embedding import Embedder, embed_chunks, hashing_embedder
from tessera.operators.retrieval import RetrievalConfig, vector_search
from tessera.scratch import few, written
from tessera.sources.files import parse_with_fallback
from tessera.sources.points import prepare_points


@dataclass(frozen=True)
class IndexConfig:
    """How files become points."""

    parser: str = "markdown"
    fallback_parsers: tuple[str, ...] = ("html",)
    chunker: str = "token"
    chunks: chunking.ChunkerConfig = field(default_factory=chunking.ChunkerConfig)
    embed: Embedder = hashing_embedder


def index_files(files: DataFrame, config: IndexConfig | None = None) -> DataFrame:
    """``files (source_id, source_hash, media_type, content)`` as points (id, vector, payload).

    Parse, chunk and embed are local to rows; the payload join is by source. A
    file that no parser reads gives no point.
    """
    config = config or IndexConfig()
    parsed = parse_with_fallback(files, config.parser, config.fallback_parsers)
    chunks = chunking.chunk_sources(parsed.select("source_id", F.col("parsed").alias("content")), config.chunker, config.chunks)
    embedded = embed_chunks(chunks, config.embed).withColumnRenamed("dense_vector", "vector")
    facts = files.select("source_id", "source_hash", "media_type")
    return prepare_points(embedded.join(facts, "source_id"))


def answer(points: DataFrame, questions: DataFrame, config: RetrievalConfig | None = None, embed: Embedder = hashing_embedder, rerank_with: post.Scorer = post.overlap_score) -> DataFrame:
    """Results of ``questions (query_id, query_text)`` over ``points`` of ``index_files``.

    Search, then one result of each content (if asked), then rerank to
    ``rerank_top_k``. Blank questions have no results.
    """
    config = config or RetrievalConfig()
    asked = questions.filter(stripped(F.coalesce("query_text", F.lit(""))) != "")
    vectors = asked.select("query_id", embed(F.col("query_text")).alias("query_vector"))
    asked = written(asked, "questions")
    flat = points.select(F.col("id").alias("chunk_id"), "vector", "payload.source_id", "payload.media_type", F.col("payload.text").alias("contents"))
    flat = written(flat, "searched-points")  # once, whatever the number of blocks of questions; the search does not read the contents
    vectors = asked.select("query_id", embed(F.col("query_text")).alias("query_vector"))
    narrow = flat.withColumn("__at", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    searched = narrow if any(name.split(".")[0] == "contents" for name in config.filters) else narrow.drop("contents")
    found = written(vector_search(searched, vectors, config, exclude_self=False).drop("contents"), "found-points")
    visited = found.select(F.col("__at").alias("__of")).distinct()
    texts = narrow.select(F.col("__at").alias("__of"), "contents").join(few(visited), "__of", "left_semi")
    found = found.join(texts, found["__at"] == texts["__of"]).drop("__at", "__of").join(asked, "query_id")
    if config.deduplicate:
        found = post.dedup_results(found)
    return post.rerank(found, config.rerank_top_k or config.top_k, scorer=rerank_with)


def or_fallback(results: DataFrame, fallback: Callable[[], DataFrame]) -> DataFrame:
    """``results``, or those of ``fallback`` where there are none."""
    return fallback() if results.isEmpty() else results
