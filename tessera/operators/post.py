"""After retrieval: dedup, score filters, ordering, reranking, fusion, grouping.

All of these work for each query at once (``query_id``); ranks are computed
within a query, so no operator gathers results of different queries in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words

#: Characters of the contents that decide equality, and the fusion constant.
DEDUP_CHARS = 500
RRF_K = 60


def dedup_results(results: DataFrame, by: str = "query_id", rank: str = "result_rank", contents: str = "contents") -> DataFrame:
    """The first result of each distinct beginning of contents; ranks stay as they were."""
    start = F.substring(F.coalesce(contents, F.lit("")), 1, DEDUP_CHARS)
    order = Window.partitionBy(by, start).orderBy(rank)
    return results.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def filter_by_score(results: DataFrame, threshold: float, score: str = "similarity_score") -> DataFrame:
    """Scores of ``threshold`` or more; a missing score is 0, a threshold outside 0 to 1 is 0."""
    threshold = threshold if 0 <= threshold <= 1 else 0.0
    return results.filter(F.coalesce(score, F.lit(0.0)) >= threshold)


def apply_top_k(results: DataFrame, k: int, by: str = "query_id", rank: str = "result_rank") -> DataFrame:
    """The first ``k`` of the present order, at least one; it does not sort by score."""
    order = Window.partitionBy(by).orderBy(rank)
    return results.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= max(1, k)).drop("__n")


def sort_by_score(results: DataFrame, score: str = "similarity_score", descending: bool = True, by: str = "query_id", rank: str = "result_rank") -> DataFrame:
    """Adds ``new_rank`` from 0, by score and then the present order; a missing score is 0."""
    value = F.coalesce(score, F.lit(0.0))
    order = Window.partitionBy(by).orderBy(value.desc() if descending else value.asc(), rank)
    return results.withColumn("new_rank", F.row_number().over(order) - 1)


def overlap_score(query: Column, contents: Column) -> Column:
    """Share of the query's distinct words that the contents hold, in lower case."""
    asked = F.array_distinct(words(F.lower(query)))
    held = F.array_intersect(asked, words(F.lower(F.coalesce(contents, F.lit("")))))
    return F.coalesce(F.try_divide(F.size(held), F.size(asked)), F.lit(0.0))


Scorer = Callable[[Column, Column], Column]
_rerankers: dict[str, Scorer] = {"lexical": overlap_score}


def register_reranker(name: str) -> Callable[[Scorer], Scorer]:
    """Make a scorer (query column, contents column to score column) available by name."""

    def add(scorer: Scorer) -> Scorer:
        _rerankers[name] = scorer
        return scorer

    return add


def reranker(name: str) -> Scorer:
    if name not in _rerankers:
        raise ValueError(f"reranker must be one of {sorted(_rerankers)}")
    return _rerankers[name]


def available_rerankers() -> list[str]:
    return sorted(_rerankers)


def rerank(results: DataFrame, top_k: int = 10, score_threshold: float | None = None, scorer: Scorer = overlap_score, by: str = "query_id", rank: str = "result_rank", query: str = "query_text", contents: str = "contents", isolate: bool = False) -> DataFrame:
    """Results by the scorer's value: adds reranker_score and new_rank; similarity_score stays.

    The order is score, then the present rank; the threshold applies before the
    cut. Any number of queries is reranked at once; with ``isolate``, a query of
    which any score is null (its scorer failed) keeps its results as they were.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if score_threshold is not None and not 0 <= score_threshold <= 1:
        raise ValueError("score_threshold must be 0 to 1")
    scored = results.withColumn("reranker_score", scorer(F.col(query), F.col(contents)))
    if isolate:
        failed = F.max(F.col("reranker_score").isNull()).over(Window.partitionBy(by))
        scored = scored.withColumn("__failed", failed).withColumn("reranker_score", F.when(~F.col("__failed"), F.col("reranker_score")))
        if score_threshold is not None:
            scored = scored.filter(F.col("__failed") | (F.col("reranker_score") >= score_threshold))
            score_threshold = None
        order = Window.partitionBy(by).orderBy(F.col("reranker_score").desc(), rank)
        scored = scored.withColumn("new_rank", F.row_number().over(order) - 1)
        return scored.filter(F.col("__failed") | (F.col("new_rank") < top_k)).drop("__failed")
    if score_threshold is not None:
        scored = scored.filter(F.col("reranker_score") >= score_threshold)
    order = Window.partitionBy(by).orderBy(F.col("reranker_score").desc(), rank)
    return scored.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= top_k).withColumn("new_rank", F.col("new_rank") - 1)


def reciprocal_rank_fusion(lists: DataFrame, top_k: int | None = None, k: int = RRF_K, by: str = "query_id") -> DataFrame:
    """Fuse ranked lists ``(query_id, list_idx, rank from 0, id, content, ...)``.

    Per id and query: rrf_score = sum of 1 / (k + rank + 1), other columns from
    its first occurrence (list, then rank); fused_rank from 0 by score, then
    first occurrence. A missing or empty id is replaced by a hash of the
    content. A query with a single list keeps that list's order and has a null
    score. ``top_k`` None or 0 keeps all.
    """
    known = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.sha2(F.coalesce("content", F.lit("")), 256))
    payload = [c for c in lists.columns if c not in (by, "list_idx", "rank", "id")]
    # One pass over the lists: all places of an id, the first occurrence first; whether a query has one list is told from its ids.
    key = lambda x: x["list_idx"].cast("long") * (1 << 32) + x["rank"].cast("long")
    places = F.collect_list(F.struct("list_idx", "rank", (F.struct(*payload) if payload else F.lit(0)).alias("payload")))
    in_order = F.array_sort(places, lambda x, y: F.signum(key(x) - key(y)).cast("int"))
    fused = lists.withColumn("id", known).groupBy(by, "id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("rrf_score"), in_order.alias("f"))
    whole = Window.partitionBy(by)
    least, most = F.array_min(F.transform("f", lambda x: x["list_idx"])), F.array_max(F.transform("f", lambda x: x["list_idx"]))
    fused = fused.withColumn("alone", F.min(least).over(whole) == F.max(most).over(whole))
    occurs = F.explode(F.when(F.col("alone"), F.col("f")).otherwise(F.slice("f", 1, 1)))
    ranked = fused.select(by, "id", F.when(~F.col("alone"), F.col("rrf_score")).alias("rrf_score"), occurs.alias("f"))
    order = whole.orderBy(F.col("rrf_score").desc_nulls_last(), "f.list_idx", "f.rank", "id")
    ranked = ranked.withColumn("fused_rank", F.row_number().over(order))
    if top_k:
        ranked = ranked.filter(F.col("fused_rank") <= top_k)
    ranked = ranked.withColumn("fused_rank", F.col("fused_rank") - 1)
    return ranked.select(by, "id", "rrf_score", "fused_rank", *[F.col(f"f.payload.{c}").alias(c) for c in payload])


def group_by_source(results: DataFrame, by: str = "query_id", source: str = "source_id", attributes: tuple[str, ...] = ()) -> DataFrame:
    """Results of each query and source as one row.

    top_score, chunk_count, first_rank, attributes of the first result, and
    chunks: array<struct<result_rank, chunk_id, similarity_score>> in input
    order; group_rank from 0 by top_score, then first occurrence.
    """
    grouped = results.groupBy(by, source).agg(
        F.max("similarity_score").alias("top_score"),
        F.count("*").alias("chunk_count"),
        F.min("result_rank").alias("first_rank"),
        *[F.min_by(a, "result_rank").alias(a) for a in attributes],
        F.sort_array(F.collect_list(F.struct("result_rank", "chunk_id", "similarity_score"))).alias("chunks"),
    )
    order = Window.partitionBy(by).orderBy(F.col("top_score").desc(), "first_rank")
    return grouped.withColumn("group_rank", F.row_number().over(order) - 1)
