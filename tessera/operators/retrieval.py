"""Search over points: vector, keyword and hybrid retrieval, and payload filters.

Queries are a stated set. They go to the executors in blocks of at most
``QUERY_BLOCK`` vectors, so what is broadcast is bounded whatever their number;
points are scanned where they lie. Ranks are cut as ``row_number() <= k``, the
form that Spark prunes before the exchange (``WindowGroupLimit``; tests read the
plans), so each task sends the best of each query only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.functions.text import expanded, words
from tessera.functions.vectors import METRICS, doubles
from tessera.operators import best, pairs
from tessera.operators.post import reciprocal_rank_fusion
from tessera.scratch import text_batches, unused, written
from tessera.session import share_code

if TYPE_CHECKING:
    from tessera.operators.keyword_index import KeywordIndex
    from tessera.operators.vector_index import VectorIndex

QUERY_BLOCK = 4096
#: Keyword scores are rounded to so many places before they are ranked.
PLACES = 6

Filter = str | int | float | bool | list | tuple | set | Callable[[Column], Column]


@dataclass(frozen=True)
class RetrievalConfig:
    """What a search returns. ``threshold_stage`` is before or after the top_k cut."""

    top_k: int = 10
    min_score: float = 0.0
    metric: str = "cosine"
    threshold_stage: str = "before"
    filters: dict[str, Filter] = field(default_factory=dict)
    file_types: tuple[str, ...] = ()
    source_ids: tuple = ()
    date_from: str | None = None
    date_to: str | None = None
    deduplicate: bool = True
    rerank_top_k: int | None = None

    def __post_init__(self) -> None:
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {sorted(METRICS)}")
        if self.threshold_stage not in ("before", "after"):
            raise ValueError("threshold_stage must be before or after")
        if self.min_score < 0:
            raise ValueError("min_score must not be negative")


def metadata_filter(df: DataFrame, filters: dict[str, Filter] | None) -> DataFrame:
    """Rows that satisfy every filter: a value, a collection of values, or a predicate of the column.

    No filter keeps all; a field that does not exist, or is null, keeps none.
    """
    for name, wanted in (filters or {}).items():
        if name.split(".")[0] not in df.columns:
            return df.filter(F.lit(False))
        column = F.col(name)
        if callable(wanted):
            condition = wanted(column)
        elif isinstance(wanted, (list, tuple, set)):
            condition = column.isin(*wanted)
        else:
            condition = column == wanted
        df = df.filter(condition)  # bare, so that it reaches the scan; null keeps no row
    return df


def retrieval_filters(df: DataFrame, config: RetrievalConfig, file_type: str = "file_type", source_id: str = "source_id", date: str = "uploaded_at") -> DataFrame:
    """The declared filters of a retrieval: file types, sources, dates (both ends included), then ``filters``.

    As with ``metadata_filter``, a field that does not exist, or is null, keeps none.
    """
    declared: list[tuple[str, Filter]] = []
    if config.file_types:
        declared.append((file_type, config.file_types))
    if config.source_ids:
        declared.append((source_id, config.source_ids))
    if config.date_from:
        declared.append((date, lambda c: c >= F.lit(config.date_from).cast("timestamp")))
    if config.date_to:
        declared.append((date, lambda c: c <= F.lit(config.date_to).cast("timestamp")))
    for name, wanted in declared:
        df = metadata_filter(df, {name: wanted})
    return metadata_filter(df, config.filters)


def first_ranks(df: DataFrame, k: int, by: str, order: list[Column], name: str) -> DataFrame:
    """The first ``k`` rows of each ``by``, with their rank from 0 as ``name``."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(name, number).filter(F.col(name) <= k).withColumn(name, F.col(name) - 1)


def ranked(scored: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The results of each query among ``scored (query_id, chunk_id, similarity_score, ...)``, with result_rank."""
    metric = METRICS[config.metric]
    score = F.col("similarity_score")
    limited = config.min_score > 0
    if limited and config.threshold_stage == "before":
        scored = scored.filter(metric.passes(score, config.min_score))
    # Null scores come last, so they can be dropped after the cut and are not computed twice.
    best = first_ranks(scored, config.top_k, "query_id", [metric.order(score), F.col("chunk_id")], "result_rank").filter(score.isNotNull())
    if limited and config.threshold_stage == "after":
        best = best.filter(metric.passes(score, config.min_score))
    return best


def vector_search(points: DataFrame, queries: DataFrame, config: RetrievalConfig | None = None, exclude_self: bool = True) -> DataFrame:
    """Top points of every query.

    ``points`` has chunk_id, vector and any payload; ``queries`` has query_id
    and query_vector. Adds similarity_score and result_rank (from 0); equal
    scores are ordered by chunk_id. All filters of the config apply before the
    cut; dates are those of ``uploaded_at``. Points with a null score (a vector
    of length 0 under cosine) are no results.
    """
    config = config or RetrievalConfig()
    return block_search(retrieval_filters(points, config), queries, "vector", doubles, lambda: pairs.VectorScores(config.metric), config, exclude_self)


def block_search(points: DataFrame, queries: DataFrame, column: str, cast: Callable[[Column], Column], scores: Callable[[], pairs.Scores], config: RetrievalConfig, exclude_self: bool) -> DataFrame:
    """Results of ``queries (query_id, query_vector)`` among ``points (chunk_id, column, ...)`` by ``scores``, with similarity_score and result_rank.

    A task multiplies its points with a block of queries, sums again what could be a result, and gives the best of each query.
    """
    spark = points.sparkSession
    share_code(spark)
    queries = queries.select("query_id", cast(F.col("query_vector")).alias("query_vector"))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    if blocks > 1:  # several blocks of about half the bound, so that uneven hashing stays below it
        blocks *= 2
        queries = written(queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    vector, number, score = unused(points, "__vector", "query", "similarity_score")
    payload = [c for c in points.columns if c != column]
    scanned = points.select(*payload, cast(F.col(column)).alias(vector))
    schema = StructType([StructField(number, IntegerType()), *points.select(*payload).schema.fields, StructField(score, DoubleType())])
    kind = StructType([StructField(number, IntegerType()), queries.schema["query_id"]])
    metric = METRICS[config.metric]
    found = []
    for at in range(blocks):
        rows = (queries if blocks == 1 else queries.filter(F.col("part") == at)).collect()  # at most QUERY_BLOCK
        if not rows and found:
            continue
        ids = [r["query_id"] for r in rows]
        sent = spark.sparkContext.broadcast((ids, [r["query_vector"] for r in rows]))
        scored = scanned.mapInArrow(_compared(sent, scores(), vector, score, config.top_k, metric.largest_first, exclude_self), schema)
        named = scored.join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), kind)), number).drop(number)  # a block of queries
        if exclude_self:
            named = named.filter(F.col("chunk_id") != F.col("query_id"))
        found.append(ranked(named.select(*payload, "query_id", score), config))
    return reduce(DataFrame.unionByName, found)


def _compared(sent, scores: pairs.Scores, vector: str, score: str, k: int, largest_first: bool, exclude_self: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        kept = best.Best(len(ids), k, largest_first)
        search = pairs.Block(ids if exclude_self else None, vectors, scores)
        for batch in batches:
            search.add(kept, batch.column(vector), batch.drop_columns([vector]))
        yield from kept.batches(score)

    return run


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda token: token == F.lit(term)


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Keyword scores of ``docs (chunk_id, text, ...)`` for a query's terms; rows without a term are left out.

    Two scans and one row of corpus statistics, no shuffle of the texts.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    tokens = docs.withColumn("__tokens", words(F.lower(F.coalesce("text", F.lit("")))))
    counted = tokens.withColumn("__length", F.size("__tokens"))
    for i, term in enumerate(terms):
        counted = counted.withColumn(f"__tf{i}", F.size(F.filter("__tokens", _equals(term))))
    counted = counted.drop("__tokens")
    statistics = counted.agg(F.count("*").alias("__n"), F.avg("__length").alias("__mean"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__length") / F.col("__mean")))
    any_term = reduce(lambda x, y: x | y, [F.col(f"__tf{i}") > 0 for i in range(len(terms))])
    return counted.filter(any_term).crossJoin(F.broadcast(statistics)).select(*docs.columns, score.alias("keyword_score"))  # one row of statistics


def keyword_search(docs: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """The documents of highest BM25 score with result_rank from 0."""
    terms = query.split()
    if not terms:
        raise ValueError("a query needs a word")
    best = bm25(docs, terms).orderBy(F.col("keyword_score").desc(), "chunk_id").limit(top_k)
    return best.withColumn("result_rank", F.row_number().over(Window.orderBy(F.col("keyword_score").desc(), "chunk_id")) - 1)


def sparse_search(documents: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """Dot products of sparse vectors given as rows (chunk_id or query_id, term, weight).

    Only terms of a query meet its index list; scores are summed where they lie
    before the shuffle, and a query's best are ranked with early pruning.
    """
    met = documents.join(queries.withColumnRenamed("weight", "asked"), "term")
    scored = met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("asked")).alias("score"))
    return first_ranks(scored, top_k, "query_id", [F.col("score").desc(), F.col("chunk_id")], "result_rank")


#: Pairs of query and term, and queries, that are sent to all tasks at once; more go in several blocks, with a scan of the texts each.
BLOCK_TERMS = 2_000_000
BLOCK_TEXTS = 16_384
#: Words of texts that a task holds at a time.
HELD_WORDS = 1 << 20


def keyword_search_many(docs: DataFrame, queries: DataFrame, top_k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of ``docs (chunk_id, text)`` for every query of ``queries (query_id, query_text)``: query_id, chunk_id, keyword_score, result_rank.

    Texts are read and split once for a block of queries; of each document the counts of terms
    that some query holds go into a table, and nothing is shuffled by term or by pair of query
    and document: a task multiplies its documents with the block and gives the best of each query. Scores are rounded to six places, so
    that the order does not hang on the order of sums. Null texts count as empty,
    a query without a word has no results.
    """
    asked = written(queries.select("query_id", F.explode(F.array_distinct(words(F.lower(F.coalesce("query_text", F.lit("")))))).alias("term")), "asked-terms")
    found = [_keyword_block(docs, block, top_k, k1, b) for block in query_blocks(asked)]
    return reduce(DataFrame.unionByName, found)


def query_blocks(asked: DataFrame) -> list[DataFrame]:
    """``asked (query_id, term)`` in blocks of queries that can be sent to all tasks."""
    size = asked.agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
    blocks = max(1, -(-size["pairs"] // BLOCK_TERMS), -(-size["queries"] // BLOCK_TEXTS))
    blocks *= 2 if blocks > 1 else 1  # of about half the bound, so that uneven hashing stays below it
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return [asked if blocks == 1 else asked.filter(part == at) for at in range(blocks)]


def asked_block(asked: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Array, DataFrame]:
    """``asked (query_id, term)``, one block: number of the query and place of the term of each pair, the terms, and the queries' numbers as (query, query_id)."""
    pairs = asked.select("query_id", "term").distinct().toArrow().combine_chunks()
    query, term = (pc.dictionary_encode(pairs.column(c).combine_chunks(), null_encoding="encode") for c in ("query_id", "term"))
    query, term = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (query, term))
    kind = StructType([StructField("query", IntegerType()), StructField("query_id", asked.schema["query_id"].dataType)])
    names = asked.sparkSession.createDataFrame(list(enumerate(query.dictionary.to_pylist())), kind)
    return query.indices.to_numpy(), term.indices.to_numpy(), term.dictionary, names


def _keyword_block(docs: DataFrame, asked: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
    spark = docs.sparkSession
    share_code(spark)
    query, term, names, ids = asked_block(asked)
    sent = spark.sparkContext.broadcast(names)
    kind = docs.schema["chunk_id"].dataType.simpleString()

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in gathered(batches, "tokens", HELD_WORDS):
            tokens = batch.column("tokens")
            doc, length = best.lists(tokens)
            flat = tokens.flatten()
            code = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            pair, tf = np.unique((doc * max(1, len(known)) + code)[code >= 0], return_counts=True)
            doc, code = np.divmod(pair, max(1, len(known)))
            ends = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (code, tf, length[doc])]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(length), *listed], names=["chunk_id", "length", "terms", "tf", "lengths"])

    split = docs.select("chunk_id", words(F.lower(F.coalesce("text", F.lit("")))).alias("tokens"))
    with text_batches(spark):
        held = written(split.mapInArrow(counted, f"chunk_id {kind}, length long, terms array<int>, tf array<int>, lengths array<int>"), "asked-postings")
    whole = held.agg(F.count("*").alias("n"), F.sum("length").alias("words")).first()
    n, mean = whole["n"], (whole["words"] or 0) / max(1, whole["n"]) or 1.0
    again = held.groupBy("chunk_id").count().filter("count > 1")
    if not again.isEmpty():  # rows that share a chunk_id: a document whose terms stand once for each length
        again = written(again.select("chunk_id"), "repeated-names")
        same = F.col("chunk_id").eqNullSafe(F.col("__again"))
        named = again.withColumnRenamed("chunk_id", "__again")
        one = held.join(named, same, "left_semi").select("chunk_id", F.explode(F.arrays_zip("terms", "tf", "lengths")).alias("p")).groupBy("chunk_id", "p.terms", "p.lengths").agg(F.sum("p.tf").cast("int").alias("tf"))
        listed = F.collect_list(F.struct("terms", "tf", "lengths"))
        merged = one.groupBy("chunk_id").agg(listed.alias("p")).select("chunk_id", F.lit(0).cast("long").alias("length"), "p.terms", "p.tf", "p.lengths")
        held = written(held.join(named, same, "left_anti").unionByName(merged), "asked-postings")
    frequency = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(len(names))
    df[frequency.column("term").to_numpy()] = frequency.column("count").to_numpy()
    terms = spark.sparkContext.broadcast(best.AskedTerms(query, term, np.log(1 + (n - df + 0.5) / (df + 0.5)), df, ids.count()))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = terms.value
        kept = best.Best(asked.queries, top_k)
        for batch in batches:
            doc, _ = best.lists(batch.column("terms"))
            term, tf, length = (batch.column(c).flatten().to_numpy() for c in ("terms", "tf", "lengths"))
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
            best.add_scored(kept, asked, batch.select(["chunk_id"]), doc, term, weight, PLACES)
        yield from kept.batches("keyword_score")

    found = held.select("chunk_id", "terms", "tf", "lengths").mapInArrow(scored, f"query int, chunk_id {kind}, keyword_score double")
    found = found.join(F.broadcast(ids), "query").select("query_id", "chunk_id", "keyword_score")  # a block of queries
    return first_ranks(found, top_k, "query_id", [F.col("keyword_score").desc(), F.col("chunk_id")], "result_rank")


def gathered(batches: Iterable[pa.RecordBatch], column: str, values: int) -> Iterator[pa.RecordBatch]:
    """``batches`` put together until their lists in ``column`` hold ``values`` values."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(column).flatten())
        if n >= values:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _ranked_list(found: DataFrame, index: int) -> DataFrame:
    return found.select("query_id", F.lit(index).alias("list_idx"), F.col("result_rank").alias("rank"), F.col("chunk_id").alias("id"), F.lit("").alias("content"))


def _vector_list(points: DataFrame | VectorIndex, queries: DataFrame, config: RetrievalConfig, exclude_self: bool = True) -> DataFrame:
    return vector_search(points, queries, config, exclude_self) if isinstance(points, DataFrame) else points.search(queries, config, exclude_self)


def _keyword_list(docs: DataFrame | KeywordIndex, queries: DataFrame, top_k: int) -> DataFrame:
    return keyword_search_many(docs, queries, top_k) if isinstance(docs, DataFrame) else docs.search(queries, top_k)


def hybrid_search(points: DataFrame | VectorIndex, docs: DataFrame | KeywordIndex, queries: DataFrame, config: RetrievalConfig | None = None, candidates: int = 20) -> DataFrame:
    """Each query's vector list and its own keyword list, ``candidates`` long, fused by rank: query_id, id, rrf_score, fused_rank.

    ``queries`` has query_id, query_vector and query_text; filters of the config
    apply to the points, ``top_k`` to the fused list. Points and documents can be stored
    indexes; the results are the same.
    """
    config = config or RetrievalConfig()
    vector = _vector_list(points, queries, replace(config, top_k=candidates))
    keyword = _keyword_list(docs, queries, candidates).filter("chunk_id <> query_id")
    return reciprocal_rank_fusion(_ranked_list(vector, 0).unionByName(_ranked_list(keyword, 1)), top_k=config.top_k).select("query_id", "id", "rrf_score", "fused_rank")


def multi_query_search(points: DataFrame, variants: DataFrame, config: RetrievalConfig | None = None, candidates: int = 20) -> DataFrame:
    """One list for each variant of a query, fused by rank: query_id, id, rrf_score, fused_rank.

    ``variants`` has query_id, variant (0 for the query itself) and query_vector,
    such as ``expand`` and an embedder give.
    """
    config = config or RetrievalConfig()
    named = variants.select(F.struct("query_id", "variant").alias("query_id"), "query_vector")
    found = vector_search(points, named, replace(config, top_k=candidates), exclude_self=False)
    lists = found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.variant").alias("list_idx"), F.col("result_rank").alias("rank"), F.col("chunk_id").alias("id"), F.lit("").alias("content"))
    return reciprocal_rank_fusion(lists.filter("id <> query_id"), top_k=config.top_k).select("query_id", "id", "rrf_score", "fused_rank")


def search(strategy: str, points: DataFrame | VectorIndex, docs: DataFrame | KeywordIndex, queries: DataFrame, config: RetrievalConfig | None = None) -> DataFrame:
    """Search by strategy: vector_only, keyword_only, hybrid or multi_query (then ``queries`` has variants, and points are no index)."""
    config = config or RetrievalConfig()
    strategies = {
        "vector_only": lambda: _vector_list(points, queries, config),
        "keyword_only": lambda: _keyword_list(docs, queries, config.top_k),
        "hybrid": lambda: hybrid_search(points, docs, queries, config),
        "multi_query": lambda: multi_query_search(points, queries, config),
    }
    if strategy not in strategies:
        raise ValueError(f"strategy must be one of {sorted(strategies)}")
    return strategies[strategy]()


#: A plug-in that writes other forms of a query: text column to array<string> column.
Generator = Callable[[Column], Column]


def expand(queries: DataFrame, generate: Generator) -> DataFrame:
    """``queries (query_id, query_text)`` with their variants, the query itself first: query_id, variant, query_text.

    ``generate`` stands for expansion, decomposition or a hypothetical answer; a
    null from it leaves the query alone.
    """
    text = F.coalesce("query_text", F.lit(""))
    return queries.select("query_id", F.posexplode(expanded(text, F.coalesce(generate(text), F.array().cast("array<string>")))).alias("variant", "query_text"))
