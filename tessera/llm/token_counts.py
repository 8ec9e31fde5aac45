"""Token counts as an exact length histogram (operator 8).

Documents are aggregated by their encoded length. The histogram answers, for
every context limit, what the limit keeps and cuts: suffix sums give the
documents and tokens beyond it. Suffix sums run in two levels, so no task needs
more lengths than one stretch of them or one total for each stretch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import prepare, written

#: Lengths of one stretch of the two-level sums.
STRETCH = 4096


def length_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(length long, n_docs long)``: how many rows of ``docs (text, ...)`` encode to so many ids. Null counts as empty."""
    prepare(docs)
    path = path or bpe.default_path()

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            found.update(len(ids) // 4 for ids in bpe.encoded(batch.column("text"), path))
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["length", "n_docs"])

    return docs.select("text").mapInArrow(tally, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def _suffix(df: DataFrame, column: str, total: str) -> DataFrame:
    """Add ``total``: the sum of ``column`` over this length and all above."""
    stretched = df.withColumn("__stretch", F.floor(F.col("length") / STRETCH))
    inside = Window.partitionBy("__stretch").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy(F.col("__stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = stretched.groupBy("__stretch").agg(F.sum(column).alias("__own")).select("__stretch", F.coalesce(F.sum("__own").over(across), F.lit(0)).alias("__above"))
    return stretched.withColumn(total, F.sum(column).over(inside)).join(above, "__stretch").withColumn(total, F.col(total) + F.col("__above")).drop("__stretch", "__above")


def length_histogram(docs: DataFrame, path: str | None = None, limits: tuple[int, ...] = ()) -> DataFrame:
    """Per distinct length, and per context limit of ``limits``: length, n_docs, n_tokens, docs_at_least, tokens_at_least, truncated_total, share_at_most.

    ``docs_at_least`` and ``tokens_at_least`` cover documents of this length and
    longer; ``truncated_total`` is the tokens left when every document is cut to
    this length; ``share_at_most`` is the share of documents that it holds
    whole. A limit at which no document ends has n_docs 0. Between two lengths
    both sums stay and ``truncated_total`` is linear, so these rows answer every
    limit. Rows count as often as they occur. An empty table gives no rows.
    """
    return _histogram(written(length_counts(docs, path), "lengths"), limits)


def _histogram(counts: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    if limits and not counts.isEmpty():
        asked = counts.sparkSession.createDataFrame([(x, 0) for x in sorted(set(limits))], "length long, n_docs long")
        counts = counts.unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    counts = counts.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    sums = _suffix(_suffix(counts, "n_docs", "docs_at_least"), "n_tokens", "tokens_at_least")
    whole = counts.agg(F.sum("n_docs").alias("__docs"), F.sum("n_tokens").alias("__tokens"))
    return sums.join(F.broadcast(whole)).select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("__tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("__docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("__docs")).alias("share_at_most"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return histogram.filter(F.col("share_at_most") >= share).agg(F.min("length").alias("length"))


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, from the suffix sums: documents and tokens that it keeps whole, documents it cuts, tokens left after the cut."""
    found = _histogram(histogram.select("length", "n_docs"), tuple(limits)).filter(F.col("length").isin(*limits))
    cut = F.col("docs_at_least") - F.col("n_docs")
    whole = histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("__docs"))
    return found.join(F.broadcast(whole)).select(F.col("length").alias("context_limit"), (F.col("__docs") - cut).alias("docs_whole"), cut.alias("docs_cut"), F.col("truncated_total").alias("tokens_left"))
