"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage reads what the one before it wrote and works on all of it. All but the
last return the columns of ``documents``. Columns of ``documents`` may hold nulls, rows
may repeat, and the table may be empty: then every stage gives an empty table.
Columns besides doc_id, text, lang and source are carried and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import scratch_path
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import keep_identified
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import pack
from tessera.llm.simhash_dedup import near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language and of none that was learned; a null or letterless text has none. Repeated rows stay."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest row stays, then the smallest doc_id, null last; of repeated rows one."""
    return exact_dedup(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints within three bits, or five-word shingles 0.8 alike; that of the smallest doc_id, null last."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights, none repeated beyond the limit; a document occurs once for each epoch that takes it. A null source is one of its own."""
    return mixed_documents(docs)


#: Words whose ids a worker of the packing stage holds: fewer than elsewhere, since executors still hold what the stages before took.
REMEMBERED = 200_000


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 1024; repeated rows are packed as often."""
    return pack(docs, remembered=REMEMBERED)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_dedup", simhash), ("mixing", mixing), ("packing", packing)]

#: Fingerprints and token ids are not in DuckDB's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
