"""Embedding texts: a plug-in protocol, a hashing embedder that needs no model, coverage."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import BLANKS, stripped, words
from tessera.functions.vectors import l2_normalised
from tessera.operators.isolation import Outcome, applied

Embedder = Callable[[Column], Column]
_embedders: dict[str, Embedder] = {}


def register_embedder(name: str) -> Callable[[Embedder], Embedder]:
    """Make an embedder (text column to array<double> column) available by name."""

    def add(embedder: Embedder) -> Embedder:
        _embedders[name] = embedder
        return embedder

    return add


def embedder(name: str) -> Embedder:
    if name not in _embedders:
        raise ValueError(f"embedder must be one of {sorted(_embedders)}")
    return _embedders[name]


def available_embedders() -> list[str]:
    return sorted(_embedders)


#: Fixed value: length of the hashing embedder's vectors.
HASH_DIMENSIONS = 32


@register_embedder("hashing")
def hashing_embedder(text: Column) -> Column:
    """Word counts in hashed buckets, scaled to length 1; a stand-in that needs no model and repeats exactly.

    Words are lower-cased and divided by white space; a word's bucket is the
    first eight hexadecimal digits of its MD5, modulo HASH_DIMENSIONS.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_vectors([t or "" for t in texts])))

    return embed(text)


@functools.lru_cache(maxsize=1 << 18)
def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % HASH_DIMENSIONS


def hashed_vectors(texts: list[str]) -> np.ndarray:
    """The vectors of the hashing embedder for ``texts``, a row each; words that come again are not hashed again."""
    counts = np.zeros((len(texts), HASH_DIMENSIONS))
    for row, text in zip(counts, texts, strict=True):
        found = [_bucket(word) for word in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if word]
        row += np.bincount(found, minlength=HASH_DIMENSIONS) if found else 0
    length = np.sqrt((counts * counts).sum(1))[:, None]  # squares of counts are whole, so their sum is exact
    return np.divide(counts, length, out=counts, where=length > 0)


def hashed_vector(text: str) -> list[float]:
    """The vector of the hashing embedder for one text."""
    return hashed_vectors([text])[0].tolist()


def embed_chunks(chunks: DataFrame, embed: Embedder = hashing_embedder, text: str = "text") -> DataFrame:
    """Adds dense_vector: null for a null or blank text."""
    return chunks.withColumn("dense_vector", F.when(stripped(F.col(text)) != "", embed(F.col(text))))


#: Modes, by what they add to a chunk.
MODES = {"DENSE_ONLY": ("dense",), "SPARSE_ONLY": ("sparse",), "HYBRID": ("dense", "sparse"), "ADVANCED": ("dense", "sparse", "late")}


def embed_by_mode(chunks: DataFrame, mode: str = "DENSE_ONLY", embed: Embedder = hashing_embedder, tokens: Embedder | None = None, normalise: bool = False, text: str = "text") -> DataFrame:
    """Adds what the mode asks for: dense_vector, sparse_vector (map of word to count), token_vectors (of ``tokens``); null for a null or blank text.

    ``normalise`` scales dense and token vectors to length 1.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    if "late" in MODES[mode] and tokens is None:
        raise ValueError(f"{mode} needs an embedder of tokens")
    scaled = l2_normalised if normalise else lambda v: v
    terms = words(F.lower(F.col(text)))
    counts = F.transform(F.array_distinct(terms), lambda w: F.struct(w, F.size(F.filter(terms, lambda x: x == w)).cast("double")))
    made = {"dense": ("dense_vector", lambda: scaled(embed(F.col(text)))), "sparse": ("sparse_vector", lambda: F.map_from_entries(counts)), "late": ("token_vectors", lambda: F.transform(tokens(F.col(text)), scaled))}
    return chunks.withColumns({made[m][0]: F.when(stripped(F.col(text)) != "", made[m][1]()) for m in MODES[mode]})


def embed_many(chunks: DataFrame, vector: Callable[[str], list[float]], text: str = "text", source: str = "source_id", seconds: float | None = None) -> Outcome:
    """``chunks`` with dense_vector by ``vector``, a plug-in of one text; null for a null or blank one.

    A chunk on which the plug-in raises, or takes over ``seconds``, is an error row of stage ``embedding``.
    """
    made = lambda t: None if not t or not t.strip(BLANKS) else [float(x) for x in vector(t)]
    return applied(chunks, made, text, "dense_vector", "array<double>", source, "embedding", seconds)


def embed_query(spark, query: str, embed: Embedder = hashing_embedder) -> list[float]:
    if not query or not query.strip():
        raise ValueError("a query must not be blank")
    return list(spark.range(1).select(embed(F.lit(query)).alias("v")).first()["v"])


def embedding_coverage(chunks: DataFrame, vector: str = "dense_vector") -> DataFrame:
    """Per source: chunk_count, embedded_count, status (failed, partial, complete) and message."""
    counted = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"), F.count_if(F.col(vector).isNotNull()).alias("embedded_count"))
    status = F.when(F.col("embedded_count") == 0, "failed").when(F.col("embedded_count") < F.col("chunk_count"), "partial").otherwise("complete")
    return counted.withColumns({"status": status, "message": F.concat(F.col("embedded_count"), F.lit("/"), F.col("chunk_count"), F.lit(" chunks embedded"))})


def sparse_terms(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sparse vectors as rows (key, term, weight): how often each word occurs."""
    tokens = texts.select(key, F.explode(words(F.lower(F.coalesce(text, F.lit(""))))).alias("term"))
    return tokens.groupBy(key, "term").agg(F.count("*").cast("double").alias("weight"))


def extractive_summary(text: Column, sentences: int = 2) -> Column:
    """The first sentences of a text."""
    return F.array_join(F.slice(F.split(stripped(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), 1, sentences), " ")
