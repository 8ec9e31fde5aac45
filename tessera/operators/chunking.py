"""Splitting source texts into chunks: ``sources (source_id, content, ...)`` to one row a chunk.

Every chunker returns chunk_id, source_id, pos, start_index, end_index,
token_count, text. A null or blank content gives no chunk. Chunking is local to
a row; nothing is shuffled. ``chunk_many`` keeps a row that fails apart from its
neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import BLANKS
from tessera.operators.embedding import hashed_vectors
from tessera.operators.isolation import Outcome, describe, quarantine
from tessera.session import share_code

CHARS_PER_TOKEN = 4
CHARS_PER_PAGE = 3000
CHUNK_DDL = "source_id long, pos int, start_index int, end_index int, token_count int, text string"

#: A plug-in: texts of sentences to one vector each.
SentenceEmbedder = Callable[[list[str]], "list[list[float]] | np.ndarray"]


def hashed_sentences(texts: list[str]) -> np.ndarray:
    """The hashing embedder for each text."""
    return hashed_vectors(texts)


@dataclass(frozen=True)
class ChunkerConfig:
    chunk_size: int = 512
    chunk_overlap: int = 128
    similarity_threshold: float = 0.8
    min_sentences: int = 3
    similarity_window: int = 4
    embed: SentenceEmbedder = hashed_sentences

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be positive and chunk_overlap not negative")
        if self.min_sentences < 1 or self.similarity_window < 1:
            raise ValueError("min_sentences and similarity_window must be positive")


Span = tuple[int, int, int, str]  # start, end, tokens, text


def fixed_spans(text: str, config: ChunkerConfig) -> Iterator[Span]:
    """Windows of ``chunk_size`` tokens of 4 characters, ended at the last blank inside; each starts before the end of the last by the overlap, and always further on."""
    window, overlap = config.chunk_size * CHARS_PER_TOKEN, config.chunk_overlap * CHARS_PER_TOKEN
    start, size = 0, len(text)
    while start < size:
        end = min(start + window, size)
        if end < size and (blank := text.rfind(" ", start, end)) > start:
            end = blank
        if body := text[start:end].strip():
            yield start, end, max(1, len(body) // CHARS_PER_TOKEN), body
        if end == size:
            return
        start = max(end - overlap, start + 1)


_sentence = re.compile(r"\S.*?(?:[.!?]+(?=\s)|\n|\Z)", re.S)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences: up to end marks before white space, or a line's end."""
    return [(m.start(), m.start() + len(m[0].rstrip())) for m in _sentence.finditer(text)]


def sentence_spans(text: str, config: ChunkerConfig) -> Iterator[Span]:
    """Whole sentences, as many as ``chunk_size`` words hold; the last ones repeat while they fit the overlap."""
    found = [(a, b, len(text[a:b].split())) for a, b in sentences(text)]
    at = 0
    while at < len(found):
        to, total = at, 0
        while to < len(found) and (to == at or total + found[to][2] <= config.chunk_size):
            total += found[to][2]
            to += 1
        yield found[at][0], found[to - 1][1], max(1, total), text[found[at][0] : found[to - 1][1]]
        if to == len(found):
            return
        back, again = to, 0
        while back - 1 > at and again + found[back - 1][2] <= config.chunk_overlap:
            back -= 1
            again += found[back][2]
        at = back


def semantic_spans(text: str, config: ChunkerConfig) -> Iterator[Span]:
    """Sentences that go on with what the ``similarity_window`` sentences before them say.

    A sentence is compared with the mean vector of up to ``similarity_window`` sentences right before it,
    whatever chunk they are in. It begins a new chunk if that cosine (0 for a vector of length 0) is below
    the threshold and ``min_sentences`` have come since the last cut, or if with it the
    chunk would hold more than ``chunk_size`` words.
    """
    found = sentences(text)
    if not found:
        return
    vectors = np.asarray(config.embed([text[a:b] for a, b in found]), float).reshape(len(found), -1)
    first, held = 0, 0
    for i, (a, b) in enumerate(found):
        size = len(text[a:b].split())
        if i > first:
            cut = held + size > config.chunk_size
            if not cut and i - first >= config.min_sentences:  # only here does the likeness decide
                before = vectors[max(0, i - config.similarity_window) : i].mean(0)
                length = np.linalg.norm(before) * np.linalg.norm(vectors[i])
                cut = (float(before @ vectors[i] / length) if length else 0.0) < config.similarity_threshold
            if cut:
                yield found[first][0], found[i - 1][1], max(1, held), text[found[first][0] : found[i - 1][1]]
                first, held = i, 0
        held += size
    yield found[first][0], found[-1][1], max(1, held), text[found[first][0] : found[-1][1]]


Spans = Callable[[str, ChunkerConfig], Iterator[Span]]


def _spread(sources: DataFrame, spans: Spans, config: ChunkerConfig, isolate: bool = False) -> DataFrame:
    """One row a chunk; with ``isolate`` a source on which ``spans`` raises is one row with its error, and all rows have that column."""
    share_code(sources.sparkSession)
    ddl = CHUNK_DDL + (", error string" if isolate else "")
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *([pa.string()] if isolate else [])]
    more = (None,) if isolate else ()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += [(source, pos, *span, *more) for pos, span in enumerate(list(spans(content.as_py() or "", config)))]
                except Exception as error:
                    if not isolate:
                        raise
                    rows.append((source, None, None, None, None, None, describe(error)))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    chunks = sources.select(F.col("source_id").cast("long"), "content").mapInArrow(run, ddl)
    return chunks.withColumn("chunk_id", F.concat_ws("-", "source_id", "pos"))


def chunk_fixed(sources: DataFrame, config: ChunkerConfig | None = None) -> DataFrame:
    return _spread(sources, fixed_spans, config or ChunkerConfig())


def chunk_sentence(sources: DataFrame, config: ChunkerConfig | None = None) -> DataFrame:
    return _spread(sources, sentence_spans, config or ChunkerConfig())


def chunk_token(sources: DataFrame, config: ChunkerConfig | None = None) -> DataFrame:
    """Windows of ``chunk_size`` words, each ``chunk_size - chunk_overlap`` after the last, in built-in functions.

    start_index and end_index count words here; the text is the words joined by blanks.
    """
    config = config or ChunkerConfig()
    step = max(1, config.chunk_size - config.chunk_overlap)
    split = sources.select(F.col("source_id").cast("long").alias("source_id"), F.filter(F.split(F.coalesce("content", F.lit("")), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "").alias("w"))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - config.chunk_size) / step)).cast("int")
    # Each chunk carries its own words, never the whole text's.
    slices = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("w", k * step + 1, F.lit(config.chunk_size)))
    # A text without a word has one empty slice. A filter on the words themselves would be pushed below what made the text, and make it twice.
    chunks = split.select("source_id", F.posexplode(slices).alias("pos", "own")).filter(F.size("own") > 0)
    start = F.col("pos") * step
    return chunks.select(
        F.concat_ws("-", "source_id", "pos").alias("chunk_id"),
        "source_id",
        "pos",
        start.alias("start_index"),
        (start + F.size("own")).alias("end_index"),
        F.size("own").alias("token_count"),
        F.array_join("own", " ").alias("text"),
    )


def chunk_semantic(sources: DataFrame, config: ChunkerConfig | None = None) -> DataFrame:
    """Sentences grouped while each is like those before it; see ``semantic_spans``."""
    return _spread(sources, semantic_spans, config or ChunkerConfig())


#: The chunkers by name, and the plug-ins among them that can fail on a row.
CHUNKERS = {"fixed": chunk_fixed, "token": chunk_token, "sentence": chunk_sentence, "semantic": chunk_semantic}
_spans: dict[str, Spans] = {"fixed": fixed_spans, "sentence": sentence_spans, "semantic": semantic_spans}


def register_chunker(name: str) -> Callable[[Spans], Spans]:
    """Make a function of (text, config) that gives (start, end, tokens, text) of chunks available by name."""

    def add(spans: Spans) -> Spans:
        _spans[name] = spans
        CHUNKERS[name] = lambda sources, config=None: _spread(sources, spans, config or ChunkerConfig())
        return spans

    return add


def chunk_sources(sources: DataFrame, chunker: str, config: ChunkerConfig | None = None) -> DataFrame:
    if chunker not in CHUNKERS:
        raise ValueError(f"chunker must be one of {sorted(CHUNKERS)}")
    return CHUNKERS[chunker](sources, config)


def chunk_many(sources: DataFrame, chunker: str, config: ChunkerConfig | None = None) -> Outcome:
    """Chunks of ``sources``, and an error row of stage ``chunking`` for each source on which the chunker raised.

    A chunker that is not registered leaves the sources as they are, with an error row for each.
    """
    if chunker not in CHUNKERS:
        errors = sources.select(F.col("source_id").cast("string").alias("source"), F.lit("chunking").alias("stage"), F.lit(f"no chunker {chunker}").alias("error"))
        return Outcome(sources, errors)
    if chunker not in _spans:  # built-in functions only
        return quarantine(CHUNKERS[chunker](sources, config).withColumn("error", F.lit(None).cast("string")), "source_id", "chunking")
    return quarantine(_spread(sources, _spans[chunker], config or ChunkerConfig(), isolate=True), "source_id", "chunking")


def chunk_stats(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_count, total_tokens) of every source, 0 where it has no chunk."""
    found = chunks.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    return sources.select("source_id").join(found, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("chunk_count"), F.coalesce("t", F.lit(0)).alias("total_tokens"))


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``valid``: start not negative, end after start, some token."""
    fine = (F.col("start_index") >= 0) & (F.col("end_index") > F.col("start_index")) & (F.col("token_count") > 0)
    return chunks.withColumn("valid", F.coalesce(fine, F.lit(False)))


def page_count(text: Column) -> Column:
    """Estimated pages of a text column, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / CHARS_PER_PAGE)).cast("int")


def is_blank(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)) == ""
