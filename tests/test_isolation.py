"""Plug-ins that raise, hang or die on one row, and the semantic chunker against a plain version."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, embedding
from tessera.operators.isolation import Guard
from tessera.operators.late_interaction import hashing_tokens
from tessera.sources import files


def bad_on(word):
    def spans(text, config):
        for k, part in enumerate(text.split(",")):
            if part == word:
                raise KeyError(part)
            yield k, k + 1, 1, part

    return spans


def test_one_bad_source_does_not_fail_the_others(spark):
    chunking.register_chunker("commas")(bad_on("bad"))
    try:
        sources = spark.createDataFrame([(1, "a,b"), (2, "c,bad,d"), (3, None), (4, "e")], "source_id long, content string").coalesce(1)
        found = chunking.chunk_many(sources, "commas")
        assert sorted((r.source_id, r.pos, r.text) for r in found.rows.collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, ""), (4, 0, "e")]
        assert [tuple(r) for r in found.errors.collect()] == [("2", "chunking", "KeyError: 'bad'")]
        with pytest.raises(Exception, match="bad"):
            chunking.chunk_sources(sources, "commas").collect()
    finally:
        del chunking.CHUNKERS["commas"], chunking._spans["commas"]
    for name in ("fixed", "token", "semantic"):
        assert chunking.chunk_many(sources, name).errors.count() == 0 and chunking.chunk_many(sources, name).rows.count() == 3
    left = chunking.chunk_many(sources, "none")
    assert left.rows.collect() == sources.collect() and left.errors.count() == 4


def test_one_bad_text_does_not_fail_the_others(spark):
    def vector(text):
        return [1.0, 1 / (len(text) - 3)]

    chunks = spark.createDataFrame([("s", "four"), ("s", "abc"), ("t", None), ("u", " "), ("v", "fifty")], "source_id string, text string").coalesce(1)
    found = embedding.embed_many(chunks, vector)
    assert {(r.text, tuple(r.dense_vector or ())) for r in found.rows.collect()} == {("four", (1.0, 1.0)), (None, ()), (" ", ()), ("fifty", (1.0, 0.5))}
    assert [tuple(r) for r in found.errors.collect()] == [("s", "embedding", "ZeroDivisionError: division by zero")]


def a_parser():
    def parse(text):
        if text == "hang":
            while True:
                pass
        if text == "sleep":
            time.sleep(60)
        if text == "die":
            os._exit(3)
        if text == "raise":
            raise ValueError("no")
        return (text or "nothing").upper()

    return parse


parse = a_parser()  # made in a function, so that workers need no module of tests


def test_parsers_that_hang_die_or_raise(spark):
    rows = [(i, t) for i, t in enumerate(["a", "hang", "b", "die", "raise", "sleep", None, "c"])]
    sources = spark.createDataFrame(rows, "source_id long, content string").coalesce(1)
    begun = time.time()
    found = files.parse_many(sources, parse, seconds=1)
    assert {r.source_id: r.parsed for r in found.rows.collect()} == {0: "A", 2: "B", 6: "NOTHING", 7: "C"}
    errors = {r.source: r.error for r in found.errors.collect()}
    assert errors == {"1": "TimeoutError: no result after 1 seconds", "3": "the process of the plug-in ended", "4": "ValueError: no", "5": "TimeoutError: no result after 1 seconds"}
    assert time.time() - begun < 40


def test_a_timed_parser_gives_way_to_the_next(spark):
    files.register_parser("plugged", "text/html")(files.timed_parser(parse, 1))
    try:
        rows = spark.createDataFrame([("text/html", "hang"), ("text/html", "<p>y</p>")], "media_type string, content string").coalesce(1)
        found = files.parse_with_fallback(rows, "plugged", ("html",)).collect()
        assert [(r.parsed, r.parser_used) for r in found] == [("hang", "html"), ("<P>Y</P>", "plugged")]
    finally:
        del files._parsers["plugged"]


def test_guard_in_this_process():
    guard = Guard(parse, 0.5)
    assert [guard(x) for x in ("a", "sleep", "b")] == [("A", None), (None, "TimeoutError: no result after 0.5 seconds"), ("B", None)]
    guard.close()
    assert Guard(parse)("raise") == (None, "ValueError: no")


def plain_semantic(vectors, sizes, threshold, window, least, most):
    """Sentences that begin a chunk."""
    starts, held = [0], sizes[0]
    for i in range(1, len(vectors)):
        before = [sum(v[k] for v in vectors[max(0, i - window) : i]) for k in range(len(vectors[i]))]
        dot = sum(a * b for a, b in zip(before, vectors[i]))
        norms = sum(a * a for a in before) ** 0.5 * sum(b * b for b in vectors[i]) ** 0.5
        apart = (dot / norms if norms else 0) < threshold and i - starts[-1] >= least
        if apart or held + sizes[i] > most:
            starts.append(i)
            held = 0
        held += sizes[i]
    return starts


@pytest.mark.parametrize(("threshold", "window", "least", "most"), [(0.6, 4, 3, 512), (0.9, 1, 1, 512), (0.7, 2, 2, 9), (0.0, 4, 3, 512)])
def test_semantic_chunks(spark, threshold, window, least, most):
    rng = random.Random(window)
    topics = [["river", "stone", "water"], ["bread", "oven", "flour"], ["train", "rail", "north"]]
    said = [[" ".join(rng.choice(topics[(i // 5) % 3]) for _ in range(rng.randint(1, 5))) for i in range(rng.randint(1, 30))] for _ in range(6)]
    rows = [(k, " ".join(f"{s}." for s in x)) for k, x in enumerate(said)]
    config = chunking.ChunkerConfig(chunk_size=most, similarity_threshold=threshold, similarity_window=window, min_sentences=least)
    found = chunking.chunk_sources(spark.createDataFrame(rows, "source_id long, content string"), "semantic", config).orderBy("source_id", "pos").collect()
    for k, x in enumerate(said):
        vectors = [embedding.hashed_vector(f"{s}.") for s in x]
        starts = plain_semantic(vectors, [len(s.split()) for s in x], threshold, window, least, most)
        wanted = [" ".join(f"{s}." for s in x[a:b]) for a, b in zip(starts, [*starts[1:], len(x)])]
        own = [r for r in found if r.source_id == k]
        assert [r.text for r in own] == wanted and [rows[k][1][r.start_index : r.end_index] for r in own] == wanted
        assert [r.token_count for r in own] == [len(t.split()) for t in wanted]


def test_modes(spark):
    chunks = spark.createDataFrame([("One two one",), (" ",), (None,)], "text string")
    found = embedding.embed_by_mode(chunks, "ADVANCED", tokens=hashing_tokens, normalise=True).collect()
    assert found[0].sparse_vector == {"one": 2.0, "two": 1.0} and len(found[0].token_vectors) == 2 and abs(np.linalg.norm(found[0].dense_vector) - 1) < 1e-9
    assert all(r[c] is None for r in found[1:] for c in ("dense_vector", "sparse_vector", "token_vectors"))
    assert embedding.embed_by_mode(chunks, "SPARSE_ONLY").columns == ["text", "sparse_vector"]
    doubled = lambda c: F.transform(embedding.hashing_embedder(c), lambda x: 2 * x)
    assert abs(np.linalg.norm(embedding.embed_by_mode(chunks, embed=doubled).first().dense_vector) - 2) < 1e-9
    with pytest.raises(ValueError, match="mode"):
        embedding.embed_by_mode(chunks, "ALL")
    with pytest.raises(ValueError, match="tokens"):
        embedding.embed_by_mode(chunks, "ADVANCED")
