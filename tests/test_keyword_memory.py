"""Keyword scores hold a bounded number of meetings of terms and queries, and blocks stay whole where batches end."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.operators import best, keyword_index


def _asked(rng, queries, terms, each):
    term = np.concatenate([rng.choice(terms, each, replace=False) for _ in range(queries)])
    return best.AskedTerms(np.repeat(np.arange(queries), each), term, rng.random(terms), np.ones(terms), queries), term.reshape(queries, each)


def test_scores_of_many_queries_fit_in_memory():
    rng = np.random.default_rng(2)
    terms, docs, held = 700, 40, 500
    asked, of_query = _asked(rng, 2000, terms, 150)
    term = np.concatenate([np.sort(rng.choice(terms, held, replace=False)) for _ in range(docs)])
    doc, weight = np.repeat(np.arange(docs), held), rng.random(docs * held)
    left, right = np.zeros((docs, terms)), np.zeros((terms, 2000))
    left[doc, term] = weight
    for q, t in enumerate(of_query):
        right[t, q] = asked.idf[t]
    tracemalloc.start()
    found = asked.scores(doc, term, weight, docs)
    peak = tracemalloc.get_traced_memory()[1]
    some = np.array([3, 4, 1500, 1999])
    tracemalloc.reset_peak()
    base = tracemalloc.get_traced_memory()[0]
    few = asked.scores(doc, term, weight, docs, some)
    peak_few = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert np.allclose(found, left @ right) and np.allclose(few, (left @ right)[:, some])
    assert peak < 100 << 20 and peak_few < 10 << 20


def test_scores_in_small_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    asked, _ = _asked(rng, 30, 300, 20)
    doc, term, weight = np.repeat(np.arange(10), 40), rng.integers(0, 300, 400), rng.random(400)
    whole = asked.scores(doc, term, weight, 10)
    monkeypatch.setattr(best, "MEETINGS", 3)
    assert np.allclose(asked.scores(doc, term, weight, 10), whole)
    assert np.allclose(asked.scores(doc, term, weight, 10, np.array([0, 7, 29])), whole[:, [0, 7, 29]])
    assert asked.scores(doc, term, weight, 10, np.zeros(0, np.int64)).shape == (10, 0)


def test_a_block_is_one_row_wherever_batches_end():
    block = [1, 1, 1, 2, 2, 5, 5, 5, 5, 6]
    batches = [pa.RecordBatch.from_arrays([pa.array(block[lo:hi], pa.int64()), pa.array(list(range(lo, hi)))], names=["block", "at"]) for lo, hi in ((0, 2), (2, 3), (3, 3), (3, 6), (6, 8), (8, 10))]
    found = [b.to_pydict() for b in keyword_index._whole_blocks(batches)]
    assert [x for b in found for x in b["at"]] == list(range(10))
    of = [set(b["block"]) for b in found]
    assert sum(map(len, of)) == 4
