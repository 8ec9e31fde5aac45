"""The vector index compares a bounded number of pairs at a time, whatever the number of queries."""

import tracemalloc

import numpy as np

from tessera.operators import vector_index
from tessera.operators.retrieval import RetrievalConfig


def test_many_queries_fit_in_memory(monkeypatch):
    rng = np.random.default_rng(4)
    x, asked = rng.normal(size=(2000, 16)), rng.normal(size=(4000, 16))
    names, of, own = np.array(range(2000), object), np.arange(4000), list(range(4000))

    def held():
        found = vector_index.Best(4000, RetrievalConfig(top_k=3))
        found.add(x, names, np.arange(2000), asked, of, own)
        return found.held

    tracemalloc.start()
    found = held()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20
    monkeypatch.setattr(vector_index, "HELD_PAIRS", 1 << 26)
    assert found == held()
