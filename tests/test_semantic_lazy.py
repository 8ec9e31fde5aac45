"""A likeness is worked out only where it decides on a cut."""

import numpy as np

from tessera.operators import chunking


def test_likeness_only_where_it_decides(monkeypatch):
    norm, calls = np.linalg.norm, []
    monkeypatch.setattr(chunking.np.linalg, "norm", lambda *a, **k: calls.append(1) or norm(*a, **k))
    text = " ".join(f"word{i} other{i}." for i in range(30))
    spans = list(chunking.semantic_spans(text, chunking.ChunkerConfig()))
    assert "".join(s[3] for s in spans).replace(" ", "") == text.replace(" ", "")
    assert 0 < len(calls) < 2 * 29  # two for each sentence after the first before


def test_vectors_of_texts_together_are_those_of_each():
    from tessera.operators.embedding import hashed_vector, hashed_vectors

    texts = ["", "a b A", "x\ty\x0bz x", "é \udcff q"]
    assert [v.tolist() for v in hashed_vectors(texts)] == [hashed_vector(t) for t in texts]
    assert hashed_vector("a a b")[:0] == [] and abs(sum(x * x for x in hashed_vector("a a b")) - 1) < 1e-12
