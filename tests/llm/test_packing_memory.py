"""The packing stage bounds what its encoder remembers."""

import corpus_pipeline
from tessera.llm import bpe


def test_fewer_words_are_remembered_where_asked():
    encoder = bpe.Encoder(bpe.default_path(), remembered=100)
    for at in range(40):
        encoder.encode([" ".join(f"w{i}x" for i in range(50 * at, 50 * at + 50))])
        assert len(encoder.memo) + len(encoder.aged) <= 100 + 2 * 52


def test_the_packing_stage_asks_for_it(monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, **options: seen.append(options))
    corpus_pipeline.packing(None, None, "")
    assert seen[0]["remembered"] < bpe.MEMO_ENTRIES
