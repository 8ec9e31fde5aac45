"""Texts cut by lone blanks and line feeds are encoded as columns, with the ids of the library's plain call."""

import numpy as np
import pyarrow as pa

from tessera.llm import bpe


def test_even_texts_are_not_cut_one_by_one(monkeypatch):
    from tokenizers import Tokenizer

    texts = ["one two, three.", None, "", "é\nà über;", " led", "ends ", "\nx", "a" * 50 + " b"] * 40
    tokenizer = Tokenizer.from_file(bpe.default_path())
    wanted = [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 100)

    def refused(text):
        raise AssertionError(text)

    monkeypatch.setattr(bpe, "pieces", refused)
    bpe.encoder.cache_clear()
    assert list(bpe.encoded(pa.array(texts).slice(3), bpe.default_path(), remembered=4)) == wanted[3:]
    assert list(bpe.encoded(pa.array(texts, pa.large_string()), bpe.default_path())) == wanted
