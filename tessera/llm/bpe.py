"""Byte-level BPE through the tokenizers library, with the work of repeated words saved.

The tokenizer's pre-splitting never joins characters across the start of a
white-space run that follows other characters. A text can therefore be cut
there, and each piece encoded once and remembered: the ids are those of the
whole text. Texts with white space other than blank and line feed are encoded
as a whole, as are texts that hold an added token of the vocabulary, such as an
end mark: it becomes its own id, as in the library's plain call. New words of some texts are encoded as one text and cut apart again,
which must agree with the tokens' lengths, or they are encoded one by one. Memory
is bounded: the memo holds two generations of pieces.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces longer than this, such as base64 blobs, are not remembered.
LONGEST_REMEMBERED = 40
MEMO_ENTRIES = 800_000
#: New words that are encoded as one text.
JOINED_WORDS = 4096

#: White space other than blank and line feed; none lies beyond U+3000.
_ODD = "".join(x for x in map(chr, range(0x3001)) if x.isspace() and x not in " \n")
_odd_space = re.compile(f"[{_ODD}]")
_word = re.compile(r"[ \n][^\s]{1,40}\Z").match
#: A word of Latin letters with marks after it, which never become one token.
_marked = re.compile(r"([ \n][A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]{1,40})([.,;:!?*#$%&+=|()\"-]+)\Z").match
_pieces = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str) -> list[str]:
    """``text`` in pieces that encode on their own; they join to ``text``."""
    if _odd_space.search(text):
        return [text]
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return _pieces.findall(text)
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = MEMO_ENTRIES) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        #: What sets a text apart: white space that does not cut, runs of white space, added tokens.
        self.apart = "|".join([f"[{_ODD}]", r"[ \n][ \n]", *map(re.escape, filter(None, added))])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.largest_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        # A byte-level token is written with one character for each of its bytes.
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.memo: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that each start with a white-space character and hold no other: encoded as one text, then cut."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in words])
        cuts = np.searchsorted(ends, wanted, side="right")
        if not len(ids) or not (ends[cuts - 1] == wanted).all():
            return self._ids(words)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    def _known(self, found: list[str], whole: set[str] = frozenset()) -> list[bytes]:
        """Ids of different pieces; what was not used for a whole generation is forgotten."""
        if len(self.memo) > self.remembered // 2:
            self.memo, self.aged = {}, self.memo
        memo, aged = self.memo, self.aged
        memo[""] = b""
        out = list(map(memo.get, found))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if not missing:
            return out
        words, marked, others = set(), [], []
        for x in map(found.__getitem__, missing):
            if (known := aged.get(x)) is not None:
                memo[x] = known
            elif x in whole:
                others.append(x)
            elif cut := _marked(x):
                marked.append((x, *cut.groups()))
            elif _word(x):
                words.add(x)
            else:
                others.append(x)
        for _, word, marks in marked:
            for x in (word, marks):
                if x not in memo:
                    if (known := aged.get(x)) is not None:
                        memo[x] = known
                    elif x is word:
                        words.add(x)
                    else:
                        memo[x] = self._ids([x])[0]
        new = list(words)
        for lo in range(0, len(new), JOINED_WORDS):
            part = new[lo : lo + JOINED_WORDS]
            memo.update(zip(part, self._ids_of_words(part), strict=True))
        memo.update((x, memo[word] + memo[marks]) for x, word, marks in marked)
        if others:
            memo.update(zip(others, self._ids(others), strict=True))
        for i in missing:
            out[i] = memo[found[i]]
        for x in others:
            if len(x) > LONGEST_REMEMBERED:
                del memo[x]
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of every text. Texts that only lone blanks and line feeds cut are cut and put together as columns, others one by one."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        apart = pc.match_substring_regex(column, self.apart).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)
        if not apart.all():
            even = np.flatnonzero(~apart)
            listed = pc.split_pattern(pc.replace_substring(pc.replace_substring(column.take(pa.array(even)), " ", "\x1f "), "\n", "\x1f\n"), "\x1f")
            coded = listed.flatten().dictionary_encode()
            known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            joined = pa.array(known, pa.large_binary()).take(coded.indices)
            _, ends, raw = joined.buffers()
            raw = raw.to_pybytes()
            bounds = np.frombuffer(ends, np.int64)[listed.offsets.to_numpy()].tolist()
            for i, lo, hi in zip(even.tolist(), bounds, bounds[1:], strict=False):
                out[i] = raw[lo:hi]
        if apart.any():
            rows = np.flatnonzero(apart).tolist()
            found = [column[i].as_py() for i in rows]
            whole = {text for text in found if self.added(text)}  # no piece of another text holds an added token
            parts = [[text] if text in whole else pieces(text) for text in found]
            listed = list(set().union(*parts))
            ids = dict(zip(listed, self._known(listed, whole), strict=True))
            for i, p in zip(rows, parts, strict=True):
                out[i] = b"".join(map(ids.__getitem__, p))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


#: Rows, and bytes of text, that are encoded at a time; a longer text alone.
SLICE_ROWS = 512
SLICE_BYTES = 1 << 20


def encoded(texts: pa.Array, path: str, remembered: int = MEMO_ENTRIES) -> Iterator[bytes]:
    """Id bytes of an Arrow string column, some rows at a time; null counts as empty. Fewer ``remembered`` pieces take less memory and more time."""
    enc = encoder(path)
    enc.remembered = remembered
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        limit = SLICE_BYTES + (ends[at - 1] if at else 0)
        rows = min(max(1, int(np.searchsorted(ends, limit, side="right")) - at), SLICE_ROWS)
        yield from enc.encode(texts.slice(at, rows))
        at += rows
