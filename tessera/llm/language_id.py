"""Language identification with hyperdimensional profiles (operator 10).

Every letter has a random bipolar vector. An n-gram's vector binds (multiplies)
the vectors of its letters, each permuted (rotated) by its place; a text's
vector bundles (sums) those of its n-grams, and a language's prototype bundles
the normalised vectors of its learning texts. The prediction is the prototype of
largest cosine. Letter vectors come from a hash of the letter, so no alphabet is
fixed and every worker makes the same ones.

Operator 10 learns from a bounded sample: of each language about ``per_language`` learning
rows, those whose id hash lies below the share that gives so many; the pipeline's stage learns from all. Prototypes are one vector a language, gathered to the
driver and sent with the tasks: languages x dimensions x 4 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_draw, identified, matching, prepare, settled, text_batches

DIMENSIONS = 1024
PER_LANGUAGE = 600
#: Fixed value: the name of no language.
UNDETERMINED = "und"
NGRAM = 3
_SLICE = 64
_GAP = ord(" ")


class Profiler:
    """Hypervectors of texts; ``dimensions`` and the letter hash are its only parameters."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self._letters: dict[int, np.ndarray] = {}
        self._class = np.full(0x110000, -1, np.int32)  # code point -> lower-cased letter, or a gap
        self._grams: dict[int, np.ndarray] = {}

    def _letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            bits = np.random.Generator(np.random.PCG64(zlib.crc32(b"letter %d" % code))).integers(0, 2, self.dimensions, dtype=np.int8)
            self._letters[code] = 2 * bits - 1
        return self._letters[code]

    def _gram(self, key: int) -> np.ndarray:
        """Bound vector of three letters packed in 21 bits each."""
        got = self._grams.get(key)
        if got is None:
            if len(self._grams) > 20_000:
                self._grams.clear()
            a, b, c = (self._letter(key >> shift & 0x1FFFFF) for shift in (42, 21, 0))
            got = self._grams[key] = (np.roll(a, 2) * np.roll(b, 1) * c)
        return got

    def _codes(self, text: str) -> np.ndarray:
        """Lower-cased letters of a text; every run of anything else is one gap."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        known = self._class[codes]
        if (known < 0).any():
            for code in np.unique(codes[known < 0]).tolist():
                low = chr(code).lower()[:1]
                self._class[code] = ord(low) if low.isalpha() else _GAP
            known = self._class[codes]
        gap = known == _GAP
        return known[~(gap & np.concatenate(([True], gap[:-1])))]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the words, edges included, and how often each occurs."""
        codes = self._codes(text or "")
        if not (codes != _GAP).any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.concatenate(([_GAP], codes, [_GAP])).astype(np.int64)
        return np.unique((padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:], return_counts=True)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """Bundled vectors, float32, of length 1, or 0 for a text without a letter."""
        each = [self.counts(t) for t in texts]
        keys = np.unique(np.concatenate([k for k, _ in each])) if each else np.empty(0, np.int64)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            grams = np.stack([self._gram(int(k)) for k in part]).astype(np.float32)
            weights = np.zeros((len(texts), len(part)), np.float32)
            for row, (k, n) in enumerate(each):
                lo, hi = np.searchsorted(k, (part[0], part[-1] + 1))
                weights[row, np.searchsorted(part, k[lo:hi])] = n[lo:hi]
            out += weights @ grams
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0)


_profilers: dict[int, Profiler] = {}


def profiler(dimensions: int) -> Profiler:
    if dimensions not in _profilers:
        _profilers[dimensions] = Profiler(dimensions)
    return _profilers[dimensions]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id is never held out and never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _drawn(docs: DataFrame, per_language: int | None, held: bool) -> DataFrame | None:
    """``(doc_id, lang, text)``: about ``per_language`` rows of each language, or all, held out or not; None if there is none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (held_out(F.col("doc_id")) == held))
    if per_language is None:
        known = known.filter(F.col("text").isNotNull())
        return None if known.isEmpty() else known
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["count"])])  # one entry a language
    return known.filter(F.col("text").isNotNull() & (hash_draw("doc_id") < F.element_at(share, F.col("lang"))))


def learn(docs: DataFrame, per_language: int | None = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from ``docs (doc_id, text, lang)``.

    Only rows with an id, a text and a language whose id is not held out teach,
    and of those about ``per_language`` of each language (id hash below their share), or all if it is None.
    """
    prepare(docs)
    sample = _drawn(docs, per_language, False)
    if sample is None:
        return [], np.zeros((0, dimensions), np.float32)

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        made = profiler(dimensions)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at in range(0, len(langs), _SLICE):
                vectors = made.vectors(batch.column("text").slice(at, _SLICE).to_pylist())
                for lang, vector in zip(langs[at : at + _SLICE], vectors, strict=True):
                    sums[lang] = sums.get(lang, 0.0) + vector.astype(np.float64)
        for lang, total in sums.items():
            yield pa.record_batch([pa.array([lang]), pa.array([total.tobytes()])], names=["lang", "total"])

    found: dict[str, np.ndarray] = {}
    with text_batches(docs.sparkSession):
        rows = sample.select("lang", "text").mapInArrow(bundle, "lang string, total binary").collect()
    for lang, total in sorted((r["lang"], bytes(r["total"])) for r in rows):
        found[lang] = found.get(lang, 0.0) + np.frombuffer(total)
    names = sorted(x for x in found if np.linalg.norm(found[x]) > 0)
    if not names:
        return [], np.zeros((0, dimensions), np.float32)
    prototypes = np.stack([found[x] for x in names])
    return names, (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).astype(np.float32)


def classify(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted languages and cosines, 0 to 1; ties go to the first name in order."""
    if not names:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    vectors = profiler(prototypes.shape[1]).vectors(texts)
    cosines = vectors @ prototypes.T
    best = cosines.argmax(1)
    known = vectors.any(1)
    scores = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
    return [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], scores


def predictor(names: list[str], prototypes: np.ndarray):
    """A column function: text -> struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs: list[str] = []
            scores: list[float] = []
            for at in range(0, len(part), _SLICE):
                got, score = classify(list(part.iloc[at : at + _SLICE]), names, prototypes)
                langs += got
                scores += score.tolist()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> DataFrame:
    """Per row of ``docs (doc_id, text, lang, ...)``: doc_id, held_out, lang_pred, score.

    A null text or one without a letter is ``und`` with score 0, as is every
    text when nothing can be learned. Repeated rows stay repeated; other columns
    are ignored. An empty table gives no rows.
    """
    predict = predictor(*learn(docs, per_language, dimensions))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


#: Ends of the classes of letters that have a threshold each, and texts a class needs for one.
LETTER_CLASSES = (16, 64, 256, 1024)
LEAST_TEXTS = 30
#: Steps that scores from 0 to 1 are counted in.
_STEPS = 1000


def thresholds(docs: DataFrame, names: list[str], prototypes: np.ndarray, per_language: int | None = PER_LANGUAGE, own_loss: float = 0.001, foreign_loss: float = 0.99) -> tuple[list[float], list[dict]]:
    """Least scores by class of letters, and what they rest on: per class texts, threshold, and shares rejected of both kinds.

    About ``per_language`` held-out texts of each language, or all of them, are scored twice: against all
    prototypes, and against those of other languages, as if theirs had never been learned. The threshold
    rejects ``foreign_loss`` of the second scores but never more than ``own_loss`` of
    the first. It is 0 in a class of fewer than ``LEAST_TEXTS`` texts, and where a single language is known.
    """
    sample = _drawn(docs, per_language, True)
    nothing = [0.0] * (len(LETTER_CLASSES) + 1)
    if sample is None or len(names) < 2:
        return nothing, []

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = profiler(prototypes.shape[1])
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                cosines = made.vectors(texts) @ prototypes.T
                others = cosines.copy()
                for row, lang in enumerate(langs):
                    if lang in names:
                        others[row, names.index(lang)] = -1
                letters = [letter_count(t) for t in texts]
                yield pa.record_batch([pa.array(letters, pa.int64()), pa.array(cosines.max(1).astype(float)), pa.array(others.max(1).astype(float))], names=["letters", "own", "foreign"])

    found = sample.select("lang", "text").mapInArrow(score, "letters long, own double, foreign double").filter("letters > 0")
    of = sum((F.when(F.col("letters") >= end, 1).otherwise(0) for end in LETTER_CLASSES), F.lit(0)).alias("of")
    steps = lambda x: F.floor(F.greatest(F.col(x), F.lit(0.0)) * _STEPS).cast("int").alias("at")
    both = F.array(*[F.struct(F.lit(x).alias("kind"), steps(x)) for x in ("own", "foreign")])  # each text is scored once
    counted = found.select(of, F.explode(both).alias("x")).select("of", "x.kind", "x.at")
    held = np.zeros((len(nothing), 2, _STEPS + 1), np.int64)
    with text_batches(docs.sparkSession):
        rows = counted.groupBy("of", "kind", "at").count().collect()  # at most classes x 2 x steps rows
    for r in rows:
        held[r["of"], int(r["kind"] == "foreign"), min(r["at"], _STEPS)] = r["count"]
    least, facts = nothing, []
    for k, (own, foreign) in enumerate(held):
        if own.sum() >= LEAST_TEXTS:
            below = lambda counts: np.concatenate(([0], np.cumsum(counts)[:-1])) / counts.sum()  # noqa: E731  share of texts under each step
            step = min(int(np.flatnonzero(below(own) <= own_loss)[-1]), int(np.flatnonzero(below(foreign) >= foreign_loss)[0]) if (below(foreign) >= foreign_loss).any() else _STEPS)
            least[k] = step / _STEPS
            facts.append({"letters_from": (0, *LETTER_CLASSES)[k], "texts": int(own.sum()), "least_score": least[k], "own_rejected": float(below(own)[step]), "foreign_rejected": float(below(foreign)[step])})
    return least, facts


def letter_count(text: str | None) -> int:
    return sum(map(str.isalpha, text or ""))


def keep_identified(docs: DataFrame, per_language: int | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` without rows that are undetermined or resemble no learned language; all columns are kept.

    A text resembles none if its best cosine is below the threshold of its class
    of letters (``thresholds``). Prototypes and thresholds come from all rows, unless ``per_language`` bounds them. Null texts and texts without a letter are
    undetermined. Where nothing could be learned (no row with an id, a text and a language), all rows stay. Repeated rows
    stay repeated, a null doc_id changes nothing, an empty table stays empty, and
    columns may have any names.
    """
    names, prototypes = learn(docs, per_language, dimensions)
    if not names:
        return docs
    least, _ = thresholds(docs, names, prototypes, per_language)

    @F.pandas_udf("boolean")
    def known(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            kept: list[bool] = []
            for at in range(0, len(part), _SLICE):
                texts = list(part.iloc[at : at + _SLICE])
                langs, scores = classify(texts, names, prototypes)
                of = np.searchsorted(LETTER_CLASSES, [letter_count(t) for t in texts], side="right")
                kept += [lang != UNDETERMINED and score >= least[k] for lang, score, k in zip(langs, scores, of, strict=True)]
            yield pd.Series(kept)

    docs, row = identified(docs)
    with text_batches(docs.sparkSession):  # only ids and verdicts leave the tasks; the rows themselves stay where they are
        dropped = settled(lambda: docs.select(*row, known(F.col("text")).alias("known")).filter("not known").select(*row), "unidentified")
    return matching(docs, dropped, row, "left_anti").drop(*row)
