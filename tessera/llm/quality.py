"""Quality scores by attention-based multiple-instance learning (operator 12).

A document is a bag of passages, its label belongs to the bag. Every passage of
``PASSAGE`` code points is encoded from its shape alone, so that no language or
vocabulary is fixed: how often pairs of character classes stand side by side, and
how much of it repeats. A learned layer turns the encoding into a
representation h; gated attention gives each passage the weight
softmax(w . (tanh(V h) * sigmoid(U h))) within its document, and the weighted sum of
all h is scored. All weights are learned together from document labels.

Scoring reads whole texts, some thousand passages at a time: the softmax is carried
with a running maximum, so memory does not follow a text's length. Fitting uses a
bounded sample: at most ``FIT_DOCS`` labelled documents, none longer than ``FIT_CHARS``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_draw, prepare, written

PASSAGE = 512
PAIRS = 128
REPEATS = (4, 12, 48)
FEATURES = PAIRS + len(REPEATS) + 1
#: Bounds of the sample that weights are learned from.
FIT_DOCS = 4000
FIT_CHARS = 50_000
_SLICE = 2048
_ASCII = {c: k for k, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n", 8)}


def _classes() -> np.ndarray:
    """Class of each code point of the first 65,536: case, digit, space, each ASCII mark, and the Unicode category of the rest."""
    found = np.zeros(1 << 16, np.int64)
    kinds = {"Lu": 1, "Lt": 1, "Ll": 2, "Lo": 3, "Lm": 3, "Nd": 4, "Zs": 5, "Cc": 6, "Mn": 3, "Mc": 3}
    for code in range(1 << 16):
        char = chr(code)
        found[code] = _ASCII.get(char) or kinds.get(unicodedata.category(char), 7)
    found[ord("\t")] = 5
    return found


_table: list[np.ndarray] = []


def _coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def encode(codes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Features, float32, of the passages that begin in ``codes[start:stop]``, of which ``start`` begins one."""
    if not _table:
        _table.append(_classes())
    part = codes[start:stop]
    count = -(-len(part) // PASSAGE)
    lengths = np.full(count, PASSAGE)
    lengths[-1] = len(part) - PASSAGE * (count - 1)
    out = np.zeros((count, FEATURES), np.float32)
    kinds = _table[0][np.minimum(part, (1 << 16) - 1)]
    of = np.arange(len(part)) // PASSAGE
    pair = (kinds[:-1] * 64 + kinds[1:]) * 0x9E3779B1 >> 7
    inside = of[:-1] == of[1:]
    cells = np.bincount(of[:-1][inside] * PAIRS + pair[inside] % PAIRS, minlength=count * PAIRS)
    out[:, :PAIRS] = np.sqrt(cells.reshape(count, PAIRS) / np.maximum(lengths - 1, 1)[:, None])
    grid = np.zeros((count, PASSAGE), np.uint64)
    grid.reshape(-1)[: len(part)] = part
    rolled, width = grid.copy(), 1
    for k, span in enumerate(REPEATS):  # hashes of ``span`` characters from every place on
        while width < span:
            step = min(width, span - width)
            rolled[:, : PASSAGE - step] = rolled[:, : PASSAGE - step] * np.uint64(0x9E3779B97F4A7C15) + (rolled[:, step:] ^ rolled[:, step:] >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
            width += step
        whole = np.maximum(lengths - span + 1, 0)
        places = np.where(np.arange(PASSAGE) < whole[:, None], rolled >> np.uint64(1), (1 << 63) + np.arange(PASSAGE, dtype=np.uint64))
        places.sort(axis=1)
        same = (places[:, 1:] == places[:, :-1]).sum(1)
        out[:, PAIRS + k] = same / np.maximum(whole, 1)
    out[:, -1] = lengths / PASSAGE
    return out


def passages(text: str | None) -> Iterator[np.ndarray]:
    """Features of all passages of a text, some at a time; an empty text has one passage, all zero."""
    codes = _coded(text or "")
    if not len(codes):
        yield np.zeros((1, FEATURES), np.float32)
    step = PASSAGE * _SLICE
    for at in range(0, len(codes), step):
        yield encode(codes, at, min(at + step, len(codes)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    """Weights: features are standardised by ``mean`` and ``scale``; the rest is learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Representation, both gates and attention logit of passages."""
        p = self.weights
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, g, (t * g) @ p["w"]

    def score(self, parts: Iterable[np.ndarray]) -> tuple[float, int, int, float]:
        """Score of a document from its passages, their number, the one of most weight and that weight."""
        most, total, summed, count, top = -np.inf, 0.0, 0.0, 0, 0
        for x in parts:
            h, _, _, logit = self.forward(x)
            best = float(logit.max())
            if best > most:
                shrink = np.exp(most - best)
                most, total, summed, top = best, total * shrink, summed * shrink, count + int(logit.argmax())
            a = np.exp(logit - most)
            total, summed, count = total + float(a.sum()), summed + a @ h, count + len(x)
        score = float(_sigmoid(np.asarray(summed / total @ self.weights["q"] + self.weights["b"][0])))
        return score, count, top, 1 / total

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of documents, whose passages begin at ``starts`` in ``x``, and its gradients."""
        p = self.weights
        sizes = np.diff(np.append(starts, len(x)))
        of = np.repeat(np.arange(len(starts)), sizes)
        h, t, g, logit = self.forward(x)
        a = np.exp(logit - np.maximum.reduceat(logit, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        s = _sigmoid(z @ p["q"] + p["b"][0])
        loss = -np.mean(labels * np.log(s + 1e-9) + (1 - labels) * np.log(1 - s + 1e-9))
        ds = (s - labels) / len(labels)
        dz = ds[:, None] * p["q"]
        da = (h * dz[of]).sum(1)
        dlogit = a * (da - np.add.reduceat(a * da, starts)[of])
        dt = dlogit[:, None] * p["w"] * g * (1 - t * t)
        dg = dlogit[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h * h)
        scaled = (x - self.mean) / self.scale
        return float(loss), {"W": scaled.T @ dpre, "c": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ dlogit, "q": z.T @ ds, "b": ds.sum(keepdims=True)}


def start_model(x: np.ndarray, labels: np.ndarray, hidden: int = 24, gates: int = 12, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda rows, *more: (rng.standard_normal((rows, *more)) / np.sqrt(rows)).astype(np.float64)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    weights = {"W": draw(FEATURES, hidden), "c": np.zeros(hidden), "V": draw(hidden, gates), "U": draw(hidden, gates), "w": draw(gates), "q": draw(hidden), "b": np.array([np.log(share / (1 - share))])}
    return Model(x.mean(0) if len(x) else np.zeros(FEATURES), (x.std(0) if len(x) else np.ones(FEATURES)) + 0.02, weights)


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
    """Weights learned from ``bags``, one array of passages a document, by Adam; the same input gives the same model.

    Without a document the model scores everything 0.5.
    """
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    model = start_model(x, labels, seed=seed)
    if not bags:
        model.weights["q"][:] = 0
        model.weights["b"][:] = 0
        return model
    sizes = np.array([len(b) for b in bags])
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, steps = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in docs])
            _, found = model.gradients(x[rows], np.cumsum(sizes[docs]) - sizes[docs], labels[docs])
            step += 1
            pace = rate * (1 - (step - 1) / steps)
            for k, gradient in found.items():
                gradient = gradient + decay * model.weights[k] if k != "b" else gradient
                first[k] = 0.9 * first[k] + 0.1 * gradient
                second[k] = 0.999 * second[k] + 0.001 * gradient**2
                model.weights[k] = model.weights[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id in decimal leaves 1 when divided by 3; a null id is never held out and never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _encoded(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                bags = [np.concatenate(list(passages(t.as_py()))).astype("<f4").tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    return docs.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, bag binary")


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """The model of ``docs (doc_id, text)`` and ``labels (doc_id, quality)``.

    Only ids that are not held out teach; several labels of one id count as their mean,
    labels that are null or neither 0 nor 1 do not count. About ``fit_docs`` ids are drawn by a hash,
    of their documents the ``fit_docs`` of smallest hash are encoded in the tasks and
    gathered, without those of more than ``fit_chars`` code points.
    """
    prepare(docs)
    key = F.col("doc_id").cast("long")
    told = labels.select(key.alias("doc_id"), F.col("quality").cast("double").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
    told = written(told.groupBy("doc_id").agg(F.avg("label").alias("label")), "labels")
    share = fit_docs / max(1, told.count())
    chosen = written(told.filter(hash_draw("doc_id") < share), "labels")
    texts = docs.select(key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.char_length("text") <= fit_chars)
    drawn = texts.join(F.broadcast(chosen), "doc_id").withColumn("draw", F.xxhash64("doc_id", "text"))  # about fit_docs narrow rows
    few = drawn.orderBy("draw", "doc_id").limit(fit_docs)
    rows = sorted(_encoded(few).collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), "<f4").reshape(-1, FEATURES) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: doc_id, held_out, score, predicted, n_passages, top_passage, top_weight.

    ``score`` is the probability of quality 1, ``predicted`` is 1 from 0.5 on.
    ``top_passage`` is the passage (from 0, of 512 code points) with most attention, the first of equals,
    ``top_weight`` its share. A null text counts as empty, which is one passage.
    Without a usable label all scores are 0.5. Repeated rows stay repeated; other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    model = learn(docs, labels, fit_docs, fit_chars)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(passages(t.as_py())) for t in batch.column("text")]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long, top_weight double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages", "top_passage", "top_weight")
