"""The best rows of each query within a task, and keyword scores as products of matrices.

Pairs of query and row are scored a block at a time where the rows lie; a task gives
the best ``k`` of each query, so what is shuffled does not grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that a task holds at a time (16 MB).
CELLS = 1 << 21
#: Terms that most pairs of query and document share are multiplied as a dense matrix.
HEAD = 128
#: Terms shared by a document and a query that a task holds at a time (about 50 bytes each).
MEETINGS = 1 << 20


class Best:
    """The best ``k`` rows of each query so far: by score (NaN counts as largest, as in Spark), then by ``chunk_id``."""

    def __init__(self, queries: int, k: int, largest_first: bool = True) -> None:
        self.k, self.sign = k, -1.0 if largest_first else 1.0
        self.worst = np.full(queries, np.inf)  # the k-th key; a smaller key is better
        self._parts: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
        self._rows = self._kept = 0

    def keys(self, score: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(score), self.sign * np.inf, self.sign * score)

    def add(self, query: np.ndarray, score: np.ndarray, rows: pa.RecordBatch, at: np.ndarray) -> None:
        """Scores of ``rows`` (places ``at``) for queries; rows have a chunk_id and what else is carried along."""
        fine = self.keys(score) <= self.worst[query]
        if fine.any():
            self._parts.append((query[fine], score[fine], rows.take(pa.array(at[fine]))))
            self._rows += int(fine.sum())
            if self._rows > 2 * self._kept + 2 * len(self.worst) + 10_000:
                self._cut()

    def _cut(self) -> None:
        query = np.concatenate([p[0] for p in self._parts])
        score = np.concatenate([p[1] for p in self._parts])
        rows = pa.Table.from_batches([p[2] for p in self._parts]).combine_chunks()
        name = rows.column("chunk_id")
        ties = pc.rank(name, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy() if name.null_count < len(name) else np.zeros(len(name))
        key, nan = self.keys(score), np.isnan(score)
        order = np.lexsort((ties, nan if self.sign > 0 else ~nan, key, query))
        ordered = query[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        last = order[place == self.k - 1]
        self.worst[query[last]] = key[last]
        kept = order[place < self.k]
        batch = rows.take(pa.array(kept)).combine_chunks().to_batches()
        self._parts = [(query[kept], score[kept], batch[0])] if batch else []
        self._rows = self._kept = len(kept)

    def batches(self, score: str) -> Iterator[pa.RecordBatch]:
        """``query``, the rows' own columns and the score, named ``score``."""
        if self._parts:
            self._cut()
        for query, values, rows in self._parts:
            for at in range(0, len(query), 10_000):
                part = rows.slice(at, 10_000)
                end = at + part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(query[at:end], pa.int32()), *part.columns, pa.array(values[at:end], pa.float64())], names=["query", *part.schema.names, score])


class AskedTerms:
    """A block of keyword queries: which of them hold each term, and the terms' weights."""

    def __init__(self, query: np.ndarray, term: np.ndarray, idf: np.ndarray, load: np.ndarray, queries: int) -> None:
        """``query`` and ``term`` are pairs; ``idf`` and ``load``, in how many documents or blocks it stands, are by term."""
        order = np.argsort(term, kind="stable")
        self.queries, self.idf = queries, idf
        self._of = query[order].astype(np.int64)
        self._n = np.bincount(term, minlength=len(idf))
        self._start = np.concatenate(([0], np.cumsum(self._n)[:-1])) if len(idf) else self._n
        self._slot = np.full(len(idf), -1, np.int64)
        head = np.argsort(-(load * self._n), kind="stable")[:HEAD]
        self._slot[head] = np.arange(len(head))
        self._dense = np.zeros((len(head), queries))
        at = self._slot[term]
        self._dense[at[at >= 0], query[at >= 0]] = idf[term[at >= 0]]
        rare = at < 0
        by = np.argsort(query[rare], kind="stable")
        self._terms = term[rare][by].astype(np.int64)
        self._ends = np.searchsorted(query[rare][by], np.arange(queries + 1))

    def scores(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int, of: np.ndarray | None = None) -> np.ndarray:
        """``docs`` x queries, or the queries ``of`` alone: for each the sum of idf times weight over its terms; ``doc`` ascends."""
        width = self.queries if of is None else len(of)
        slot = self._slot[term]
        dense = slot >= 0
        heads = len(self._dense)
        left = np.bincount(doc[dense] * heads + slot[dense], weight[dense], docs * heads).reshape(docs, heads)
        out = left @ (self._dense if of is None else self._dense[:, of])
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        start, n, queries = self._asking(term, of)
        parts, ends = weight * self.idf[term], np.cumsum(n)
        lo = 0
        while lo < len(n):  # as many terms as meet MEETINGS queries, one at least
            before = ends[lo] - n[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, before + MEETINGS, "right")))
            met = np.repeat(np.arange(lo, hi), n[lo:hi])
            if len(met):
                query = queries[np.arange(len(met)) + (start[lo:hi] - (ends[lo:hi] - n[lo:hi] - before))[met - lo]]
                first, last = doc[lo], doc[hi - 1] + 1
                out[first:last] += np.bincount((doc[met] - first) * width + query, parts[met], (last - first) * width).reshape(-1, width)
            lo = hi
        return out

    def _asking(self, term: np.ndarray, of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries, numbered within ``of``, that hold each of ``term``: where they begin, how many they are, and all of them."""
        if of is None:
            return self._start[term], self._n[term], self._of
        n = self._ends[of + 1] - self._ends[of]
        place = np.repeat(np.arange(len(of)), n)
        held = self._terms[np.arange(len(place)) + np.repeat(self._ends[of] - (np.cumsum(n) - n), n)]
        order = np.argsort(held, kind="stable")
        found, first, times = np.unique(held[order], return_index=True, return_counts=True)
        if not len(found):
            return np.zeros(len(term), np.int64), np.zeros(len(term), np.int64), place
        at = np.minimum(np.searchsorted(found, term), len(found) - 1)
        return first[at], np.where(found[at] == term, times[at], 0), place[order]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value of a list column, and how many values each row has."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), n


def add_scored(best: Best, asked: AskedTerms, rows: pa.RecordBatch, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, places: int, of: np.ndarray | None = None) -> None:
    """Score ``rows``, whose terms are ``(doc, term, weight)`` in order of doc, and keep the best, scores rounded to ``places``."""
    width = max(1, asked.queries if of is None else len(of))
    step = max(1, CELLS // width)
    for at in range(0, rows.num_rows, step):
        docs = min(step, rows.num_rows - at)
        lo, hi = np.searchsorted(doc, (at, at + docs))
        raw = asked.scores(doc[lo:hi] - at, term[lo:hi], weight[lo:hi], docs, of)
        score = np.floor(raw * 10**places + 0.5) / 10**places
        worst = best.worst if of is None else best.worst[of]
        least = np.where(np.isinf(worst), -np.inf, -worst)
        if docs > best.k and np.isinf(worst).any():
            least = np.maximum(least, np.partition(score, docs - best.k, axis=0)[docs - best.k])
        row, query = np.nonzero((score >= least) & (raw > 0))
        best.add(query if of is None else of[query], score[row, query], rows, row + at)
