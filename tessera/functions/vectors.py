"""Column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalised(a: Column) -> Column:
    """``a`` scaled to length 1; a vector of length 0 stays as it is."""

    def scaled(v: Column) -> Column:
        length = norm(v)
        return F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))

    return F.get(F.transform(F.array(a), scaled), F.lit(0))  # so that ``a`` is evaluated once


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query token vector the best dot product of the document's, summed."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


@dataclass(frozen=True)
class Metric:
    """A score and its direction; Euclidean distance is better when smaller."""

    name: str
    largest_first: bool = True
    by_norm: bool = False  # a dot product divided by both norms

    def score(self, a: Column, b: Column) -> Column:
        return {"cosine": cosine, "dot": dot, "euclidean": euclidean}[self.name](a, b)

    def order(self, score: Column) -> Column:
        return score.desc_nulls_last() if self.largest_first else score.asc_nulls_last()

    def passes(self, score: Column, threshold: float) -> Column:
        return score >= threshold if self.largest_first else score <= threshold


METRICS = {"cosine": Metric("cosine", by_norm=True), "dot": Metric("dot"), "euclidean": Metric("euclidean", largest_first=False)}
