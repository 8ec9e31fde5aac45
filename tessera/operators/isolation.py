"""Rows that fail do not fail their neighbours: guards around plug-ins, time limits, quarantine.

A guarded plug-in gives (value, error) for each row. With a time limit the plug-in runs
in a child of the Python worker, which is ended when a row takes too long or when
the child dies, and made anew for the next row; without one it runs in the worker itself.
``quarantine`` divides a guarded table into good rows and (source, stage, error) rows.
"""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import unused, written
from tessera.session import share_code


@dataclass(frozen=True)
class Outcome:
    """Good rows, and what became of the others: (source, stage, error)."""

    rows: DataFrame
    errors: DataFrame


def describe(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"


def _serve(function: Callable, pipe) -> None:
    """In the child: values in, (result, error) out."""
    while True:
        try:
            value = pipe.recv()
        except EOFError:
            return
        try:
            pipe.send((function(value), None))
        except Exception as error:  # of the plug-in, or a result that cannot be sent
            pipe.send((None, describe(error)))


class Guard:
    """Calls ``function`` on one value after the other and never raises."""

    def __init__(self, function: Callable, seconds: float | None = None) -> None:
        self.function, self.seconds = function, seconds
        self._child = self._pipe = None

    def __call__(self, value) -> tuple[object, str | None]:
        if self.seconds is None:
            try:
                return self.function(value), None
            except Exception as error:
                return None, describe(error)
        if self._child is None:
            context = multiprocessing.get_context("fork")
            self._pipe, other = context.Pipe()
            self._child = context.Process(target=_serve, args=(self.function, other))
            self._child.start()
            other.close()
        try:
            self._pipe.send(value)
            if self._pipe.poll(self.seconds):
                return self._pipe.recv()
            error = f"TimeoutError: no result after {self.seconds:g} seconds"
        except (EOFError, OSError):
            error = "the process of the plug-in ended"
        self.close()
        return None, error

    def close(self) -> None:
        if self._child is not None:
            self._child.kill()
            self._child.join()
            self._pipe.close()
            self._child = self._pipe = None


def guarded(function: Callable, ddl: str, seconds: float | None = None) -> Callable[[Column], Column]:
    """``function``, of one Python value, as a function of columns: struct(value ``ddl``, error string). Null goes to it as None."""

    @F.pandas_udf(f"value {ddl}, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        guard = Guard(function, seconds)
        try:
            for part in parts:
                found = [guard(None if value is None else value) for value in part]
                yield pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})
        finally:
            guard.close()

    return run


def quarantine(rows: DataFrame, source: str, stage: str, error: str = "error") -> Outcome:
    """``rows`` with a column ``error`` divided by whether it is null; written once, so that no plug-in runs twice for a row."""
    kept = written(rows, f"{stage}-outcome")
    errors = kept.filter(F.col(error).isNotNull()).select(F.col(source).cast("string").alias("source"), F.lit(stage).alias("stage"), F.col(error).alias("error"))
    return Outcome(kept.filter(F.col(error).isNull()).drop(error), errors)


def applied(rows: DataFrame, function: Callable, column: str, name: str, ddl: str, source: str, stage: str, seconds: float | None = None) -> Outcome:
    """``rows`` with ``function(column)`` as ``name``; rows on which it raises or takes over ``seconds`` are the errors."""
    share_code(rows.sparkSession)
    made, error = unused(rows, "__made", "__error")
    found = rows.withColumn(made, guarded(function, ddl, seconds)(F.col(column))).withColumns({name: F.col(f"{made}.value"), error: F.col(f"{made}.error")}).drop(made)
    return quarantine(found, source, stage, error)
