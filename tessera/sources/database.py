"""Tables of a relational database over JDBC: partitioned reads, appends and upserts.

Reads are cut by bounds of a numeric column, so executors read side by side;
filters, projections and aggregates of the DataFrame reach the database (the plan
shows them). An upsert is written to a staging table by all tasks and merged by
one statement inside the database, so a task that runs twice changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows between a numeric column's bounds that one task reads, and rows of one round trip.
ROWS_A_TASK = 1_000_000
FETCH_ROWS = 10_000
_name = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def _checked(*names: str) -> None:
    for name in names:
        if not _name.match(name):
            raise ValueError(f"{name!r} is no name of a table or column")


class Database:
    """A database by its JDBC ``url``; ``options`` go to Spark's reader and writer (driver, user, password ...)."""

    def __init__(self, spark: SparkSession, url: str, **options: str) -> None:
        self.spark, self.url, self.options = spark, url, options

    def read(self, table: str, by: str | None = None, tasks: int | None = None) -> DataFrame:
        """The table as a DataFrame. ``by``, a numeric column, cuts the read into ``tasks`` (by default one for ``ROWS_A_TASK`` values between its bounds).

        Rows whose ``by`` is null are read by the first task.
        """
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=table, fetchsize=str(FETCH_ROWS), pushDownAggregate="true", pushDownLimit="true", **self.options)
        if by is None:
            return reader.load()
        _checked(table, by)
        bounds = self.spark.read.format("jdbc").options(url=self.url, query=f"SELECT MIN({by}) AS lo, MAX({by}) AS hi FROM {table}", **self.options).load().first()
        low, high = (int(x) if x is not None else 0 for x in bounds)
        tasks = tasks or max(1, -(-(high - low + 1) // ROWS_A_TASK))
        return reader.options(partitionColumn=by, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(tasks)).load()

    def append(self, rows: DataFrame, table: str) -> None:
        """Add ``rows``; a table that is not there is made from their schema. A task that is run again can add its rows twice: see ``upsert``."""
        rows.write.format("jdbc").mode("append").options(url=self.url, dbtable=table, batchsize=str(FETCH_ROWS), **self.options).save()

    def upsert(self, rows: DataFrame, table: str, *keys: str) -> None:
        """Replace rows of equal ``keys`` and add the others, in one statement. Of ``rows`` of equal keys one is taken; a null key equals nothing."""
        columns = rows.columns
        _checked(table, *columns, *keys)
        rows = rows.dropDuplicates(list(keys))
        staging = f"{table}_{uuid.uuid4().hex[:12]}"
        self.append(rows, staging)
        q = lambda c: f'"{c}"'  # noqa: E731  as Spark's writer names columns
        others = [c for c in columns if c not in keys]
        matched = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in others)}" if others else ""
        on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
        merge = f"MERGE INTO {table} t USING {staging} s ON {on}{matched} WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, columns))}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"
        try:
            self.execute(merge)
        finally:
            self.execute(f"DROP TABLE {staging}")

    def execute(self, *statements: str) -> list[int]:
        """Run statements in one transaction; gives the number of rows that each changed."""
        with self._connection() as connection:
            connection.setAutoCommit(False)
            changed = []
            try:
                for sql in statements:
                    statement = connection.createStatement()
                    changed.append(statement.executeUpdate(sql))
                    statement.close()
                connection.commit()
            except Exception:
                connection.rollback()
                raise
            return changed

    @contextmanager
    def _connection(self) -> Iterator:
        jvm = self.spark.sparkContext._jvm
        if "driver" in self.options:
            jvm.org.apache.spark.util.Utils.classForName(self.options["driver"], True, False)
        properties = jvm.java.util.Properties()
        for key in ("user", "password"):
            if key in self.options:
                properties.setProperty(key, self.options[key])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            yield connection
        finally:
            connection.close()
