"""Points in buckets of their ids: a write touches the buckets it changes.

A collection is one Parquet table in folders ``bucket=n``. An upsert or delete reads
and replaces the buckets that hold an id of it, through Spark's dynamic partition
overwrite; all other files stay as they are. Writers take turns: a write holds the
collection's lock, a file that only one writer can create, so a second one is refused
and no update is lost. A writer that died leaves its lock, which ``break_lock`` removes.

Spark moves the new files of a bucket into place one bucket after the other when the
job commits. Who reads at that moment can see some buckets before and some after
it; ``PointsStore`` writes whole versions where that matters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.scratch import written
from tessera.sources.points import PointsStore, collection_info, delete_points, upsert_points

BUCKETS = 64


class BucketedPointsStore:
    """A named collection below ``root`` with ``(id, vector, payload)``; dimension, metric and number of buckets are stored with it."""

    def __init__(self, spark: SparkSession, root: str, name: str, dimension: int, metric: str = "cosine", buckets: int = BUCKETS) -> None:
        if metric not in PointsStore.METRICS:
            raise ValueError(f"metric must be one of {PointsStore.METRICS}")
        self.spark, self.base, self.name, self.dimension, self.metric, self.buckets = spark, f"{root.rstrip('/')}/{name}", name, dimension, metric, buckets
        if self._exists("properties/_SUCCESS"):
            stored = spark.read.parquet(f"{self.base}/properties").first()
            if (stored.dimension, stored.metric) != (dimension, metric):
                raise ValueError(f"collection {name} has dimension {stored.dimension} and metric {stored.metric}")
            self.buckets = stored.buckets
        else:
            spark.createDataFrame([(dimension, metric, buckets)], "dimension int, metric string, buckets int").coalesce(1).write.parquet(f"{self.base}/properties")

    def _file(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        files, target = self._file(path)
        return files.exists(target)

    @contextmanager
    def _locked(self) -> Iterator[None]:
        files, target = self._file("lock")
        if not files.createNewFile(target):
            raise RuntimeError(f"another writer holds collection {self.name}")
        try:
            yield
        finally:
            files.delete(target, False)

    def break_lock(self) -> None:
        """Remove the lock of a writer that is gone."""
        files, target = self._file("lock")
        files.delete(target, False)

    def exists(self) -> bool:
        return self._exists("schema/_SUCCESS")

    def _bucket(self, points: DataFrame) -> DataFrame:
        return points.withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError(f"collection {self.name} has no points")
        schema = StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.base}/schema").first()["schema"]))
        return self.spark.read.schema(schema.add("bucket", "integer")).parquet(f"{self.base}/points")

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r["bucket"] for r in self._bucket(ids.select("id")).select("bucket").distinct().collect()]  # at most ``buckets`` numbers

    def _replace(self, points: DataFrame, touched: list[int]) -> None:
        """Write ``points``, all that the touched buckets shall hold; a bucket that is left empty loses its folder."""
        kept = written(self._bucket(points), "bucket-points")
        kept.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.base}/points")
        left = {r["bucket"] for r in kept.select("bucket").distinct().collect()}
        for bucket in set(touched) - left:
            files, target = self._file(f"points/bucket={bucket}")
            files.delete(target, True)

    def upsert(self, points: DataFrame, mode: str = "overwrite") -> int:
        """As ``upsert_points``; gives the number of buckets that were written. Points whose vector has another length are refused."""
        points = points.drop("bucket")
        if not points.filter(F.size("vector") != self.dimension).limit(1).isEmpty():
            raise ValueError(f"vectors of collection {self.name} have {self.dimension} parts")
        with self._locked():
            if not self.exists():  # before the points, so that a collection whose buckets are all empty can be read
                files, target = self._file("points")
                files.mkdirs(target)
                self.spark.createDataFrame([(points.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/schema")
            if mode == "append":  # new identities: their buckets follow from them, nothing that is there changes
                new = written(self._bucket(upsert_points(points.limit(0), points, mode)), "bucket-points")
                new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.base}/points")
                return new.select("bucket").distinct().count()
            points = written(points, "new-points")
            touched = self._touched(points)
            stored = self._stored().filter(F.col("bucket").isin(touched)).drop("bucket")
            if touched:
                self._replace(upsert_points(stored, points, mode), touched)
            return len(touched)

    def delete(self, ids: DataFrame) -> int:
        """Remove points by ``ids (id)``; gives the number of buckets that were looked through."""
        with self._locked():
            touched = self._touched(ids)
            if touched:
                self._replace(delete_points(self._stored().filter(F.col("bucket").isin(touched)).drop("bucket"), ids), touched)
            return len(touched)

    def info(self) -> DataFrame:
        return collection_info(self.read(), self.name)


#: Stores by name.
_stores: dict[str, type] = {"versions": PointsStore, "buckets": BucketedPointsStore}


def register_store(name: str, store: type) -> None:
    """Make a store, with the methods of ``PointsStore``, available by name."""
    _stores[name] = store


def available_stores() -> list[str]:
    return sorted(_stores)


def open_store(kind: str, spark: SparkSession, root: str, name: str, dimension: int, metric: str = "cosine", **options):
    """The collection ``name`` in a store of that kind."""
    if kind not in _stores:
        raise ValueError(f"store must be one of {available_stores()}")
    return _stores[kind](spark, root, name, dimension, metric, **options)
