"""The points store: vectors with payload as Parquet, written in whole versions.

Upserts come in two kinds: ``append`` gives every point a new identity, so what
is ingested again is there twice; ``overwrite`` replaces points of equal id. A
version is a folder; readers open the newest complete one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import stripped


def prepare_points(chunks: DataFrame) -> DataFrame:
    """``chunks (chunk_id, source_id, source_hash, text, vector, ...)`` that can be stored, as (id, vector, payload).

    Text, hash and source must not be empty, nor the vector.
    """
    filled = [stripped(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in ("text", "source_hash", "source_id")]
    fine = filled[0] & filled[1] & filled[2] & (F.coalesce(F.size("vector"), F.lit(0)) > 0)
    payload = [c for c in chunks.columns if c not in ("chunk_id", "vector")]
    return chunks.filter(fine).select(F.col("chunk_id").alias("id"), "vector", F.struct(*payload).alias("payload"))


def upsert_points(stored: DataFrame, new: DataFrame, mode: str = "overwrite") -> DataFrame:
    """The table after an upsert of ``new``: ``append`` gives each a new id, of new points of equal id one stays under ``overwrite``.

    New ids are random, so write the result once and read what was written.
    """
    if mode == "append":
        return stored.unionByName(new.withColumn("id", F.expr("uuid()")))
    if mode != "overwrite":
        raise ValueError("mode must be append or overwrite")
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new.dropDuplicates(["id"]))


def delete_points(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti")


def collection_info(stored: DataFrame, name: str) -> DataFrame:
    """One row: name, points_count, dimension, status (empty, ok, or mixed where lengths differ)."""
    facts = stored.agg(F.count("*").alias("points_count"), F.max(F.size("vector")).alias("dimension"), F.min(F.size("vector")).alias("least"))
    status = F.when(F.col("points_count") == 0, "empty").when(F.col("dimension") == F.col("least"), "ok").otherwise("mixed")
    return facts.select(F.lit(name).alias("collection"), "points_count", "dimension", status.alias("status"))


class PointsStore:
    """A named collection below ``root``, any file system Spark writes to.

    Its dimension and metric are stored with it; opening it with others is a
    ValueError. A write goes to the version after the last complete one and never
    over one that is there: of two writers that begin together one fails.
    """

    METRICS = ("cosine", "euclidean", "dot")

    def __init__(self, spark: SparkSession, root: str, name: str, dimension: int, metric: str = "cosine") -> None:
        if metric not in self.METRICS:
            raise ValueError(f"metric must be one of {self.METRICS}")
        self.spark, self.base, self.name, self.dimension, self.metric = spark, f"{root.rstrip('/')}/{name}", name, dimension, metric
        if self._has("properties/_SUCCESS"):
            stored = spark.read.schema("dimension int, metric string").parquet(f"{self.base}/properties").first()
            if tuple(stored) != (dimension, metric):
                raise ValueError(f"collection {name} has dimension {stored.dimension} and metric {stored.metric}")
        else:
            spark.createDataFrame([(dimension, metric)], "dimension int, metric string").coalesce(1).write.parquet(f"{self.base}/properties")

    def _has(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"collection {self.name} has no points")
        return self.spark.read.parquet(f"{self.base}/v{versions[-1]}")

    def _write(self, points: DataFrame) -> None:
        versions = self._versions()
        points.write.parquet(f"{self.base}/v{versions[-1] + 1 if versions else 0}")

    def upsert(self, points: DataFrame, mode: str = "overwrite") -> None:
        """Points whose vector has another length than the collection's are refused."""
        wrong = points.filter(F.size("vector") != self.dimension).limit(1)
        if not wrong.isEmpty():
            raise ValueError(f"vectors of collection {self.name} have {self.dimension} parts")
        stored = self.read() if self.exists() else points.limit(0)
        self._write(upsert_points(stored, points, mode))

    def delete(self, ids: DataFrame) -> None:
        self._write(delete_points(self.read(), ids))

    def info(self) -> DataFrame:
        return collection_info(self.read(), self.name)
