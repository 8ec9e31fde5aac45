"""An exact vector index: points in cells around centroids, visited while a cell can still hold a result.

``build_vector_index`` draws a bounded sample, finds centroids, and stores every
point under its nearest one, cells cut into rings of equal size by distance. A
cell is a ball around its centroid with a hole in it: the least and largest distance
bound the score of all its points for any query, whatever the metric.

``VectorIndex.search`` goes in two scans of the stored points. The first visits the cells
of best bound until they hold a few times ``top_k`` points, which gives a k-th score for each
query; the second visits those of the other cells whose bound reaches it. Only folders
of visited cells are read, and a point meets only the queries that visit its cell. Points
are multiplied as matrices; what could be a result is summed again term by term, in
the order of ``vector_search``, so scores and ranks equal it in every bit.

Broadcast are a block of the stated query set (``QUERY_BLOCK``) and which cells it
visits; the driver holds centroids and bounds of at most ``MAX_CELLS`` cells.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import METRICS, doubles
from tessera.operators import retrieval
from tessera.operators.retrieval import RetrievalConfig
from tessera.scratch import written
from tessera.session import share_code

#: Vectors of the sample that centroids are found in, and most centroids.
SAMPLE = 20_000
MAX_CELLS = 4096
RINGS = 4
LLOYD_ROUNDS = 8
#: The first scan visits cells until they hold so many times ``top_k`` points.
PROBE = 4
#: Pairs of point and query that a task compares at a time (about 50 bytes each).
HELD_PAIRS = 1 << 21
#: Relative room for rounding in bounds and matrix products.
SLACK = 1e-9
_STORED = ("cell", "ring", "distance", "row")


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's centroids of ``sample``; the same input gives the same output."""
    rng = np.random.default_rng(0)
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.sort(rng.choice(len(distinct), min(cells, len(distinct)), replace=False))]
    for _ in range(LLOYD_ROUNDS):
        near, _ = _nearest(sample, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        near[at : at + 4096] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def _matrix(vectors: Iterable, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors of ``dimension`` finite numbers, and which those are."""
    fine = np.array([v is not None and len(v) == dimension for v in vectors], bool)
    kept = [v for v, f in zip(vectors, fine, strict=True) if f]
    rows = np.concatenate([np.asarray(v, np.float64) for v in kept]).reshape(-1, dimension) if kept else np.zeros((0, dimension))
    finite = np.isfinite(rows).all(1)
    fine[np.flatnonzero(fine)[~finite]] = False
    return rows[finite], fine


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row of length 0 stays."""
    lengths = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def build_vector_index(points: DataFrame, path: str, cells: int | None = None, directions: bool = False) -> VectorIndex:
    """Index ``points (chunk_id, vector, ...)`` below ``path``; all columns are kept and can be filtered by.

    With ``directions`` points are placed by their vectors scaled to length 1: such an index serves cosine alone, with closer bounds.

    Every row is indexed. Vectors that are null, of another length than most of the sample, or not
    finite lie in a cell of their own that every search scans. ``cells`` is about the square root of the number of points where it is not given.
    """
    spark = points.sparkSession
    share_code(spark)
    if taken := {c.lower() for c in points.columns} & set(_STORED):
        raise ValueError(f"columns {sorted(taken)} are those of the index")
    vectors = points.select(doubles(F.col("vector")).alias("v")).filter("v is not null")
    n = points.count()
    drawn = vectors.withColumn("draw", F.xxhash64("v")).filter(F.pmod("draw", F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, 2 * SAMPLE / max(1, n))))
    sample = [np.asarray(r["v"], object) for r in drawn.orderBy("draw", "v").limit(SAMPLE).select("v").collect()]
    lengths = [len(v) for v in sample]
    dimension = max(set(lengths), key=lambda k: (lengths.count(k), k), default=0)
    found, _ = _matrix(sample, dimension)
    scaled = _directions if directions else lambda x: x
    found = scaled(found)
    centres = _centroids(found, min(MAX_CELLS, cells or max(1, math.isqrt(n)))) if len(found) and dimension else np.zeros((0, dimension))

    @F.pandas_udf("cell int, distance double")
    def placed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cell, distance = np.full(len(part), -1, np.int32), np.zeros(len(part))
            if len(centres):
                x, fine = _matrix(list(part), dimension)
                cell[fine], distance[fine] = _nearest(scaled(x), centres)
            yield pd.DataFrame({"cell": cell, "distance": distance})

    assigned = points.withColumn("__at", placed(doubles(F.col("vector")))).select(*points.columns, "__at.cell", "__at.distance")
    assigned = written(assigned.withColumn("row", F.monotonically_increasing_id()), "vector-cells")
    cuts = assigned.groupBy("cell").agg(F.percentile_approx("distance", [k / RINGS for k in range(1, RINGS)], 1000).alias("cuts"))
    ringed = assigned.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("distance")))).drop("cuts")  # at most MAX_CELLS rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Cells are folders; a cell that holds a third of all points is written by as many tasks as it fills.
    ringed.repartitionByRange(parts, "cell", "ring", F.xxhash64("row")).sortWithinPartitions("cell", "ring").write.partitionBy("cell").parquet(f"{path}/points")
    stored = spark.read.schema(ringed.schema).parquet(f"{path}/points")
    facts = stored.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
    facts.coalesce(1).write.parquet(f"{path}/cells")
    about = {"dimension": int(dimension), "directions": directions, "columns": points.columns, "schema": ringed.schema.json()}
    spark.createDataFrame([(json.dumps(about), centres.ravel().tolist())], "about string, centroids array<double>").coalesce(1).write.parquet(f"{path}/about")
    return VectorIndex(spark, path)


class VectorIndex:
    """A stored index; opening it reads its centroids and cells."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        from pyspark.sql.types import StructType

        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/about").first()
        about = json.loads(row["about"])
        self.dimension, self.columns, self.directions = about["dimension"], about["columns"], about["directions"]
        self._schema = StructType.fromJson(json.loads(about["schema"]))
        self.centroids = np.array(row["centroids"]).reshape(-1, self.dimension) if self.dimension else np.zeros((0, 0))
        facts = spark.read.parquet(f"{path}/cells").orderBy("cell", "ring").toPandas()
        self.odd = int(facts["n"][facts["cell"] < 0].sum())
        facts = facts[facts["cell"] >= 0].reset_index(drop=True)
        self.cell, self.ring = facts["cell"].to_numpy(), facts["ring"].to_numpy()
        self.n, self.least, self.most = facts["n"].to_numpy(np.int64), facts["least"].to_numpy(), facts["most"].to_numpy()

    def points(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(f"{self.path}/points")

    def bounds(self, asked: np.ndarray, metric: str) -> np.ndarray:
        """For each query and cell, the best score that a point there can have; larger is better (distances are negative)."""
        if self.directions:
            asked = _directions(asked)
            apart = np.sqrt(np.maximum(1 + (self.centroids**2).sum(1) - 2 * asked @ self.centroids.T, 0))[:, self.cell]
            near = np.maximum(0, np.maximum(apart - self.most, self.least - apart) - np.sqrt(SLACK))
            return 1 - near**2 / 2 + SLACK  # the square of |x - q| is 2 - 2 cos for unit vectors
        centre = self.centroids[self.cell]
        lengths = np.sqrt((asked**2).sum(1))[:, None]
        middle = asked @ self.centroids.T
        apart = np.sqrt(np.maximum(lengths**2 + (self.centroids**2).sum(1) - 2 * middle, 0))[:, self.cell]
        size = np.sqrt((centre**2).sum(1))
        room = SLACK * (1 + lengths + size + self.most) ** 2
        if metric == "euclidean":
            return -np.maximum(0, np.maximum(apart - self.most, self.least - apart) - np.sqrt(room))
        # |x - q| is at least ``near``, and x is at most size + most long: x.q = (|x|^2 + |q|^2 - |x - q|^2) / 2 is bounded by x.q <= c.q + |q| most.
        reach = middle[:, self.cell] + lengths * self.most
        if metric == "dot":
            return reach + room
        with np.errstate(divide="ignore", invalid="ignore"):
            wide = np.where(size > self.most, np.arcsin(np.minimum(1, self.most / size)), np.pi)  # half the angle that the ball fills
            angle = np.arccos(np.clip(middle[:, self.cell] / (lengths * size), -1, 1))
        bound = np.cos(np.maximum(0, np.nan_to_num(angle, nan=0.0) - wide)) + np.sqrt(SLACK)
        return np.minimum(bound, 1 + SLACK)

    def search(self, queries: DataFrame, config: RetrievalConfig | None = None, exclude_self: bool = True, report: dict | None = None) -> DataFrame:
        """The rows of ``vector_search`` over the points; ``report`` gets how many pairs of query and point there are and were compared."""
        config = config or RetrievalConfig()
        if self.directions and config.metric != "cosine":
            raise ValueError("an index of directions serves cosine")
        queries = queries.select("query_id", doubles(F.col("query_vector")).alias("query_vector"))
        finite = F.coalesce(F.size("query_vector"), F.lit(-1)) == self.dimension
        plain = finite & F.forall("query_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        plain = F.coalesce(plain, F.lit(False))
        asked = written(queries.withColumn("plain", plain & F.lit(bool(self.dimension))), "vector-queries")
        stored = retrieval.retrieval_filters(self.points(), config)
        drop = [c for c in _STORED]
        found = []
        if not asked.filter("not plain").isEmpty():
            found.append(retrieval.vector_search(stored.drop(*drop), asked.filter("not plain"), config, exclude_self))
        fine = asked.filter("plain").drop("plain")
        n = fine.count()
        blocks = max(1, -(-2 * n // retrieval.QUERY_BLOCK)) if n > retrieval.QUERY_BLOCK else 1
        compared = 0
        for b in range(blocks):
            block = fine if blocks == 1 else fine.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            best, pairs = self._block(stored, block, config, exclude_self)
            compared += pairs
            if best is not None:
                found.append(best)
        if report is not None:
            report.update(pairs=int(self.n.sum()) * n, compared=compared, cells=len(self.n), odd=self.odd)
        if not found:
            found = [retrieval.vector_search(stored.drop(*drop), fine, config, exclude_self)]
        # What could not be placed in a cell is compared with every query.
        if self.odd and n:
            found.append(retrieval.vector_search(stored.filter("cell < 0").drop(*drop), fine, config, exclude_self))
            merged = reduce(lambda x, y: x.unionByName(y), found).drop("result_rank")
            return retrieval.ranked(merged, config)
        return reduce(lambda x, y: x.unionByName(y), found)

    def _block(self, stored: DataFrame, block: DataFrame, config: RetrievalConfig, exclude_self: bool) -> tuple[DataFrame | None, int]:
        rows = block.collect()  # at most QUERY_BLOCK
        if not rows or not len(self.n):
            return None, 0
        ids, asked = [r["query_id"] for r in rows], np.array([r["query_vector"] for r in rows])
        bounds = self.bounds(asked, config.metric)
        sign = 1.0 if METRICS[config.metric].largest_first else -1.0
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, order, before < PROBE * config.top_k, axis=1)
        if config.min_score > 0 and config.threshold_stage == "before":
            first &= bounds >= sign * config.min_score - SLACK
        one = written(self._visit(stored, first, ids, asked, config, exclude_self), "vector-probe")
        last = retrieval.first_ranks(one.select("query", (F.col("score") * sign).alias("score")), config.top_k, "query", [F.desc("score")], "at").filter(F.col("at") == config.top_k - 1)
        kth = dict(last.select("query", "score").collect())
        worst = np.array([kth.get(q, -np.inf) for q in range(len(ids))])
        if config.min_score > 0 and config.threshold_stage == "before":
            worst = np.maximum(worst, sign * config.min_score - SLACK)
        second = ~first & (bounds >= worst[:, None])
        found = one.unionByName(self._visit(stored, second, ids, asked, config, exclude_self)) if second.any() else one
        names = self.spark.createDataFrame(list(enumerate(ids)), f"query int, query_id {block.schema['query_id'].dataType.simpleString()}")
        best = retrieval.ranked(found.withColumnRenamed("score", "similarity_score").join(F.broadcast(names), "query").drop("query"), config)  # a block of queries
        best = written(best.select("row", "query_id", "similarity_score", "result_rank"), "vector-best")  # top_k rows a query
        shown = stored.drop("vector", "cell", "ring", "distance").join(F.broadcast(best), "row").drop("row")
        return shown, int((self.n * (first | second)).sum())

    def _visit(self, stored: DataFrame, visits: np.ndarray, ids: list, asked: np.ndarray, config: RetrievalConfig, exclude_self: bool) -> DataFrame:
        """``(query int, row, chunk_id, score)``: of every task the best ``top_k`` points of each query among the cells that it visits."""
        cells = sorted({int(c) for c in self.cell[visits.any(0)]})
        seen = self.spark.sparkContext.broadcast((visits, ids, asked, dict(zip(zip(self.cell.tolist(), self.ring.tolist(), strict=True), range(len(self.n)), strict=True))))
        scanned = stored.filter(F.col("cell").isin(cells)).select("cell", "ring", "row", "chunk_id", doubles(F.col("vector")).alias("vector"))
        kind = scanned.schema["chunk_id"].dataType.simpleString()
        dimension = self.dimension

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            visits, ids, asked, codes = seen.value
            best = Best(len(ids), config)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("vector").flatten()).reshape(-1, dimension)
                names, rows = np.array(batch.column("chunk_id").to_pylist(), object), batch.column("row").to_numpy()
                code = np.array([codes[c] for c in zip(batch.column("cell").to_pylist(), batch.column("ring").to_pylist(), strict=True)])
                for c in np.unique(code):
                    at, of = np.flatnonzero(code == c), np.flatnonzero(visits[:, c])
                    if len(of):
                        best.add(x[at], names[at], rows[at], asked[of], of, [ids[q] for q in of] if exclude_self else None)
            yield from best.batches(batch_type)

        batch_type = pa.schema([("query", pa.int32()), ("row", pa.int64()), ("chunk_id", _arrow(kind)), ("score", pa.float64())])
        return scanned.mapInArrow(run, f"query int, row long, chunk_id {kind}, score double")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def summed(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows of ``x`` with rows of ``y``, added up one dimension after the other, as expressions over arrays are."""
    total, one, other = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(x.shape[1]):
        a, b = x[:, k], y[:, k]
        if metric == "euclidean":
            total = total + (a - b) * (a - b)
        else:
            total = total + a * b
            if metric == "cosine":
                one, other = one + a * a, other + b * b
    if metric == "euclidean":
        return np.sqrt(total)
    if metric == "dot":
        return total
    below = np.sqrt(one) * np.sqrt(other)
    return np.divide(total, below, out=np.full(len(x), np.nan), where=below != 0)


class Best:
    """The best ``top_k`` points of each query so far, by score and then chunk_id."""

    def __init__(self, queries: int, config: RetrievalConfig) -> None:
        self.config, self.sign = config, 1.0 if METRICS[config.metric].largest_first else -1.0
        self.held: list[list[tuple]] = [[] for _ in range(queries)]
        self.worst = np.full(queries, -np.inf)

    def add(self, x: np.ndarray, names: np.ndarray, rows: np.ndarray, asked: np.ndarray, of: np.ndarray, own: list | None) -> None:
        """Compare points ``x`` with the queries ``of``, whose vectors are ``asked``; ``own`` are ids that are no result of their query."""
        step = max(1, HELD_PAIRS // max(1, len(of)))
        if len(x) > step:
            for at in range(0, len(x), step):
                part = slice(at, at + step)
                self.add(x[part], names[part], rows[part], asked, of, own)
            return
        metric, k = self.config.metric, self.config.top_k
        with np.errstate(divide="ignore", invalid="ignore"):
            about = x @ asked.T
            long, wide = (x**2).sum(1)[:, None], (asked**2).sum(1)
            if metric == "euclidean":
                room = np.sqrt(SLACK * (long + wide))
                about = -np.sqrt(np.maximum(long + wide - 2 * about, 0))
            elif metric == "cosine":
                room = np.full(about.shape, SLACK)
                about = np.where(long * wide > 0, about / np.sqrt(long * wide), -np.inf)
            else:
                room = SLACK * np.sqrt(long * wide)
        if own is not None:
            places: dict = {}
            for i, name in enumerate(names.tolist()):
                places.setdefault(name, []).append(i)
            for j, name in enumerate(own):
                if name in places:
                    about[places[name], j] = -np.inf
        least = self.worst[of]
        if self.config.min_score > 0 and self.config.threshold_stage == "before":
            least = np.maximum(least, self.sign * self.config.min_score)
        if len(x) > k:  # the k-th best of these points is a bound as well
            least = np.maximum(least, np.partition(about - room, len(x) - k, axis=0)[len(x) - k])
        at, q = np.nonzero((about + room >= least) & (about > -np.inf))
        score = summed(x[at], asked[q], metric)
        fine = ~np.isnan(score)
        if self.config.min_score > 0 and self.config.threshold_stage == "before":
            fine &= score >= self.config.min_score if self.sign > 0 else score <= self.config.min_score
        for a, j, s in zip(at[fine].tolist(), q[fine].tolist(), score[fine].tolist(), strict=True):
            self.held[of[j]].append((-self.sign * s, names[a], int(rows[a]), s))
        for j in np.unique(q[fine]).tolist():
            self._cut(of[j])

    def _cut(self, query: int) -> None:
        held = self.held[query]
        held.sort(key=lambda x: x[:3])
        del held[self.config.top_k :]
        if len(held) == self.config.top_k:
            self.worst[query] = -held[-1][0]

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = [(q, r, name, s) for q, held in enumerate(self.held) for _, name, r, s in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)], schema=schema)
