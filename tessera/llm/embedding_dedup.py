"""Embedding near-dedup by PCA-ordered tiled comparison (operator 1).

Vectors are scaled to length 1 and turned so that leading dimensions carry most
(principal axes of a bounded sample; the choice of axes changes speed, never
results). They are dealt into tiles by splits along the leading axes: about
``TILE`` vectors each, fewer where the vectors are too few to occupy all cores.
Two tiles are compared only if their boxes in the leading axes come close enough.
A tile travels to one side of about half of its comparisons, so bytes moved are
vectors x tiles / 2, and tiles are as large as a task's memory allows. Inside a comparison the products of the first axes are summed, and
a pair goes on only while that sum plus the product of the norms of what is left
(the largest the rest can add) reaches the threshold; survivors are verified on
the original vectors in double precision.

Equal vectors are one node with a count, so a group of copies costs one
comparison. A comparison returns a link count for each vector and a spanning
forest of its links, not the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_draw, prepare, written
from tessera.llm.components import components

THRESHOLD = 0.95
TILE = 16_384
#: About so many vectors, by hash, give the principal axes.
SAMPLE = 10_000
#: Axes summed before each test.
STEPS = (12, 28)
#: Leading axes whose boxes are compared.
BOX_AXES = 8
_ROWS = 512


def _axes(sample: np.ndarray) -> np.ndarray:
    """Columns: principal axes of the rows (second moments about 0), strongest first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def _splits(points: np.ndarray, leaves: int, axis: int = 0) -> list:
    """Nested [axis, cut, below, above] of a tree with about ``leaves`` leaves; a leaf is []."""
    if leaves < 2 or len(points) < 2:
        return []
    axis %= min(BOX_AXES, points.shape[1])
    cut = float(np.median(points[:, axis]))
    below = points[:, axis] < cut
    if not below.any() or below.all():
        return []
    return [axis, cut, _splits(points[below], leaves // 2, axis + 1), _splits(points[~below], leaves - leaves // 2, axis + 1)]


def _leaf(tree: list, points: np.ndarray, rows: np.ndarray, out: np.ndarray, code: int = 1) -> None:
    if not tree or not len(rows):
        out[rows] = code
        return
    axis, cut, below, above = tree
    low = points[rows, axis] < cut
    _leaf(below, points, rows[low], out, 2 * code)
    _leaf(above, points, rows[~low], out, 2 * code + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows as they are stored, in single or double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unpacked(raw: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * width * rows else np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)  # so that no square is out of range
    x = x / scale
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _suffix_norms(x: np.ndarray, steps: Iterable[int]) -> list[np.ndarray]:
    return [np.sqrt(np.einsum("ij,ij->i", x[:, k:], x[:, k:])).astype(np.float32) for k in steps]


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of unit vectors ``a`` and ``b`` with cosine of ``threshold`` or more; ``same``: a is b, first < second."""
    pa_, pb = a @ axes, b @ axes
    steps = [k for k in STEPS if k < a.shape[1]] or [a.shape[1]]
    na, nb = _suffix_norms(pa_, steps), _suffix_norms(pb, steps)
    fa, fb = pa_.astype(np.float32), pb.astype(np.float32)
    slack = np.float32(1e-5)
    lead = np.ascontiguousarray(np.hstack([fb[:, : steps[0]], nb[0][:, None]]).T)  # one product gives sum and bound
    for at in range(0, len(a), _ROWS):
        part = slice(at, at + _ROWS)
        bound = np.hstack([fa[part, : steps[0]], na[0][part, None]]) @ lead
        i, j = np.divmod(np.flatnonzero(bound.ravel() >= np.float32(threshold) - slack), len(b))
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for lo in range(0, len(i), 200_000):
            x, y = i[lo : lo + 200_000], j[lo : lo + 200_000]
            for k, step in enumerate(steps[1:], 1):
                reach = np.einsum("ij,ij->i", fa[x, :step], fb[y, :step]) + na[k][x] * nb[k][y]
                keep = reach >= np.float32(threshold) - slack
                x, y = x[keep], y[keep]
            keep = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            if keep.any():
                yield x[keep], y[keep]


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each of ``n`` rows over links (x, y)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if (root == before).all():
            return root


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, j, width = (batch.column(c)[row].as_py() for c in ("i", "j", "width"))
                ids_a, ids_b = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in ("ids", "ids_2"))
                n_a, n_b = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in ("copies", "copies_2"))
                a, b = (_unit(_unpacked(batch.column(c)[row].as_py(), width, len(ids))) for c, ids in (("vectors", ids_a), ("vectors_2", ids_b)))
                count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                root = np.arange(len(a) + (0 if i == j else len(b)))
                for x, y in linked_pairs(a, b, axes[width], threshold, i == j):
                    count_a += np.bincount(x, n_b[y], len(a)).astype(np.int64)
                    count_b += np.bincount(y, n_a[x], len(b)).astype(np.int64)
                    shift = 0 if i == j else len(a)
                    root = _roots(len(root), np.concatenate([x, np.arange(len(root))]), np.concatenate([y + shift, root]))
                if i == j:
                    count_a, ids = count_a + count_b, ids_a
                    counted = [(ids_a, count_a)]
                else:
                    ids = np.concatenate([ids_a, ids_b])
                    counted = [(ids_a, count_a), (ids_b, count_b)]
                for who, n in counted:
                    some = np.flatnonzero(n)
                    yield pa.record_batch([pa.array(who[some]), pa.array(n[some]), pa.array(np.full(len(some), -1))], names=["node", "links", "other"])
                some = np.flatnonzero(root != np.arange(len(root)))
                yield pa.record_batch([pa.array(ids[some]), pa.array(np.zeros(len(some), np.int64)), pa.array(ids[root[some]])], names=["node", "links", "other"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One tile: ids, copies and vectors as bytes, and its box in the leading axes."""
    x = _matrix(table.column("vector").combine_chunks())
    points = np.stack(table.column("lead").to_numpy())
    return pa.table(
        {
            "tile": table.column("tile").slice(0, 1),
            "width": pa.array([x.shape[1]], pa.int32()),
            "ids": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
            "copies": pa.array([table.column("n").to_numpy().tobytes()], pa.binary()),
            "vectors": pa.array([x.tobytes()], pa.binary()),
            "low": pa.array([points.min(0).tolist()], pa.list_(pa.float64())),
            "high": pa.array([points.max(0).tolist()], pa.list_(pa.float64())),
        }
    )


_TILES = "tile string, width int, ids binary, copies binary, vectors binary, low array<double>, high array<double>"


def _tiles(nodes: DataFrame, tile: int, sample: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Tiles of ``nodes (node, vector, n)`` and the axes for each vector length."""
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    lengths = {r["width"]: r["count"] for r in nodes.groupBy(F.size("vector").alias("width")).count().collect()}
    axes: dict[int, np.ndarray] = {}
    trees: dict[int, list] = {}
    for width, count in lengths.items():
        same = nodes.filter(F.size("vector") == width).select("vector")
        chosen = same.filter(hash_draw("vector") < sample / count).toArrow()
        if not chosen.num_rows:  # few vectors, none drawn
            chosen = same.limit(1).toArrow()
        points = _unit(_matrix(chosen.column("vector").combine_chunks()))
        axes[width] = _axes(points)
        size = min(tile, max(1, math.ceil(count / (2 * math.sqrt(cores)))))  # pairs of tiles are then a few for each core
        trees[width] = _splits(points @ axes[width], math.ceil(count / size))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("vector").value_lengths().to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                points = _unit(_matrix(part.column("vector"))) @ axes[int(width)]
                leaf = np.ones(len(points), np.int64)
                _leaf(trees[int(width)], points, np.arange(len(points)), leaf)
                lead = points[:, :BOX_AXES]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("vector"), part.column("n"), pa.array([f"{width}.{x}" for x in leaf]), pa.array(lead.tolist(), pa.list_(pa.float64()))], names=["node", "vector", "n", "leaf", "lead"])

    kind = dict(nodes.dtypes)["vector"]
    dealt = written(nodes.mapInArrow(deal, f"node long, vector {kind}, n long, leaf string, lead array<double>"), "dealt")
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / tile).cast("long").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    tiled = dealt.join(sizes, "leaf").withColumn("tile", F.concat_ws("/", "leaf", chunk))
    return written(tiled.select("tile", "node", "vector", "n", "lead").groupBy("tile").applyInArrow(_pack, _TILES), "tiles"), axes


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs (i, j), i <= j, of tiles whose boxes allow a link: unit vectors at distance d have cosine 1 - d*d/2."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    cell = lambda c: F.floor(c / reach).cast("int")
    boxes = tiles.select("tile", "width", "low", "high")
    own = boxes.withColumn("cell", F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))))
    near = boxes.select(F.col("tile").alias("j"), "width", F.col("low").alias("low_2"), F.col("high").alias("high_2"), F.explode(F.sequence(cell(F.col("low")[0]) - 1, cell(F.col("high")[0]) + 1)).alias("cell"))
    gap = F.zip_with(F.zip_with("low", "high_2", lambda x, y: x - y), F.zip_with("low_2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    met = own.withColumnRenamed("tile", "i").join(near, ["width", "cell"]).filter("i <= j")
    close = met.filter(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= reach * reach).select("i", "j").distinct()
    swap = F.pmod(F.xxhash64("i"), F.lit(2)) != F.pmod(F.xxhash64("j"), F.lit(2))  # so that each tile is the right one of about half of its pairs
    return close.select(F.when(swap, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("j"))


def embedding_groups(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``embeddings (vec_id, embedding, ...)``: vec_id, n_links, component_id, kept.

    Two vectors link when the cosine in double precision is ``threshold`` or
    more. ``n_links`` counts the other rows a row links with, component_id is
    the smallest vec_id that links reach, itself included, kept is vec_id =
    component_id. Vectors that are null, empty, zero, or hold null or non-finite
    parts link with nothing, vectors of different lengths not with each other. A
    row with a null vec_id links like any other; its component_id is null only
    if its component has no other id. Repeated rows stay repeated and link with
    each other. An empty table gives no rows. ``threshold`` must be above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    prepare(embeddings)
    vector = F.col("embedding") if dict(embeddings.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).withColumn("usable", usable)
    good = rows.filter("usable").select("vec_id", "vector")
    nodes = written(good.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    tiles, axes = _tiles(nodes.select("node", "vector", "n"), tile, sample)
    left = tiles.select(F.col("tile").alias("i"), "width", "ids", "copies", "vectors")
    right = tiles.select(F.col("tile").alias("j"), F.col("ids").alias("ids_2"), F.col("copies").alias("copies_2"), F.col("vectors").alias("vectors_2"))
    paired = _tile_pairs(tiles, threshold).join(left, "i").join(right, "j")
    found = written(paired.mapInArrow(_compare(axes, threshold), "node long, links long, other long"), "links")
    links = found.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("links = 0").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    labelled = nodes.join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts = labelled.join(least, "root").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(facts, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
