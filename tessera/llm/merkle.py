"""A Merkle manifest of a data set: source trees of 16-ary runs below one root (operator 13).

Every row is a leaf. The leaves of a source, in order, and then the roots of all
sources are the nodes of a tree: while several remain, every ``FAN`` consecutive
ones become the hash of their concatenated digests. A tree is walked in aligned
blocks of ``FAN ** HEIGHT`` nodes. One task visits a block recursively in postorder: a
visit returns the digest of its subtree and, while the calls unwind, appends the
digests beside each child to the leaves that the child contains. The roots of the
blocks, in order, are the nodes of the next walk, which Spark distributes again, until a
tree is one block.

Siblings of a block's root are those of all its leaves, so they are found once for
a block, on the way down. Leaves are visited twice: first for the roots of their
blocks, then, with what lies above their block at hand, for their proofs, so that no
proof of a leaf is ever stored or shuffled. Only narrow rows (ids and digests) move,
by block; a source that holds a third of all rows is as many blocks as it needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, prepare, translate_lower, written

FAN = 16
HEIGHT = 3


def digest(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()


def visit_block(nodes: list[str], height: int, fan: int = FAN) -> tuple[str, list[list[str]]]:
    """The root of ``nodes`` after ``height`` levels, and per node what stands left and right of its path: [left, right, left, right, ...] from below.

    A run of one node has nothing on either side and becomes a hash as well.
    """
    sides: list[list[str]] = [[] for _ in nodes]

    def visit(start: int, height: int) -> str:
        if height == 0:
            return nodes[start]
        width = fan ** (height - 1)
        starts = range(start, min(start + fan * width, len(nodes)), width)
        children = [visit(s, height - 1) for s in starts]
        for k, s in enumerate(starts):
            left, right = "".join(children[:k]), "".join(children[k + 1 :])
            for contained in sides[s : s + width]:
                contained += (left, right)
        return digest("".join(children))

    return visit(0, height), sides


def fold(node: str, sides: list[str]) -> str:
    """The root over ``node`` between the siblings of its path."""
    for left, right in zip(sides[::2], sides[1::2], strict=True):
        node = digest(left + node + right)
    return node


def height_of(size: int, fan: int = FAN, most: int = HEIGHT) -> int:
    """Levels until one of ``size`` nodes is left, at most ``most``."""
    height = 0
    while size > 1 and height < most:
        size, height = -(-size // fan), height + 1
    return height


def ordered(rows: DataFrame, tree: str, *by: Column | str) -> DataFrame:
    """``rows``, a written table, with ``idx`` (place within ``tree`` in the order of ``by``, from 0) and ``size`` (rows of the tree); written.

    Rows are dealt by ranges of the whole order, so a large tree fills many
    tasks. A task numbers its own rows; counts of (task, tree) give where each begins.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, tree, *by).sortWithinPartitions(tree, *by)
    dealt = written(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)), "ordered")
    runs = dealt.groupBy(tree, "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    one = Window.partitionBy(tree)
    runs = runs.withColumn("begin", F.sum("n").over(one.orderBy("task")) - F.col("n") - F.col("first")).withColumn("size", F.sum("n").over(one))
    runs = written(runs.select(tree, "task", "begin", "size"), "order-begins")
    placed = dealt.join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, [tree, "task"])
    return written(placed.withColumn("idx", F.col("begin") + F.col("place")).drop("begin", "place", "task"), "placed")


def _block(width: int) -> Column:
    return F.floor(F.col("idx") / width).cast("long").alias("block")


def _roots(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """``(tree, idx, size, node)`` of the blocks of ``nodes`` of the same columns; written."""
    width = fan**height

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        size = int(block["size"].iloc[0])
        root, _ = visit_block(block["node"].tolist(), height_of(size, fan, height), fan)
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "idx": block["idx"].iloc[:1] // width, "size": -(-size // width), "node": root})

    return written(nodes.select("tree", "idx", "size", "node").groupBy("tree", _block(width)).applyInPandas(run, "tree string, idx long, size long, node string"), "block-roots")


def _between(nodes: DataFrame, above: DataFrame, finish: Callable[[pd.DataFrame, list[list[str]], pd.Series], pd.DataFrame], ddl: str, fan: int, height: int) -> DataFrame:
    """Every block of ``nodes`` visited once more, with its row of ``above``: what ``finish`` makes of the rows and their sides up to the root."""
    width = fan**height

    def run(block: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx").reset_index(drop=True)
        _, sides = visit_block(block["node"].tolist(), height_of(int(block["size"].iloc[0]), fan, height), fan)
        last = top.iloc[0]
        for path in sides:
            path.extend(last["sides"])
        return finish(block, sides, last)

    return nodes.groupBy("tree", _block(width)).cogroup(above.groupBy("tree", F.col("idx").alias("block"))).applyInPandas(run, ddl)


_ABOVE = "tree string, idx long, root string, sides array<string>"


def paths(nodes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """``(tree, idx, root, sides)`` of ``nodes (tree, idx, size, node)``, a written table: the root of each node's tree and what stands beside the path to it; written."""
    if nodes.filter("size > 1").isEmpty():
        return nodes.select("tree", "idx", F.col("node").alias("root"), F.array().cast("array<string>").alias("sides"))
    above = paths(_roots(nodes, fan, height), fan, height)

    def finish(block: pd.DataFrame, sides: list[list[str]], last: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tree": block["tree"], "idx": block["idx"], "root": last["root"], "sides": sides})

    return written(_between(nodes, above, finish, _ABOVE, fan, height), "paths")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text)]), 256)


def tampered(doc_id: Column) -> Column:
    """5 divides the crc32 of the id in decimal; a null id is not touched."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def manifest(docs: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """Per row of ``docs (doc_id, source, lang, n_chars, text)``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes the five columns, each ``-`` if null, else its UTF-8 length, ``:``
    and itself. Leaves of a source ascend by doc_id, null first, then by leaf;
    equal rows are equal leaves side by side. ``subroot`` is the root of the
    source, ``root`` that of all sources in order, null first. ``proof_sha256`` hashes the
    siblings from the leaf up to the root. ``folded_root`` is the root over the leaf of
    the row as found later, here with the letters A-Z of its text lower-cased where
    ``tampered``, between the original siblings; ``verified`` tells whether it is still the
    root. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    prepare(docs)
    found = F.when(tampered(F.col("doc_id").cast("long")), translate_lower(F.col("text"))).otherwise(F.col("text"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # the null source is before all others
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), _leaf(F.col("text")).alias("node"), _leaf(found).alias("found"))
    leaves = ordered(written(leaves, "leaves"), "tree", "doc_id", "node")
    if leaves.isEmpty():
        return leaves.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))

    blocks = paths(_roots(leaves, fan, height), fan, height)
    sources = written(blocks.filter("idx = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node")), "subroots")
    sources = ordered(sources, "tree", "source")
    top = paths(sources, fan, height).select("idx", F.col("root").alias("whole"), F.col("sides").alias("over"))
    top = sources.select("idx", F.col("source").alias("tree")).join(top, "idx").drop("idx")
    above = written(blocks.join(top, "tree").select("tree", "idx", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("sides", "over").alias("sides")), "block-paths")

    def finish(block: pd.DataFrame, sides: list[list[str]], last: pd.Series) -> pd.DataFrame:
        proofs = [digest("".join(path)) for path in sides]
        folded = [fold(leaf, path) for leaf, path in zip(block["found"], sides, strict=True)]
        out = block[["doc_id", "node"]].assign(subroot=last["subroot"], root=last["root"], proof_sha256=proofs, folded_root=folded)
        return out.assign(verified=out["folded_root"] == out["root"]).rename(columns={"node": "leaf"})

    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _between(leaves, above, finish, ddl, fan, height)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


#: The crc32 of a short text, bit by bit: the polynomial is a fixed value.
_CRC_SQL = """xor(4294967295, list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::UBIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, _: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))"""

MERKLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC_SQL} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS found
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM rows),
up AS (
  SELECT 0 AS level, tree, idx, size, leaf AS node FROM leaves
  UNION ALL
  SELECT level + 1, tree, idx // 16, (size + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM up WHERE size > 1 GROUP BY level, tree, idx // 16, size),
subroots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM up WHERE size = 1),
top AS (
  SELECT 0 AS level, idx, size, node FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM top WHERE size > 1 GROUP BY level, idx // 16, size),
beside AS (
  SELECT a.level, a.tree, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM up a JOIN up b ON a.level = b.level AND a.tree = b.tree AND a.idx // 16 = b.idx // 16 WHERE a.size > 1 GROUP BY ALL),
above AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.size > 1 GROUP BY ALL),
steps AS (
  SELECT x.tree, x.idx, level AS step, l, r FROM leaves x JOIN beside b ON b.tree = x.tree AND b.idx = x.idx // (16 ** level)::BIGINT
  UNION ALL
  SELECT x.tree, x.idx, 100 + level, l, r FROM leaves x JOIN subroots s ON s.tree = x.tree JOIN above b ON b.idx = s.idx // (16 ** level)::BIGINT),
proofs AS (SELECT tree, idx, sha256(coalesce(string_agg(l || r, '' ORDER BY step), '')) AS proof_sha256, list(l ORDER BY step) AS ls, list(r ORDER BY step) AS rs FROM steps GROUP BY tree, idx),
folds AS (
  SELECT x.tree, x.idx, x.found AS node, ls, rs FROM leaves x LEFT JOIN proofs p ON p.tree = x.tree AND p.idx = x.idx
  UNION ALL
  SELECT tree, idx, sha256(ls[1] || node || rs[1]), ls[2:], rs[2:] FROM folds WHERE len(ls) > 0)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = t.node AS verified
FROM leaves x
JOIN subroots s ON s.tree = x.tree
JOIN top t ON t.size = 1
LEFT JOIN proofs p ON p.tree = x.tree AND p.idx = x.idx
JOIN folds f ON f.tree = x.tree AND f.idx = x.idx AND coalesce(len(f.ls), 0) = 0
"""
