"""Near copies by exact overlap of word shingles, without loss at any threshold.

A text is the set of its distinct five-word shingles (64-bit hashes). Two sets of
Jaccard similarity t or more share a shingle among the first n - ceil(t n) + 1 of
each, whatever order all sets are sorted by. These prefixes are posted in an
inverted index; pairs that meet are filtered by length and by the overlap that
their positions still allow, by the number of shingles that their whole prefixes
share (all that is shared up to the end of the prefix which ends first is counted,
so only that set's rest can add to it), and verified on the whole sets. The order puts
shingles that a fixed share of all texts holds often last, which keeps posting lists
short at every size; which shingles are found so changes the work only, never the links.

Lists are counted with partial sums and met by joins that adaptive execution can
split, so a shingle that a third of all texts hold meets in no single task. A list
above ``LONG_LIST`` links each member to one member of its own size class and one of
the next smaller: the one with the fewest rarer shingles, which in a group of copies
that were changed apart is nearest to the text they come from. Then only pairs whose
ends are still in different components are verified, so a dense group of near copies
costs rows in proportion to its members. Two texts that share a passage meet in many
lists; they are paired where the list before is not one that holds both as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hash_draw, matching, prepare, written
from tessera.llm.components import components

WORDS = 5
SIMILARITY = Fraction(4, 5)
#: Share of the documents that frequent shingles are counted in, whatever their number, and how many shingles are sent to the tasks.
COUNTED_SHARE = 1 / 8
FREQUENT = 400_000
#: Posting lists above this length are linked by components first; the result is the same.
LONG_LIST = 4

_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of word shingles; fewer words than one shingle are one; no word: empty."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_lower).split()
    if not words:
        return np.empty(0, np.uint64)
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    last = len(words) - width + 1
    mixed = np.full(last, width, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + of_word[k : last + k]
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _sets(docs: DataFrame, shingle: int, *columns: str) -> DataFrame:
    """``columns`` (long) and ``grams array<long>`` of rows with a ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams = pa.array([shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column("text")], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in columns), grams], names=[*columns, "grams"])
        pa.default_memory_pool().release_unused()

    return docs.select(*columns, "text").mapInArrow(run, "".join(f"{x} long, " for x in columns) + "grams array<long>")


def frequent_shingles(docs: DataFrame, shingle: int = WORDS) -> np.ndarray:
    """Shingles that two or more texts of ``COUNTED_SHARE`` of ``docs`` hold, the rarest first; ``FREQUENT`` of most texts at most."""
    chosen = docs.filter(hash_draw("text") < COUNTED_SHARE)
    counts = _sets(chosen, shingle).select(F.explode("grams").alias("gram")).groupBy("gram").count().filter("count > 1")
    found = counts.orderBy(F.desc("count"), "gram").limit(FREQUENT).toArrow()
    return found.column("gram").to_numpy()[::-1].copy()


def prefixes(docs: DataFrame, row: list[str], shingle: int = WORDS, similarity: Fraction = SIMILARITY, fingerprint=None) -> DataFrame:
    """``(row..., doc_id, fp, node, size, late: long, prefix array<long>)`` of every row; equal sets are one node.

    ``row`` names the long columns that identify a row of ``docs``; ``fp`` is
    ``fingerprint(text)``, an unsigned 64-bit number, or 0 without that function.
    Sets are sorted by (rank among frequent shingles, 0 for others; unsigned hash);
    ``late`` is that rank of the last shingle of the prefix.
    """
    prepare(docs)
    often = frequent_shingles(docs, shingle)
    order = np.argsort(often)
    ranked = often[order]
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                fps, nodes, sizes, lates, parts = [], [], [], [], []
                for value in batch.column("text"):
                    text = value.as_py()
                    grams = shingle_set(text, shingle)
                    fps.append(fingerprint(text) if fingerprint else 0)
                    nodes.append(xxhash.xxh64_intdigest(grams.tobytes()))
                    n = len(grams)
                    sizes.append(n)
                    grams = grams.view(np.int64)
                    end = n + (-p * n) // q + 1 if n else 0
                    late = np.zeros(n, np.int64)
                    if len(ranked) and n:
                        at = np.minimum(np.searchsorted(ranked, grams), len(ranked) - 1)
                        late = np.where(ranked[at] == grams, order[at] + 1, 0)
                        sort = np.argsort(late, kind="stable")
                        grams, late = grams[sort], late[sort]
                    lates.append(int(late[end - 1]) if n else 0)
                    parts.append(grams[:end])
                made = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)), pa.array(sizes, pa.int64()), pa.array(lates, pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (*row, "doc_id")), *made], names=[*row, "doc_id", "fp", "node", "size", "late", "prefix"])
            pa.default_memory_pool().release_unused()

    ids = "".join(f"{x} long, " for x in row)
    return docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ids + "doc_id long, fp long, node long, size long, late long, prefix array<long>")


def _possible(a: Column, b: Column, similarity: Fraction) -> Column:
    """Whether two postings, size << 32 | position, can be of a link: what follows them is enough."""
    p, q = similarity.numerator, similarity.denominator
    size = lambda x: F.shiftright(x, 32)
    left = F.least(size(a) - a.bitwiseAND(0xFFFFFFFF), size(b) - b.bitwiseAND(0xFFFFFFFF))
    return left * (p + q) >= p * (size(a) + size(b))


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, row: list[str], shingle: int, similarity: Fraction) -> DataFrame:
    """Those of ``pairs (a, b)`` whose whole sets reach the similarity, written."""
    p, q = similarity.numerator, similarity.denominator
    nodes = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = matching(rows.select("node", *row), written(nodes(pairs), "shingle-ends"), ["node"], "left_semi").groupBy("node").agg(F.min(F.struct(*row)).alias("r"))
    first = written(ids.select(*(F.col(f"r.{x}").alias(x) for x in row)), "shingle-ends")
    ended = written(matching(rows, first, row, "left_semi").select("node", *row, "size", "late", "prefix"), "shingle-ends")

    def both(pairs: DataFrame, ends: DataFrame) -> DataFrame:
        """``pairs``, written, with the columns of both ends; while pairs are few, only ends that a pair has are moved."""
        side = lambda x: ends.withColumnsRenamed({c: f"{c}_{x}" for c in ends.columns if c != "node"} | {"node": x})
        others = matching(side("b"), written(pairs.select("b").distinct(), "shingle-ends"), ["b"], "left_semi")
        return matching(side("a"), pairs, ["a"], "inner").join(others, "b")

    # Pairs carry 31 bits of each hash first: what those share, with what folding made equal, is no less than what is shared.
    folded = lambda x: F.transform(x, lambda g: g.bitwiseAND(0x7FFFFFFF).cast("int"))
    last = F.struct("late", F.coalesce(F.try_element_at("prefix", F.lit(-1)), F.lit(0)).bitwiseXOR(-(1 << 63)))
    rest = F.when(F.col("last_a") < F.col("last_b"), F.col("size_a") - F.size("prefix_a")).otherwise(F.col("size_b") - F.size("prefix_b"))
    most = F.size(F.array_intersect("prefix_a", "prefix_b")) + F.col("lost_a") + rest
    lost = lambda x: (F.size(x) - F.size(F.array_distinct(folded(x)))).alias("lost")
    likely = written(both(pairs, ended.select("node", "size", last.alias("last"), lost("prefix"), folded("prefix").alias("prefix"))).filter(most * (p + q) >= p * (F.col("size_a") + F.col("size_b"))).select("a", "b"), "shingle-likely")
    texts = matching(docs.select(*row, "text"), matching(ended.select("node", *row), written(nodes(likely), "shingle-ends"), ["node"], "left_semi"), row, "inner")
    sets = written(_sets(texts, shingle, "node"), "shingle-sets")

    def alike(pairs: DataFrame, grams: Column) -> DataFrame:
        joined = both(pairs, sets.select("node", F.size("grams").alias("size"), lost("grams"), grams.alias("grams")))
        return joined.filter((F.size(F.array_intersect("grams_a", "grams_b")) + F.col("lost_a")) * (p + q) >= p * (F.col("size_a") + F.col("size_b"))).select("a", "b")

    return written(alike(written(alike(likely, folded("grams")), "shingle-close"), F.col("grams")), "shingle-links")


def _ends(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def shingle_links(rows: DataFrame, docs: DataFrame, row: list[str], shingle: int = WORDS, similarity: Fraction = SIMILARITY, long_list: int = LONG_LIST) -> DataFrame:
    """Edges ``(a, b)`` between nodes of ``rows``, the written table that ``prefixes(docs, row)`` made.

    They are links (Jaccard similarity of the whole sets at ``similarity`` or
    more), and their components are those of all links.
    """
    posted = rows.select("node", F.shiftleft("size", 32).alias("of"), F.posexplode("prefix").alias("pos", "gram")).select("gram", "node", F.col("of").bitwiseOR(F.col("pos").cast("long")).alias("place"))
    lists = posted.groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    lists = written(lists, "shingle-lists")  # a list of two is a pair; members are gathered for longer ones only
    listed = written(matching(posted, lists.filter("n > 2").select("gram", "n"), ["gram"], "inner"), "shingle-postings")

    short = listed.filter(F.col("n") <= long_list).select("gram", "node", "place")
    other = lambda df: df.withColumnsRenamed({"node": "node_2", "place": "place_2"})
    paired = short.join(other(short), "gram").filter((F.col("node") < F.col("node_2")) & _possible(F.col("place"), F.col("place_2"), similarity))
    ratio = 1.000001 * math.log(similarity.denominator / similarity.numerator) if similarity < 1 else 1.0  # links are of the same or of neighbouring classes
    long = listed.filter(F.col("n") > long_list).withColumn("class", F.floor(F.log(F.shiftright("place", 32).cast("double")) / ratio).cast("int"))
    central = F.struct(F.col("place").bitwiseAND(0xFFFFFFFF), "node")  # with the fewest rarer shingles before this one
    hubs = long.groupBy("gram", "class").agg(F.min(central).alias("hub")).select("gram", "class", F.col("hub.node").alias("hub"))
    starred = long.select("gram", "node", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class")).join(hubs, ["gram", "class"]).filter("node <> hub")
    twos = lists.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    candidates = twos.unionByName(paired.select(*_ends("node", "node_2"))).unionByName(starred.select(*_ends("node", "hub"))).distinct()
    found = _verified(written(candidates, "shingle-pairs"), rows, docs, row, shingle, similarity)
    if long.isEmpty():
        return found

    roots = components(found, "shingle-components")
    rooted = long.drop("n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = rooted.groupBy("gram").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("gram")
    # Of the open lists that hold both ends, the first in the order of their prefixes is enough: there the lists before differ.
    before = F.coalesce(F.lag("gram").over(Window.partitionBy("node").orderBy("place")), F.col("node"))
    left = written(rooted.join(open_lists, "gram", "left_semi").withColumn("before", before), "shingle-open")
    near = left.withColumnsRenamed({"node": "node_2", "place": "place_2", "root": "root_2", "before": "before_2"}).withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    across = left.join(near, ["gram", "class"]).filter((F.col("root") < F.col("root_2")) & (F.col("before") != F.col("before_2")) & _possible(F.col("place"), F.col("place_2"), similarity))
    late = _verified(written(across.select(*_ends("node", "node_2")).distinct(), "shingle-pairs"), rows, docs, row, shingle, similarity)
    return found.unionByName(late)
