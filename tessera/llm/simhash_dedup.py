"""SimHash near-dedup with a byte-position inverted index (operator 6).

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in
at most r bits agree in at least 8 - r of those bytes: the guaranteed minimum of
matches (five for r = 3). The index posts every fingerprint under each set of one
byte less than that, with their positions (four bytes, 32 bits: lists of single
bytes would hold a 256th of the corpus each). The postings that a pair shares are
tallied; m shared bytes make C(m, 4) of them. Pairs with fewer than the minimum
of five shared bytes make, 5, are dropped, the rest is verified on the bits.

Documents with equal fingerprints are one node. A posting list above
``SHORT_LIST`` (a dense group of near copies) is not paired but refined by a
further byte, which such a pair shares too; a refined list above ``LONG_LIST`` links
its members through hubs, by flipping one bit on one side and up to two on the
other inside the bytes that are free. Every edge made so is a true link and no
component is lost, with rows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import identified, matching, prepare, settled, text_batches, written
from tessera.llm.components import components
from tessera.llm.shingle_links import prefixes, shingle_links

SEED = 42
#: Posting lists above the first length are refined by a byte, refined lists above the second link through hubs; the result is the same.
SHORT_LIST = 64
LONG_LIST = 512

_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of word shingles, repeats included: bit set in over half the hashes; no word: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_lower).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    ones, n, step = np.zeros(64, np.int64), len(words) - shingle + 1, 1 << 16
    for at in range(0, n, step):  # a slice at a time: memory does not follow the text's length
        to = min(n, at + step)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, row: list[str], shingle: int = 3) -> DataFrame:
    """``(row..., doc_id long, fp long)`` of every row; ``row`` names the long columns that identify one."""
    prepare(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (*row, "doc_id")), pa.array(out.view(np.int64))], names=[*row, "doc_id", "fp"])

    ids = "".join(f"{x} long, " for x in row)
    return docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ids + "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_sets(sets: list[tuple[int, ...]]) -> list[int]:
    """For each 8-bit map of matching positions, the first set inside it, or -1."""
    return [next((i for i, s in enumerate(sets) if all(m >> p & 1 for p in s)), -1) for m in range(256)]


def _posted(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """``(positions, bytes, fp)``: every fingerprint under each set of positions."""
    masks = F.array(*[F.lit(_signed(sum(0xFF << 8 * p for p in s))) for s in sets])
    return nodes.select("fp", F.posexplode(masks).alias("positions", "mask")).select("positions", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")


def _listed(posted: DataFrame, name: str) -> DataFrame:
    """Postings of lists with two members or more, with the list's length ``n``; written."""
    size = posted.groupBy("positions", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    return written(posted.join(size, ["positions", "bytes"]), name)


def _met(short: DataFrame) -> DataFrame:
    pairs = short.withColumnRenamed("fp", "a").join(short.select("positions", "bytes", F.col("fp").alias("b")), ["positions", "bytes"])
    return pairs.filter("a < b").withColumn("x", F.col("a").bitwiseXOR(F.col("b")))


def _dense_links(members: DataFrame, max_bits: int, long_list: int) -> DataFrame:
    """Edges inside dense groups, over postings of the whole guaranteed minimum of bytes."""
    sets = list(combinations(range(8), 8 - max_bits))
    listed = _listed(_posted(members, sets), "dense-postings")
    matching = F.lit(0)
    for p in range(8):
        matching = matching + F.when(F.col("x").bitwiseAND(_signed(0xFF << 8 * p)) == 0, 1 << p).otherwise(0)
    first = F.element_at(F.array(*map(F.lit, _first_sets(sets))), matching + 1)
    pairs = _met(listed.filter(F.col("n") <= long_list)).filter(F.bit_count("x") <= max_bits).filter(F.col("positions") == first).select("a", "b")

    flips = [0, *(1 << i for i in range(8 * max_bits))]
    reach = 1 if max_bits > 1 else 0  # of a hub; a member reaches the rest
    if max_bits == 3:
        flips += [1 << i | 1 << j for i, j in combinations(range(8 * max_bits), 2)]
    moved = F.lit(0).cast("long")
    for k in range(max_bits):  # the k-th byte of a flip goes to the k-th free position
        shift = F.element_at(F.array(*[F.lit(8 * [p for p in range(8) if p not in s][k]) for s in sets]), F.col("positions") + 1)
        moved = moved.bitwiseOR(F.call_function("shiftleft", F.shiftright("flip", 8 * k).bitwiseAND(255), shift))
    flipped = listed.filter(F.col("n") > long_list).select("positions", "bytes", "fp", F.explode(F.array(*[F.lit(m).cast("long") for m in flips])).alias("flip")).withColumn("meet", F.col("fp").bitwiseXOR(moved))
    hubs = flipped.filter(F.bit_count("flip") <= reach).groupBy("positions", "bytes", "meet").agg(F.min("fp").alias("hub"))
    starred = flipped.join(hubs, ["positions", "bytes", "meet"]).filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(starred)


def links(nodes: DataFrame, max_bits: int = 3, short_list: int = SHORT_LIST, long_list: int = LONG_LIST) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``nodes (fp long)``.

    They are links (at most ``max_bits`` differing bits, 0 to 3), and their
    components are those of all links.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    least = 8 - max_bits
    sets = list(combinations(range(8), least - 1))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = _posted(nodes.repartition(parts, "fp"), sets)  # narrow rows: dealt over all tasks before they are multiplied
    lists = posted.groupBy("positions", "bytes").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    lists = written(lists, "posting-lists")  # a list of two is a pair; members are gathered for longer ones only
    longer = written(matching(posted, lists.filter("n > 2").select("positions", "bytes", "n"), ["positions", "bytes"], "inner"), "postings")
    met = lists.filter("n = 2").select("a", "b").unionByName(_met(longer.filter(F.col("n") <= short_list)).select("a", "b"))
    tally = met.groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = tally.filter(F.col("shared") >= comb(least, least - 1)).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    dense = longer.filter(F.col("n") > short_list).select("fp").distinct()
    return pairs.unionByName(_dense_links(dense.repartition(parts, "fp"), max_bits, long_list)).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Per row of ``docs (doc_id, text, ...)``: doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is
    the smallest doc_id that links reach, itself included. Null and word-less
    texts have fingerprint zero and link like any other. A null doc_id takes
    part in links but is never a component_id unless the component has no other.
    ``kept`` is true for exactly one row of each component, one of the smallest
    doc_id. Repeated rows stay repeated. An empty table gives no rows.
    """
    return _groups(*identified(docs), shingle, max_bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")


def _groups(docs: DataFrame, row: list[str], shingle: int, max_bits: int) -> DataFrame:
    found = written(fingerprints(docs, row, shingle), "fingerprints")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", *row)
    nodes = written(found.groupBy("fp").agg(F.min(place).alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), max_bits), "simhash-components")
    labelled = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = labelled.drop("first").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), *(F.col(f"first.{x}").alias(f"{x}_kept") for x in row))
    kept = F.lit(True)
    for x in row:
        kept = kept & (F.col(x) == F.col(f"{x}_kept"))
    return found.join(of_fp, "fp").withColumn("kept", kept)


def _without(docs: DataFrame, row: list[str], dropped: Callable[[], DataFrame]) -> DataFrame:
    return matching(docs, settled(lambda: dropped().select(*row), "dropped"), row, "left_anti").drop(*row)


def simhash_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id, nulls last; all columns are kept."""
    docs, row = identified(docs)
    return _without(docs, row, lambda: _groups(docs, row, shingle, max_bits).filter("not kept"))


def near_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id, nulls last; all columns are kept.

    Documents link by fingerprint, as in ``simhash_groups``, and by a Jaccard
    similarity of 0.8 or more of their five-word shingles, which three of 64
    bits do not reach. The second links are exact: none is lost. Null and
    word-less texts are one group; of repeated rows one stays; an empty table
    stays empty.
    """
    docs, row = identified(docs)
    with text_batches(docs.sparkSession):
        return _without(docs, row, lambda: _near_copies(docs, row, shingle, max_bits))


def _near_copies(docs: DataFrame, row: list[str], shingle: int, max_bits: int) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` drops."""
    rows = written(prefixes(docs, row, fingerprint=lambda text: fingerprint(text, shingle)), "shingle-prefixes")
    same = components(links(rows.select("fp").distinct(), max_bits), "simhash-components")
    held = written(rows.select(*row, "doc_id", "node", "fp").join(same.withColumnRenamed("node", "fp"), "fp", "left").withColumn("of", F.coalesce("root", "fp")).drop("fp", "root"), "near-rows")
    hubs = held.groupBy("of").agg(F.min("node").alias("b"))
    by_bits = held.join(hubs, "of").filter("node <> b").select(F.col("node").alias("a"), "b")
    roots = components(by_bits.unionByName(shingle_links(rows, docs, row)), "near-components")
    labelled = held.drop("of").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *row)).alias("least"))
    stays = F.lit(True)
    for x in row:
        stays = stays & (F.col(x) == F.col(f"least.{x}"))
    return labelled.join(least, "root").filter(~stays)
