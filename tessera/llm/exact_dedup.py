"""Exact dedup on a cuckoo-filter index of text digests (operator 3).

The index answers "is this digest live?" from 16-bit tags in buckets of four.
A tag hit is only a candidate: it is compared with the stored key. Digests can be
inserted and deleted; an overflow of the buckets resizes the table from the stored
keys. In Spark, each scan partition runs its rows through an index of its own,
which pre-aggregates copies before the shuffle (a group holding a third of all
rows becomes one row a partition), and each hash partition of digests merges
those partial groups through a second index. Then hits are verified against
content: the whole texts of groups of two rows or more, no others, are bucketed
by digest and compared; rows that only share a digest are grouped by content.
``SavedIndex`` keeps live digests in a table, with insertion and deletion.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import identified, matching, prepare, settled, squeezed, text_or_empty, written

SLOTS = 4
MAX_KICKS = 200
#: Digests that one task's index holds: a scan hands on what it has and begins again, a merge is dealt over more tasks.
MAX_ENTRIES = 400_000


class CuckooIndex:
    """A set of live digests, each with a value; ``digest`` is bytes of 16 or more."""

    def __init__(self, buckets: int = 256) -> None:
        self._live = 0
        self.resizes = 0
        self.tag_hits = 0
        self.keys: list[bytes | None] = []
        self.values: list = []
        self._free: list[int] = []
        self._build(max(2, 1 << (buckets - 1).bit_length()))

    def __len__(self) -> int:
        return self._live

    def _build(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.refs = [-1] * (buckets * SLOTS)

    @staticmethod
    def _tag(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little") & self.mask

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        """The slot that holds ``digest``, verified against the stored key, or -1."""
        tag, first = self._tag(digest), self._home(digest)
        for bucket in (first, self._other(first, tag)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag:
                    self.tag_hits += 1
                    if self.keys[self.refs[slot]] == digest:
                        return slot
        return -1

    def get(self, digest: bytes):
        """The value of a live digest, or None."""
        slot = self._slot(digest)
        return None if slot < 0 else self.values[self.refs[slot]]

    def _place(self, digest: bytes, ref: int) -> bool:
        tag, bucket = self._tag(digest), self._home(digest)
        for _ in range(MAX_KICKS):
            for b in (bucket, self._other(bucket, tag)):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.tags[slot]:
                        self.tags[slot], self.refs[slot] = tag, ref
                        return True
            bucket = self._other(bucket, tag)
            slot = bucket * SLOTS + (ref + _) % SLOTS
            (self.tags[slot], tag), (self.refs[slot], ref) = (tag, self.tags[slot]), (ref, self.refs[slot])
            bucket = self._other(bucket, tag)
        return False

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live; where it is, its value is replaced."""
        slot = self._slot(digest)
        if slot >= 0:
            self.values[self.refs[slot]] = value
            return
        if self._free:
            ref = self._free.pop()
            self.keys[ref], self.values[ref] = digest, value
        else:
            ref = len(self.keys)
            self.keys.append(digest)
            self.values.append(value)
        self._live += 1
        if self._live > 0.94 * SLOTS * (self.mask + 1) or not self._place(digest, ref):
            self._resize()

    def _resize(self) -> None:
        """Twice the buckets, filled again from the stored keys; again if that overflows too."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._build(buckets)
            if all(key is None or self._place(key, ref) for ref, key in enumerate(self.keys)):
                return

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it is not live."""
        slot = self._slot(digest)
        if slot < 0:
            return False
        ref = self.refs[slot]
        self.tags[slot], self.refs[slot] = 0, -1
        self.keys[ref] = self.values[ref] = None
        self._free.append(ref)
        self._live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _grouped(row: list[str], most: int = 0):
    """A function that merges (digest, n_chars, doc_id, row..., group_size) rows by digest through an index; from ``most`` digests on, in parts."""

    names = ["digest", "n_chars", "doc_id", *row, "group_size"]
    types = [pa.binary(), *[pa.int64()] * 5]

    def handed_on(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
        found = index.items()
        while rows := [(k, -r[0], None if r[1] else r[2], r[3], r[4], size) for k, (r, size) in itertools.islice(found, 50_000)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, n, doc_id, file, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rank = (-n, doc_id is None, doc_id or 0, file, at)
                known = index.get(digest)
                if known is None:
                    index.insert(digest, [rank, size])
                else:
                    known[1] += size
                    if rank < known[0]:
                        known[0] = rank
            if most and len(index) > most:
                yield from handed_on(index)
                index = CuckooIndex()
        yield from handed_on(index)

    return run


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _content() -> Column:
    return squeezed(text_or_empty())


def false_hits(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``(digest)`` of those ``groups`` of two rows or more under which contents differ.

    Only rows of such groups are looked at. Their whole contents meet in the
    bucket of their digest, one row for each content and task.
    """
    shared = written(groups.filter("group_size > 1").select("digest"), "shared-digests")
    rows = matching(docs.select(digest(_content()).alias("digest"), _content().alias("content")), shared, ["digest"], "left_semi")
    return rows.groupBy("digest", "content").count().groupBy("digest").count().filter("count > 1").select("digest")


def _by_content(docs: DataFrame, row: list[str], bad: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Groups of the rows under digests with false hits, by their contents themselves."""
    rows = matching(docs.select("doc_id", *row, F.char_length(text_or_empty()).cast("long").alias("n"), digest(_content()).alias("digest"), _content().alias("content")), bad, ["digest"], "left_semi")
    rows = written(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "false-hits")
    groups = rows.groupBy("digest", "content").agg(F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id", *row)).alias("keep"), F.count("*").alias("group_size"))
    return rows.join(groups, ["digest", "content"]).select(
        "doc_id", *row, sha256(F.col("content")).alias("sha"), F.col("keep.doc_id").alias("keep_id"), *(F.col(f"keep.{x}").alias(f"{x}_keep") for x in row), "group_size"
    )


def _groups(docs: DataFrame, row: list[str], digest: Callable[[Column], Column]) -> DataFrame:
    """``(doc_id, row..., sha, keep_id, row_keep..., group_size, kept)`` of every row of ``docs``."""
    sums = [digest(_content()).alias("digest")] if digest is sha256 else [digest(_content()).alias("digest"), sha256(_content()).alias("sha")]
    keys = written(docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text_or_empty()).cast("long").alias("n_chars"), *sums), "digests")
    columns, ddl = ["digest", "n_chars", "doc_id", *row], "digest binary, n_chars long, doc_id long, " + "".join(f"{x} long, " for x in row) + "group_size long"
    partial = keys.select(*columns, F.lit(1).cast("long").alias("group_size")).mapInArrow(_grouped(row, MAX_ENTRIES), ddl)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // MAX_ENTRIES))
    groups = written(partial.repartition(tasks, "digest").mapInArrow(_grouped(row), ddl), "digest-groups")
    found = groups.select("digest", F.col("doc_id").alias("keep_id"), *(F.col(x).alias(f"{x}_keep") for x in row), "group_size")
    sha = F.col("digest") if digest is sha256 else F.col("sha")
    joined = keys.join(found, "digest").select("doc_id", *row, sha.alias("sha"), "keep_id", *(f"{x}_keep" for x in row), "group_size", "digest")
    bad = written(false_hits(docs, groups, digest), "false-digests")
    if bad.isEmpty():
        joined = joined.drop("digest")
    else:
        joined = joined.join(bad, "digest", "left_anti").drop("digest").unionByName(_by_content(docs, row, bad, digest))
    kept = F.lit(True)
    for x in row:
        kept = kept & (F.col(x) == F.col(f"{x}_keep"))
    return joined.withColumn("kept", kept)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row of ``docs (doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (0x20, 0x09 to 0x0D); a
    null text counts as empty. Of equal texts the row with most code points
    stays, then the smallest doc_id, a null doc_id last; of rows that are equal
    in that as well exactly one stays. Other columns are ignored, whatever
    their names. An empty table gives no rows. ``digest`` makes the key of a
    content (16 bytes or more); contents that share one by chance are told apart.
    """
    prepare(docs)
    return _groups(*identified(docs), digest).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; all columns are kept. An empty table stays empty."""
    prepare(docs)
    docs, row = identified(docs)
    dropped = settled(lambda: _groups(docs, row, digest).filter("not kept").select(*row), "dropped")
    return matching(docs, dropped, row, "left_anti").drop(*row)


_LIVE = "digest binary, content string, doc_id long, copies long"


class SavedIndex:
    """Live documents of a growing and shrinking corpus by digest, as a Parquet table below ``path``.

    A row of ``live`` is (digest, content, doc_id, copies): how often a document of
    that content and id was inserted and not deleted. ``update`` deals stored and changed rows to
    ``buckets`` by digest. In each, the changed digests fill a cuckoo index and the
    stored rows pass by it: a hit is verified against the content, what hits nothing goes on
    as it is, so memory follows the change and not the corpus. The next version is written
    beside the last; the last complete one counts, and none is written twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, digest: Callable[[Column], Column] = sha256) -> None:
        self.spark, self.path, self.buckets, self.digest = spark, path.rstrip("/"), buckets, digest

    def _version(self) -> int:
        """The last complete version, or 0."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        found = done.getFileSystem(conf).globStatus(done) or []
        return max((int(x.getPath().getParent().getName()[1:]) for x in found), default=0)

    def live(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(_LIVE).parquet(f"{self.path}/v{version}") if version else self.spark.createDataFrame([], _LIVE)

    def _keyed(self, docs: DataFrame) -> DataFrame:
        keyed = docs.select(self.digest(_content()).alias("digest"), _content().alias("content"), F.col("doc_id").cast("long").alias("doc_id"))
        return keyed.groupBy("digest", "content", "doc_id").agg(F.count("*").alias("copies"))

    def update(self, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Delete the documents ``deleted (doc_id, text)``, then insert ``inserted``; null texts count as empty.

        A deletion takes one copy of that content and id, and nothing where none is
        live. A content is live while any copy of it is.
        """
        prepare(self.live())
        rows = self.live().withColumn("step", F.lit(2))
        for step, docs in ((0, deleted), (1, inserted)):
            if docs is not None:
                rows = rows.unionByName(self._keyed(docs).withColumn("step", F.lit(step)))
        types = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
        names = ["digest", "content", "doc_id", "copies"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = CuckooIndex()  # digest -> {(content, doc_id): [deleted, inserted]}
            for batch in batches:
                out = []
                for digest, content, doc_id, copies, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    changes = index.get(digest)
                    if step == 2:
                        gone, come = (changes or {}).pop((content, doc_id), (0, 0))
                        if (left := max(0, copies - gone) + come) > 0:
                            out.append((digest, content, doc_id, left))
                        continue
                    if changes is None:
                        index.insert(digest, changes := {})
                    changes.setdefault((content, doc_id), [0, 0])[step] += copies
                if out:
                    yield packed(out)
            new = ((digest, content, doc_id, come) for digest, changes in index.items() for (content, doc_id), (_, come) in changes.items() if come)
            while out := list(itertools.islice(new, 1000)):
                yield packed(out)

        bucket = F.pmod(F.xxhash64("digest"), F.lit(self.buckets))
        dealt = rows.select(*names, "step").repartition(self.buckets, bucket).sortWithinPartitions("step")
        dealt.mapInArrow(run, _LIVE).write.parquet(f"{self.path}/v{self._version() + 1}")

    def owners(self, docs: DataFrame) -> DataFrame:
        """Per row of ``docs (doc_id, text)``: doc_id and owner_id, the smallest live id of its content, null where none is live or has an id."""
        asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), self.digest(_content()).alias("digest"), _content().alias("content"))
        digests = written(asked.select("digest").distinct(), "asked-digests")
        held = matching(self.live(), digests, ["digest"], "left_semi").groupBy("digest", "content").agg(F.min("doc_id").alias("owner_id"))
        return asked.join(held, ["digest", "content"], "left").select("doc_id", "owner_id")


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
