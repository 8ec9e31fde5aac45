"""Token ids as binary shards with a shared zstandard dictionary (operator 5).

A data set is a folder: ``dictionary``, and for each shard ``shard-N.tok`` and
``shard-N.idx``. A ``.tok`` file starts with a 48-byte header (magic, id width,
SHA-256 of the dictionary) and holds one zstandard frame for each document, each
compressed on its own with the shared dictionary. The ``.idx`` file is the
offset index: per document its id, the frame's offset and length, and the number
of tokens; a single short document is read with two seeks. Shards are ranges of
the document id in ascending order.

The dictionary is trained on the first ``SAMPLE_BYTES`` of the serialised ids of
about ``SAMPLE_DOCS`` documents (by a hash of id and text, at most twice as many);
it changes sizes, never contents.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import hash_draw, prepare, scratch_path, written

#: Fixed values of the format.
MAGIC = b"TSRTOK01"
HEADER = struct.Struct("<8sI4x32s")
ENTRY = struct.Struct("<qBQII")  # a row of INDEX
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<u1"), ("offset", "<u8"), ("bytes", "<u4"), ("n_tokens", "<u4")])

END_ID = 2
SAMPLE_DOCS = 500
SAMPLE_BYTES = 64 * 1024
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3


def serialised(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids as ids of ``width`` bytes; an id that needs more is a ValueError."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"id {wide.max()} does not fit 2 bytes")
    return wide.astype("<u2").tobytes()


def widened(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def index_entry(doc_id: int | None, offset: int, size: int, n_tokens: int) -> bytes:
    """A row of INDEX."""
    return ENTRY.pack(doc_id or 0, doc_id is not None, offset, size, n_tokens)


def train(samples: list[bytes]) -> bytes:
    """Dictionary bytes; a raw-content dictionary where there is too little to train on."""
    import zstandard

    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _store(uri: str, name: str, data: Iterable[bytes]) -> None:
    """Write under another name, then rename: a task that is tried again leaves whole files only."""
    files, base = _files(uri)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        for x in data:
            out.write(x)
    files.move(draft, f"{base}/{name}")


def _load(uri: str, name: str) -> bytes:
    files, base = _files(uri)
    with files.open_input_stream(f"{base}/{name}") as source:
        return source.read()


#: Bytes of text that a shard holds on average at most, unless the number of shards is given.
SHARD_BYTES = 256 << 20


def write_tokens(docs: DataFrame, uri: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None, id_width: int | None = None) -> DataFrame:
    """Write ``docs (doc_id, text, ...)`` below ``uri``, a folder that all executors reach.

    Returns ``(shard, n_docs, n_tokens, start)``, one row a shard; ``start``
    counts the tokens of all shards before. A null text is empty, so its only
    token is ``end_id``; null ids come first; repeated rows are written as often
    as they occur. ``id_width`` is 2 or 4 bytes, by default what the vocabulary
    and ``end_id`` need; an id that does not fit is an error, never cut. Rows of
    one id are dealt on by their text's hash, so none fills a shard.
    """
    spark = prepare(docs)
    path = path or bpe.default_path()
    if id_width is None:
        id_width = 2 if max(end_id, bpe.encoder(path).largest_id) <= 0xFFFF else 4
    if id_width not in (2, 4):
        raise ValueError("id_width must be 2 or 4")
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sample_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([serialised(x + end, id_width)[:SAMPLE_BYTES] for x in bpe.encoded(batch.column("text"), path)], pa.binary())], names=["ids"])

    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    chosen = rows.filter(hash_draw("doc_id", "text") < SAMPLE_DOCS / max(1, size["n"])).select("text").limit(2 * SAMPLE_DOCS)
    raw = train([bytes(r["ids"]) for r in chosen.mapInArrow(sample_ids, "ids binary").collect()])
    files, base = _files(uri)
    files.create_dir(base, recursive=True)
    _store(uri, "dictionary", [raw])
    head = HEADER.pack(MAGIC, id_width, hashlib.sha256(raw).digest())

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_content_size=True)
        index, tokens = bytearray(), 0

        def frames() -> Iterator[bytes]:
            nonlocal tokens
            yield head
            at = len(head)
            for batch in itertools.chain([first], batches):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encoded(batch.column("text"), path), strict=True):
                    frame = press.compress(serialised(ids + end, id_width))
                    index.extend(index_entry(doc_id, at, len(frame), len(ids) // 4 + 1))
                    tokens += len(ids) // 4 + 1
                    at += len(frame)
                    yield frame

        _store(uri, f"shard-{shard}.tok", frames())
        _store(uri, f"shard-{shard}.idx", [bytes(index)])
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([len(index) // INDEX.itemsize], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = written(ranged.mapInArrow(write, "shard long, n_docs long, n_tokens long"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return made.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """Reader of one shard; documents by position, each decompressed on its own."""

    def __init__(self, uri: str, shard: int, dictionary: bytes | None = None) -> None:
        import zstandard

        raw = _load(uri, "dictionary") if dictionary is None else dictionary
        self.index = np.frombuffer(_load(uri, f"shard-{shard}.idx"), INDEX)
        files, base = _files(uri)
        self._file = files.open_input_file(f"{base}/shard-{shard}.tok")
        magic, self.width, digest = HEADER.unpack(self._file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"shard {shard} is no token file")
        if digest != hashlib.sha256(raw).digest():
            raise ValueError(f"shard {shard} was written with another dictionary")
        self._press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def ids(self, position: int) -> bytes:
        """Ids of the document at ``position`` as little-endian 32-bit integers."""
        entry = self.index[position]
        self._file.seek(int(entry["offset"]))
        return widened(self._press.decompress(self._file.read(int(entry["bytes"]))), self.width)

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for position, entry in enumerate(self.index):
            yield (int(entry["doc_id"]) if entry["has_id"] else None), self.ids(position)


def read_tokens(spark: SparkSession, uri: str, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of a data set that ``write_tokens`` described: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    prepare(shards)
    count = max(1, shards.count())
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found = iter(Shard(uri, shard))
                while part := list(itertools.islice(found, 2000)):
                    rows = []
                    for doc_id, ids in part:
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), *([ids] * with_ids)))
                        start += len(ids) // 4
                    types = [pa.int64()] * 4 + [pa.binary()] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return shards.select("shard", "start").repartitionByRange(count, "shard").mapInArrow(read, ddl)


def token_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` to the shared scratch folder and read the files back. An empty table gives no rows."""
    spark = docs.sparkSession
    uri = scratch_path(spark, "tokens")
    return read_tokens(spark, uri, written(write_tokens(docs, uri, path), "token-starts"))
