"""Packing token pieces into sequences: Martello-Toth reduction, then best fit (operator 4).

Lengths are whole numbers up to the capacity, so a corpus of any size is a
histogram of at most ``capacity`` counts. The plan is made on that histogram, in
bulk: first sets that provably dominate every alternative for one of their
members are fixed for good (an exact pair, a lone piece, a best partner where no
more than one or two others could join), then what is left goes to the fullest
open sequence that still has room, longest pieces first. Pieces find their place
in the plan by their rank among those of equal length, which is computed
distributed: ranks within salted parts of a length plus the counts of the parts
before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import prepare, text_batches, written

CAPACITY = 1024
END_ID = 2
#: Parts of each length; with ``capacity`` it bounds what the driver gathers: one count for each length and part.
PARTS = 64

Pattern = tuple[tuple[int, int], ...]  # (length, copies) of one sequence


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets and take them out of ``counts``: [(pattern, sequences)]."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(times: int, *lengths: int) -> None:
        pattern: dict[int, int] = {}
        for x in lengths:
            pattern[x] = pattern.get(x, 0) + 1
        times = min(times, *(counts[x] // c for x, c in pattern.items()))
        for x, c in pattern.items():
            counts[x] -= c * times
            if not counts[x]:
                del counts[x]
        fixed.append((tuple(sorted(pattern.items(), reverse=True)), times))

    changed = True
    while changed:
        changed = False
        for length in sorted(counts, reverse=True):
            while counts.get(length):
                found = _dominating(counts, length, capacity)
                if found is None:
                    break
                before = counts[length]
                fix(before, length, *found)
                changed = True
    return fixed


def _dominating(counts: dict[int, int], length: int, capacity: int) -> tuple[int, ...] | None:
    """Partners of one piece of ``length`` that dominate every other choice, or None if none is proved."""
    room = capacity - length
    others = sorted(x for x in counts if x <= room and (x != length or counts[x] > 1))
    if not others:
        return ()
    best = others[-1]
    if best == room:
        return (best,)
    left = lambda x: counts[x] - (x == length)
    smallest: list[int] = []
    for x in others[:3]:
        smallest += [x] * min(3, left(x))
    most, total = 0, 0
    for x in smallest[:3]:
        total += x
        if total > room:
            break
        most += 1
    if most <= 1:
        return (best,)
    if most > 2:
        return None
    pair, pair_sum = None, 0
    for i, a in enumerate(others):
        for b in others[i:]:
            if a + b > room:
                break
            if a + b > pair_sum and (a != b or left(a) > 1):
                pair, pair_sum = (b, a), a + b
    if pair is None or best >= pair_sum:
        return (best,)
    # The larger of the pair is also the best lone partner, and no two that fit are both longer than the smaller.
    if best == pair[0]:
        longer = [x for x in others if x > pair[1]]
        following = [x for x in longer[:2] for _ in range(min(2, left(x)))]
        if sum(following[:2]) > room or len(following) < 2:
            return pair
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in decreasing length, many equal pieces at a time."""
    open_by_room: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if not times:
            return
        if room == 0:
            done.append((pattern, times))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, pattern, times = capacity, (), n
            fit = room // length
            full = min(times, n // fit)
            put(room - fit * length, (*pattern, (length, fit)), full)
            n -= full * fit
            times -= full
            if n and n < fit and times:
                put(room - n * length, (*pattern, (length, n)), 1)
                n, times = 0, times - 1
            if pattern:
                put(room, pattern, times)
    return done + [x for found in open_by_room.values() for x in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """[(pattern, sequences)] that hold every piece of the histogram ``counts``."""
    left = {x: n for x, n in counts.items() if n}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be 1 to capacity")
    fixed = reduce_by_dominance(left, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Where the piece of a given length and rank goes: (sequence, offset)."""

    def __init__(self, patterns: list[tuple[Pattern, int]], capacity: int) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for pattern, times in patterns:
            offset = 0
            for length, copies in pattern:
                rows.setdefault(length, []).append((used.get(length, 0), copies, first, offset))
                used[length] = used.get(length, 0) + copies * times
                offset += length * copies
            first += times
        self.sequences = first
        self.by_length = {length: np.array(found, np.int64).T for length, found in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            start, copies, first, base = self.by_length[int(length)]
            at = np.searchsorted(start, ranks[rows], side="right") - 1
            k = ranks[rows] - start[at]
            sequence[rows] = first[at] + k // copies[at]
            offset[rows] = base[at] + k % copies[at] * length
        return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, remembered: int = bpe.MEMO_ENTRIES) -> DataFrame:
    """Token pieces of every row: ids of the whole text, then ``end_id``, cut from the end into ``capacity``."""
    prepare(docs)
    path = path or bpe.default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encoded(batch.column("text"), path, remembered), strict=True):
                ids += end
                n = len(ids) // 4
                stop = n - (n - 1) // capacity * capacity
                start = 0
                for piece in range((n - 1) // capacity + 1):
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
                    start, stop = stop, stop + capacity
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, parts: int = PARTS, remembered: int = bpe.MEMO_ENTRIES) -> DataFrame:
    """Pieces of ``docs (doc_id, text, ...)`` with their place: sequence_id, offset.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A
    null or empty text is one piece with the end id alone. Sequences are filled
    from offset 0 without gaps. Repeated rows are packed as often as they occur;
    a null doc_id stays null. Planned sequences count from 0, those that one
    full piece fills have negative numbers. An empty table gives no rows.
    ``remembered`` is how many words' ids a worker holds.
    """
    with text_batches(docs.sparkSession):
        made = written(pieces(docs, capacity, path, end_id, remembered), "pieces")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    short = made.filter(F.col("length") < capacity).withColumn("part", part)
    found = short.groupBy("length", "part").count().collect()
    tally = np.zeros((capacity + 1, parts), np.int64)
    for row in found:
        tally[row["length"], row["part"]] = row["count"]
    before = np.cumsum(tally, axis=1) - tally
    totals = tally.sum(1)
    places = Places(plan({int(x): int(totals[x]) for x in np.flatnonzero(totals)}, capacity), capacity)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, where = batch.column("length").to_numpy(), batch.column("part").to_numpy()
            ranks = before[lengths, where] + batch.column("rank").to_numpy() - 1
            sequence, offset = places.find(lengths, ranks)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = short.withColumn("rank", F.row_number().over(order).cast("long"))
    placed = ranked.select(*names, "part", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
    full = made.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return placed.unionByName(full)
