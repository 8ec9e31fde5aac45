"""Phrase collocations of every language (operator 11).

Texts become rows of n-grams (language, words, phrase, occurrences), which are
hash-aggregated per language. A phrase is a candidate where it occurs ``least``
times, so its parts do as well, and the table of frequent phrases holds all that
a score needs: every cut of a candidate is joined to the counts of its first
part and its rest, scored in decimals and the lowest-scoring cut taken. A phrase
that lies in a longer one as often as it occurs at all lies so in one that is
longer by one word, so an anti-join with one-word extensions drops it. A window
ranks what is left.

The n-grams are exploded in three rounds: words, pairs of words, and the rest.
A round leaves out n-grams with a part of the round before that is not frequent:
they cannot be frequent either, and most long n-grams occur once. Tasks know
frequent parts from a filter of bits that is never larger than ``FILTER_BITS``;
its false hits cost rows and change no count. A task counts the n-grams of about
a megabyte of text before it hands them on, so a phrase that fills a third of all
texts leaves it as one row for each such stretch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written

#: Most bits of the filter of frequent parts (32 MB), and bits for each part while it is smaller.
FILTER_BITS = 1 << 28
BITS_A_PART = 32
#: Bytes of text that are counted together.
STRETCH = 1 << 20
#: Fixed value: the language of texts that have none.
UNDETERMINED = "und"
#: What ends a piece (each becomes the first of them), and the letters that are lower-cased.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_ENDS + bytes(range(65, 91)), b"." * len(_ENDS) + bytes(range(97, 123)))
_SEED = 42
_GRAMS = "lang string, words int, phrase string, n long"


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """A folded text in parts that end where a piece ends, of ``size`` bytes or, where a piece is longer, up to its end."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(b".", at, at + size)
        end = text.find(b".", at + size) if end < 0 else end
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


class PartFilter:
    """Bits of frequent phrases: two for each, by the hash that Spark's ``xxhash64(lang, phrase)`` is."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def holds(self, lang: bytes, phrases: list[bytes]) -> np.ndarray:
        import xxhash

        seed = xxhash.xxh64_intdigest(lang, _SEED)
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases))
        mask, out = np.uint64(64 * len(self.words) - 1), np.ones(len(phrases), bool)
        for shift in (0, 32):
            bit = (hashes >> np.uint64(shift)) & mask
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def part_filter(parts: DataFrame, most_bits: int = FILTER_BITS) -> PartFilter:
    """The filter of ``parts (lang, phrase)``; the driver gets its words, ``most_bits`` / 64 numbers at most."""
    count = max(1, parts.count())
    bits = min(most_bits, max(1 << 16, 1 << (BITS_A_PART * count - 1).bit_length()))
    hashed = F.xxhash64("lang", "phrase")
    bit = F.explode(F.array(*[F.shiftrightunsigned(hashed, shift).bitwiseAND(bits - 1) for shift in (0, 32)]))
    found = parts.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("set"))
    words = np.zeros(bits // 64, np.uint64)
    rows = found.toArrow()
    words[rows.column("word").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return PartFilter(words)


def count_grams(lang: bytes, text: bytes, sizes: list[int], known: PartFilter | None, known_size: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """``(size, phrases, occurrences)`` of the n-grams of a folded text; with a filter, of those whose parts of up to ``known_size`` words it holds."""
    words = text.replace(b".", b" . ").split()
    ids: dict[bytes, int] = {b".": 0}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    distinct = list(ids)
    good = code > 0  # whether the n-gram that starts here, of the size in turn, stays
    key = code
    for size in range(1, max(sizes) + 1):
        if size > 1:
            good = good[: len(good) - 1] & good[1:]  # both parts that are shorter by one word stay
            key = key[: len(key) - 1] * len(ids) + code[size - 1 :]
        at = np.flatnonzero(good)
        if not len(at):
            return
        values, first, back, counts = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
        if size in sizes or (known and size <= known_size):
            starts = at[first].tolist()
            phrases = [distinct[v] for v in values.tolist()] if size == 1 else [b" ".join(words[s : s + size]) for s in starts]
        if known and size <= known_size:
            held = known.holds(lang, phrases)
            good = good.copy()
            good[at] = held[back]
            if size in sizes:
                yield size, [p for p, h in zip(phrases, held.tolist(), strict=True) if h], counts[held]
        elif size in sizes:
            yield size, phrases, counts
        dense = np.full(len(good), -1, np.int64)  # equal n-grams get equal numbers, small enough for one more word
        dense[at] = back
        key = dense


def _exploded(docs: DataFrame, sizes: list[int], known: PartFilter | None, known_size: int) -> DataFrame:
    """N-grams of ``docs (lang, text)`` as rows; with the words also one row of phrase "" with their number."""
    held = docs.sparkSession.sparkContext.broadcast(known.words) if known else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = PartFilter(held.value) if held else None

        def counted(lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
            for size, phrases, counts in count_grams(lang.encode(), text, sizes, parts, known_size):
                if size == 1 and not parts:
                    phrases, counts = [*phrases, b""], np.append(counts, counts.sum())
                column = pa.array(phrases, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(np.full(len(phrases), size, np.int32)), column, pa.array(counts.astype(np.int64))], names=["lang", "words", "phrase", "n"])

        waiting: dict[str, list[bytes]] = {}
        lengths: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                lang = lang.as_py()
                for part in stretches(text.as_buffer().to_pybytes().translate(_FOLD)):
                    waiting.setdefault(lang, []).append(part)
                    lengths[lang] = lengths.get(lang, 0) + len(part)
                    if lengths[lang] >= STRETCH:
                        yield from counted(lang, b".".join(waiting.pop(lang)))
                        del lengths[lang]
                if sum(lengths.values()) >= 4 * STRETCH:  # of many languages
                    for lang in list(waiting):
                        yield from counted(lang, b".".join(waiting.pop(lang)))
                    lengths.clear()
        for lang, texts in waiting.items():
            yield from counted(lang, b".".join(texts))

    return docs.mapInArrow(run, _GRAMS)


def frequent_phrases(docs: DataFrame, least: int, max_words: int) -> DataFrame:
    """``(lang, words, phrase, f)`` of phrases of 1 to ``max_words`` words that occur ``least`` times, and the number of words as ``f`` of phrase ""; written."""
    rounds = [[1], [2], list(range(3, max_words + 1))]
    found, known = None, None
    for sizes in rounds:
        sizes = [s for s in sizes if s <= max_words]
        if not sizes:
            break
        counts = _exploded(docs, sizes, known, sizes[0] - 1).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
        counts = written(counts.filter((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
        found = counts if found is None else found.unionByName(counts)
        known = part_filter(found.select("lang", "phrase"))
    return found


def collocations(docs: DataFrame, max_words: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """Per language of ``docs (text, lang, ...)`` its ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at
    0x20 and 0x09 into words. A null text has no words, a null language is
    ``und``. ``n`` counts all words of the language, ``a`` the phrase, ``l`` and
    ``r`` the first part and the rest of its lowest-scoring cut (ties: the
    shorter first part), ``score`` is floor(1000 a n / (l r)). Phrases of 2 to ``max_words``
    words that occur ``least`` times are candidates; one that lies in a
    longer candidate as often as it occurs is dropped. Order: score and ``a``
    descending, phrase by its bytes. Repeated rows count as often; other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    prepare(docs)
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col("text").cast("string").alias("text"))
    found = frequent_phrases(texts, least, max_words)
    totals = written(found.filter("phrase = ''").select("lang", F.col("f").alias("n")), "phrase-totals")
    candidates = found.filter("words > 1")
    words = F.split("phrase", " ", -1)
    extended = candidates.filter("words > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.array_join(F.slice(words, 2, F.col("words") - 1), " "))).alias("phrase"))
    own = candidates.withColumnRenamed("f", "a").join(extended.distinct(), ["lang", "phrase", "a"], "left_anti")

    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("first"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("words")), " ").alias("rest"))
    counts = found.filter(F.col("words") < max_words).select("lang", "phrase", "f")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = lambda x: F.col(x).cast("decimal(38,0)")  # noqa: E731  products of 64-bit counts do not fit in 64 bits
    cuts = cuts.join(totals, "lang").withColumns({"above": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), "below": exact("l") * exact("r")})
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("best"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
grams AS (SELECT lang, ws[i:i + k - 1] AS g FROM placed, range(1, 6) AS sizes(k) WHERE i + k - 1 <= len(ws)),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
candidates AS (SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= 100),
insides AS (
  SELECT DISTINCT lang, g[s:s + k - 1] AS g, a
  FROM candidates, range(1, 5) AS starts(s), range(2, 5) AS sizes(k)
  WHERE k < len(g) AND s + k - 1 <= len(g)),
own AS (
  SELECT c.* FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM insides x WHERE x.lang = c.lang AND x.g = c.g AND 100 * x.a >= 100 * c.a)),
cuts AS (
  SELECT o.lang, o.g, o.a, k, x.f AS l, y.f AS r, n,
         ((1000::HUGEINT * o.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM own o, range(1, 5) AS places(k), counts x, counts y, totals t
  WHERE k < len(o.g) AND x.lang = o.lang AND x.g = o.g[1:k] AND y.lang = o.lang AND y.g = o.g[k + 1:] AND t.lang = o.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
