"""All stages together, and language ID, against plain versions of their own."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tessera.llm import bpe, language_id, mixing
from tessera.llm.simhash_dedup import fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Distinct ids; texts with exact copies, copies in other case and white space, and copies of a few changed words."""
    rng = random.Random(21)
    words = {"aa": [f"tala{x}" for x in "bcdfghklmn"], "bb": [f"xwyz{x}" for x in "jkqvzrpst"]}
    texts = []
    for k in range(40):
        lang = "ab"[k % 2] * 2
        base = [rng.choice(words[lang]) for _ in range(rng.randint(40, 1500 if k % 13 == 0 else 300))]
        texts.append((" ".join(base), lang))
        if k % 4 == 0:
            for _ in range(3):
                changed = list(base)
                for at in rng.sample(range(len(base)), max(1, len(base) // 90)):
                    changed[at] = f"new{rng.randint(0, 9999)}"
                texts.append((" ".join(changed), lang))
        if k % 5 == 0:
            texts += [("  ".join(base) + "\n", lang), (" ".join(base).upper(), lang)]
    texts += [(None, "aa"), ("", None), (" 12 - ", "bb"), ("tala", None), ("one", "aa")]
    rng.shuffle(texts)
    return [(i, t, lang, rng.choice(["big", "big", "big", "small", None]), 0) for i, (t, lang) in enumerate(texts)]


def roots(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_until_near(rows):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, fps = {r[0]: shingles(r[1]) for r in rows}, {r[0]: fingerprint(r[1]) for r in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and ((fps[a] ^ fps[b]).bit_count() <= 3 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    of = roots(sets, linked)
    return [r for r in rows if of[r[0]] == r[0]], len(linked)


def test_the_whole_pipeline_against_a_plain_one(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    near, links = plain_until_near(rows)
    assert links > 20 and len(near) < len(rows) - 30
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(near, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    mixed = [r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.MIX_SQL})").fetchall()]
    assert set(mixed) < {r[0] for r in near} or len(mixed) != len(near)  # the stage takes part
    tokenizer, wanted = Tokenizer.from_file(bpe.default_path()), Counter()
    texts = {r[0]: r[1] for r in near}
    for i in mixed:
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // 1024 * 1024, len(ids) + 1, 1024)]
        wanted.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        ends = [0]
        for offset, length in sorted(held):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    assert len(sequences) <= sum(r.length for r in found) / 1024 * 1.1 + 1


def plain_vector(text, dimensions):
    """The bundle of a text's trigrams, counted one by one."""
    letters = {}

    def letter(c):
        code = ord(c)
        if code not in letters:
            bits = np.random.Generator(np.random.PCG64(zlib.crc32(b"letter %d" % code))).integers(0, 2, dimensions, dtype=np.int8)
            letters[code] = [1 if b else -1 for b in bits]
        return letters[code]

    folded = "".join(c.lower()[:1] if c.lower()[:1].isalpha() else " " for c in text)
    folded = f" {' '.join(folded.split())} " if folded.strip() else ""
    total = [0] * dimensions
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        va, vb, vc = letter(a), letter(b), letter(c)
        for k in range(dimensions):
            total[k] += va[k - 2] * vb[k - 1] * vc[k]
    norm = sum(x * x for x in total) ** 0.5
    return [x / norm for x in total] if norm else total


def test_language_id_against_a_plain_one(spark):
    rng, dimensions = random.Random(5), 64
    words = {"aa": ["tala", "Mura", "keno"], "bb": ["xwyz", "qvqv"], "cc": ["öäü", "ßöä"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 6))), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    rows += [(100, "tala xwyz", None, "s", 0), (101, "7 !", "aa", "s", 0), (102, None, "bb", "s", 0)]
    found = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, SCHEMA), per_language=10**6, dimensions=dimensions).collect()}
    sums = defaultdict(lambda: np.zeros(dimensions))
    vectors = {i: plain_vector(t or "", dimensions) for i, t, *_ in rows}
    for i, t, lang, *_ in rows:
        if lang and t and zlib.crc32(str(i).encode()) % 5:
            sums[lang] += vectors[i]
    names = sorted(sums)
    for i, t, *_ in rows:
        scores = [float(np.dot(vectors[i], sums[n]) / np.linalg.norm(sums[n])) for n in names]
        if not any(vectors[i]):
            assert (found[i].lang_pred, found[i].score) == ("und", 0)
        else:
            assert found[i].score == pytest.approx(min(1, max(0, max(scores))), abs=1e-5)
            assert scores[names.index(found[i].lang_pred)] == pytest.approx(max(scores), abs=1e-5)


def test_thresholds_and_rows_that_stay(spark):
    rng = random.Random(8)
    letters = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(5))
    rows = [(i, " ".join(word(lang) for _ in range(20)), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names, prototypes = language_id.learn(docs)
    least, facts = language_id.thresholds(docs, names, prototypes)
    assert [x > 0 for x in least] == [False, False, True, False, False] and facts[0]["own_rejected"] <= 0.001 and facts[0]["foreign_rejected"] > 0.9
    foreign = [(1000 + k, " ".join("".join(rng.choice("stuvwz") for _ in range(5)) for _ in range(20)), None, "s", 0) for k in range(5)]
    odd = [(2000, None, "aa", "s", 0), (2001, "12", "bb", "s", 0), (None, rows[0][1], "aa", None, 0), (5, rows[5][1], "cc", "s", 0)]
    more = spark.createDataFrame([(*r, 1) for r in [*rows, *foreign, *odd]], SCHEMA + ", __tessera_language int")
    kept = language_id.keep_identified(more)
    assert kept.columns == more.columns and {r[-1] for r in kept.collect()} == {1}
    assert Counter(r.doc_id for r in kept.collect()) == Counter([r[0] for r in rows] + [None, 5])
    unknown = spark.createDataFrame([(1, "abc def", None, "s", 0), (2, None, None, "s", 0), (None, "x", "aa", "s", 0)], SCHEMA)
    assert language_id.keep_identified(unknown).count() == 3  # nothing to learn from
    assert language_id.keep_identified(docs.limit(0)).count() == 0
