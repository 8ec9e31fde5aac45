"""Collocations, quality scores and the Merkle manifest against brute force, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import merkle, phrases, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, phrase string, rank int, node string, tree long, score double"


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 0.5) for r in rows], DOCS)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- collocations -------------------------------------------------------------------------


def plain_collocations(rows, max_words, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {g: a for g, a in found.items() if len(g) > 1 and a >= least}
        dropped = {g[i : i + k] for g, a in candidates.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 100 * candidates[g[i : i + k]]}
        scored = []
        for g, a in candidates.items():
            if g not in dropped:
                score, _, left, right = min((1000 * a * totals[lang] // (found[g[:k]] * found[g[k:]]), k, found[g[:k]], found[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def phrase_rows(seed=0, n=60):
    rng = random.Random(seed)
    words = ["The", "cat", "éa", "sat", "on", "a", "MAT", "x", "y", "zz"]
    ends = [" ", " ", " ", "\t ", ". ", ",", "; ", "\n", "\x0b", "! "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))) + "of the best of the best", rng.choice(["en", "fr", None, "und"]), "s", 0) for i in range(n)]
    return [*rows, *rows[:3], (None, None, "en", None, None), (5, "", None, None, None), (6, " .;\t\n ", "de", None, None), (7, "aa " * 3000, "en", "s", 0), (8, "éa" * 5000, "de", "s", 0)]


@pytest.mark.parametrize(("max_words", "least", "top"), [(5, 5, 2000), (3, 2, 7), (2, 1, 2000), (6, 3, 2000)])
def test_collocations(spark, max_words, least, top):
    rows = phrase_rows(max_words)
    found = phrases.collocations(documents(spark, rows).repartition(3), max_words, least, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(found) == plain_collocations(rows, max_words, least, top)


def test_collocations_do_not_hang_on_where_texts_are_cut(spark, monkeypatch):
    rows = phrase_rows(3)
    wanted = plain_collocations(rows, 5, 4, 2000)
    monkeypatch.setattr(phrases, "BITS_A_PART", 1)  # a full filter lets false hits through
    assert rows_of(phrases.collocations(documents(spark, rows), least=4)) == wanted
    text = b"one two. three four, five" * 9
    for size in (1, 7, 30, 1000):
        assert b"".join(phrases.stretches(text, size)) == text


def test_collocations_arithmetic_beyond_64_bits(spark):
    counts = [("en", 1, "a", 3_000_000_017), ("en", 1, "b", 3_000_000_019), ("en", 2, "a b", 2_999_999_957), ("en", 1, "", 6_000_000_000_000_003)]
    table = spark.createDataFrame(counts, "lang string, words int, phrase string, f long")
    real = phrases.frequent_phrases
    try:
        phrases.frequent_phrases = lambda *_: table
        found = phrases.collocations(documents(spark, [(1, "a b", "en", "s", 3)])).collect()
    finally:
        phrases.frequent_phrases = real
    assert [r.score for r in found] == [1000 * 2_999_999_957 * 6_000_000_000_000_003 // (3_000_000_017 * 3_000_000_019)]


def test_collocations_of_empty_tables(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(1, None, None, None, None)]), least=1).count() == 0
    with pytest.raises(ValueError, match="two words"):
        phrases.collocations(documents(spark, []), max_words=1)


def test_collocations_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    found = rows_of(phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet"), least=4))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert found and found == Counter(con.sql(phrases.PHRASES_SQL.replace("f >= 100", "f >= 4")).fetchall())


# --- quality ------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x = rng.random((9, quality.FEATURES))
    starts, labels = np.array([0, 4, 5]), np.array([1.0, 0.0, 0.5])
    model = quality.start_model(x, labels, hidden=5, gates=3)
    _, found = model.gradients(x, starts, labels)
    for name, gradient in found.items():
        for place in [tuple(rng.integers(0, n) for n in gradient.shape) for _ in range(6)]:
            losses = []
            for step in (1e-5, -1e-5):
                model.weights[name][place] += step
                losses.append(model.gradients(x, starts, labels)[0])
                model.weights[name][place] -= step
            assert gradient[place] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_score_is_attention_over_all_passages():
    rng = np.random.default_rng(2)
    x = rng.random((50, quality.FEATURES))
    model = quality.start_model(x, np.array([1.0, 0.0]))
    p = model.weights
    h = np.tanh((x - model.mean) / model.scale @ p["W"] + p["c"])
    logit = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
    a = np.exp(logit) / np.exp(logit).sum()
    wanted = 1 / (1 + np.exp(-((a @ h) @ p["q"] + p["b"][0])))
    for step in (1, 7, 50):
        score, count, top, weight = model.score(x[i : i + step] for i in range(0, 50, step))
        assert score == pytest.approx(wanted) and count == 50 and top == a.argmax() and weight == pytest.approx(a.max())


def test_passages_cover_whole_texts(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcÄ,. Z0\n💡") for _ in range(5 * quality.PASSAGE + 13))
    whole = np.concatenate(list(quality.passages(text)))
    assert len(whole) == 6
    for k in range(6):
        own = np.concatenate(list(quality.passages(text[k * quality.PASSAGE : (k + 1) * quality.PASSAGE])))
        assert np.allclose(whole[k], own[0], atol=1e-6)
    monkeypatch.setattr(quality, "_SLICE", 2)
    assert np.array_equal(np.concatenate(list(quality.passages(text))), whole)
    assert [len(x) for x in quality.passages(None)] == [1] and np.isfinite(np.concatenate(list(quality.passages("a")))).all()
    lines = "one and the same line of text\n" * 18
    mixed = "".join(rng.choice("abcdefghijkl ") for _ in range(quality.PASSAGE))
    repeats = slice(quality.PAIRS, quality.PAIRS + len(quality.REPEATS))
    assert (np.concatenate(list(quality.passages(lines[: quality.PASSAGE])))[0, repeats] > 0.8).all()
    assert (np.concatenate(list(quality.passages(mixed)))[0, repeats] < 0.2).all()


def test_quality_learns_from_labels_and_never_from_held_out_rows(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["tala", "mire", "sol", "Vento", "a", "de."]) for _ in range(rng.randint(20, 200)))
    bad = lambda: " ".join(rng.choice(["tala", "mire", "sol"]) + rng.choice(["***", "###", "%%%"]) for _ in range(rng.randint(20, 200)))
    rows = [(i, good() if i % 3 else bad(), "en", "s", 0) for i in range(300)]
    labels = [(i, 1 if i % 3 else 0) for i in range(300)]
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    odd = [(400, None, None, None, None), (401, "", "en", "s", 0), (None, "tala mire", "en", "s", 0), (1, rows[1][1], "xx", "t", 9), (402, "long " * 60_000, "en", "s", 0)]
    table = lambda labels: spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.quality_scores(documents(spark, [*rows, *odd]), table([*labels, (None, 1), (5, None), (7, 9)])).collect()
    assert len(found) == 305 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert {r.doc_id for r in found if r.held_out} == held
    right = [r.predicted == (r.doc_id % 3 > 0) for r in found if r.doc_id in held]
    assert len(right) > 80 and np.mean(right) > 0.97
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add(r.score)
    assert len(by_id[1]) == 1 and by_id[400] == by_id[401]
    assert next(r.n_passages for r in found if r.doc_id == 402) == -(-300_000 // quality.PASSAGE)
    flipped = [(i, 1 - q if i in held else q) for i, q in labels]
    scores = lambda labels: {(r.doc_id, r.score) for r in quality.quality_scores(documents(spark, rows), table(labels)).collect()}
    assert scores(flipped) == scores(labels)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.quality_scores(documents(spark, [(1, "a", "en", "s", 1), (None, None, None, None, None)]), none).collect()
    assert [(r.score, r.predicted, r.held_out) for r in found] == [(0.5, 1, zlib.crc32(b"1") % 3 == 1), (0.5, 1, False)]
    assert quality.quality_scores(documents(spark, []), none).count() == 0


# --- Merkle -------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, fan):
    """Root, and per leaf the levels of (left, right)."""
    place, sides = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for leaf, at in enumerate(place):
            run = nodes[at // fan * fan : at // fan * fan + fan]
            sides[leaf].append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
        place = [at // fan for at in place]
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], sides


def plain_manifest(rows, fan):
    def leaf(doc_id, text, lang, source, n):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)))

    sources = defaultdict(list)
    for r in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if r[1] is not None else None
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], lower, *r[2:]) if touched else leaf(*r), r[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s])], fan) for s in order}
    root, over = plain_tree([trees[s][0] for s in order], fan)
    out = []
    for s, above in zip(order, over, strict=True):
        for (_, _, own, later, doc_id), sides in zip(sorted(sources[s]), trees[s][1], strict=True):
            path, node = sides + above, later
            for left, right in path:
                node = sha(left + node + right)
            out.append((doc_id, own, trees[s][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return Counter(out)


def merkle_rows(n, sources, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Text ", "text", "ÄÖ x", ""]) * rng.randint(0, 5), rng.choice(["en", None]), "hot" if rng.random() < 0.6 else f"s{rng.randrange(sources)}", rng.choice([None, 7])) for i in range(n)]
    odd = [(None, None, None, None, None), (None, "a", "en", None, 1), (None, "a", "en", None, 1), (3, "Tie", "en", "hot", 1), (3, "Tie", "en", "hot", 1), (-4, "-", "-", "", 0), (10**12, "Word " * 30_000, "x", "é", 5), (2, "T", "en", "lone", 1)]
    return [*rows, *odd][: n + len(odd) if n else 0]


@pytest.mark.parametrize(("n", "sources", "fan", "height"), [(150, 4, 3, 2), (40, 20, 2, 1), (90, 2, 16, 3), (120, 3, 2, 3), (0, 1, 16, 3)])
def test_manifest(spark, n, sources, fan, height):
    rows = merkle_rows(n, sources)
    found = merkle.manifest(documents(spark, rows).repartition(3), fan, height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = plain_manifest(rows, fan) if rows else Counter()
    assert rows_of(found) == wanted and (not rows or {k[-1] for k in wanted} == {True, False})


def test_manifest_of_one_row(spark):
    row = (1, "a", "en", "s", 1)
    found = merkle.manifest(documents(spark, [row])).collect()[0]
    assert found.leaf == found.subroot == found.root and found.proof_sha256 == sha("")


def test_manifest_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    wanted = Counter(con.sql(merkle.MERKLE_SQL).fetchall())
    found = rows_of(merkle.manifest(docs))
    assert found == wanted and {k[-1] for k in wanted} == {True, False}
    assert found == plain_manifest([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()], 16)


def test_visit_and_fold():
    for n in (1, 2, 5, 9, 27, 28):
        nodes = [sha(str(i)) for i in range(n)]
        height = merkle.height_of(n, 3, 9)
        root, sides = merkle.visit_block(nodes, height, 3)
        assert root == plain_tree(nodes, 3)[0] and all(merkle.fold(x, path) == root for x, path in zip(nodes, sides, strict=True))
        assert all(path == [x for pair in own for x in pair] for path, own in zip(sides, plain_tree(nodes, 3)[1], strict=True))
