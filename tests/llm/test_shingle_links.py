"""Near copies by five-word shingles, against brute force."""

import random

import pytest

from tessera.llm.common import identified, written
from tessera.llm.shingle_links import prefixes, shingle_links
from tessera.llm.simhash_dedup import fingerprint, near_dedup


def _shingles(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def _alike(a, b):
    return bool(a or b) and 9 * len(a & b) >= 4 * (len(a) + len(b))


def _roots(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _texts():
    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    common = draw(30)
    texts = [None, "", "one two", "One  TWO", "a b c d e"]
    for _ in range(12):
        base = draw(rng.randint(40, 300))
        texts.append(" ".join(base))
        for _ in range(5):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 30))):
                words[at] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
    texts += [" ".join(common + draw(rng.randint(3, 12))) for _ in range(40)]  # a common passage fills most of the text
    return texts


@pytest.mark.parametrize("long_list", [256, 3, 1])
def test_shingle_links_find_all_components(spark, long_list):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs, row = identified(docs)
    rows = written(prefixes(docs, row), "rows")
    node = {r.doc_id: r.node for r in rows.collect()}
    sets = [_shingles(t) for t in texts]
    wanted = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if _alike(sets[i], sets[j])}
    found = {(r.a, r.b) for r in shingle_links(rows, docs, row, long_list=long_list).collect()}
    true_links = {tuple(sorted((node[i], node[j]))) for i, j in wanted if node[i] != node[j]}
    assert len(true_links) > 50 and found <= true_links
    nodes = sorted(set(node.values()))
    assert _roots(nodes, found) == _roots(nodes, true_links)
    if long_list == 256:
        assert found == true_links


def test_near_dedup_reaches_shingle_similarity(spark):
    texts = _texts()
    docs = spark.createDataFrame([*[(i, t, "s") for i, t in enumerate(texts)], (0, None, "s"), (None, texts[5], "n")], "doc_id long, text string, source string")
    sets, fps = [_shingles(t) for t in texts], [fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    by_bits = {(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= 3}
    by_words = {(i, j) for i, j in pairs if _alike(sets[i], sets[j])}
    assert len(by_words - by_bits) > 20  # links that three bits do not reach
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(_roots(range(len(texts)), by_bits | by_words).values()))
