"""Parts of the training-data operators that need no Spark."""

import itertools
import random

import numpy as np
import pytest

from tessera.llm import bpe
from tessera.llm.components import Forest
from tessera.llm.exact_dedup import CuckooIndex
from tessera.llm.html_extract import blocks, common_lines, host_and_path
from tessera.llm.language_id import Profiler
from tessera.llm.mixing import entropy, find_exponent, weights_at
from tessera.llm.packing import Places, best_fit, plan, reduce_by_dominance
from tessera.llm.simhash_dedup import fingerprint
from tessera.llm.token_output import serialised, train, widened


def test_cuckoo_inserts_deletes_and_resizes():
    rng = random.Random(1)
    index, model = CuckooIndex(4), {}
    keys = [rng.randbytes(32) for _ in range(3000)]
    for step in range(12000):
        key = rng.choice(keys)
        if rng.random() < 0.6:
            index.insert(key, step)
            model[key] = step
        else:
            assert index.delete(key) == (model.pop(key, None) is not None)
        if step % 1000 == 0:
            assert {k: index.get(k) for k in keys} == {k: model.get(k) for k in keys}
    assert dict(index.items()) == model and len(index) == len(model) and index.resizes > 3


def test_cuckoo_verifies_tag_hits():
    index = CuckooIndex()
    one, other = bytes([7, 7] + [0] * 30), bytes([7, 7] + [0] * 29 + [1])  # equal tag and home
    index.insert(one, "one")
    assert index.get(other) is None and index.tag_hits == 1
    index.insert(other, "other")
    assert (index.get(one), index.get(other)) == ("one", "other")


def test_cuckoo_overflow_of_equal_homes():
    index = CuckooIndex(2)
    keys = [bytes([1, 1]) + bytes(6) + bytes(8) + i.to_bytes(16, "little") for i in range(8)]
    for i, k in enumerate(keys):  # two buckets hold them all
        index.insert(k, i)
    assert [index.get(k) for k in keys] == list(range(8))


def test_ids_that_do_not_fit_are_refused():
    from tessera.llm.token_output import serialised, widened

    ids = np.array([3, 65_535], "<u4").tobytes()
    assert widened(serialised(ids, 2), 2) == ids
    wide = np.array([70_000], "<u4").tobytes()
    assert widened(serialised(wide, 4), 4) == wide
    with pytest.raises(ValueError):
        serialised(wide, 2)


def test_infeasible_mixing_targets_are_refused():
    tokens = {"a": 100, "b": 50}
    assert find_exponent(tokens, 187, 1.25) == 1.0 or find_exponent(tokens, 187, 1.25) <= 1
    for options in ({"budget": 450, "max_repetition": 1.25}, {"budget": 150, "target_entropy": 0.1}, {"budget": 150, "target_entropy": 0.8}):
        with pytest.raises(ValueError, match="no exponent"):
            find_exponent(tokens, **options)


def test_fingerprint_matches_the_definition():
    import xxhash

    def slow(text):
        words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate(dict.fromkeys([9, 10, 11, 12, 13], 32)).split(" ") if w]
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one TWO", "Ä ä É b", "a b c d", "x " * 500]
    texts += [" ".join(rng.choice(["A", "b", "c\n", "D\t", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(50)]
    assert [fingerprint(t) for t in texts] == [slow(t) for t in texts]


def test_forest_roots_are_smallest():
    forest = Forest()
    for a, b in [(5, 3), (9, 8), (8, 5), (2, 2)]:
        forest.join(a, b)
    assert dict(forest.stars()) == {5: 3, 9: 3, 8: 3}


def test_bpe_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    enc = bpe.Encoder(bpe.default_path())
    rng = random.Random(3)
    texts = ["", " ", "  a", "a  b\n\nc", "x\ty z", "\n", "it's  we'll\n'd", "foo, bar. baz!", "tail \n", "a <|endoftext|> b", "hello <|endoftext|> world", " <|endoftext|>", "<|endoftext|><|endoftext|>\tx", "a <|endoftext|>, <|endoftext|", "é" * 90 + " " + "z" * 300, "12 3.4, ok!!!", "a\x1fb c", "日本 語\n漢"]
    for alphabet in (" \n\tab'sS1.,!é漢 \x1f", " ab,.é", "ab \nÀ,"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    wanted = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == wanted
    assert len(enc.encode(["hello <|endoftext|> world"])[0]) == 4 * 4
    enc.memo, enc.aged = {}, enc.memo  # a new generation
    assert enc.encode(texts) == wanted


def _optimum(items, capacity):
    """Fewest bins by trying all ways, for few items."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0] and i < len(items):
            return
        if i == len(items):
            best[0] = min(best[0], len(rooms))
            return
        for r in set(rooms):
            if r >= items[i]:
                left = list(rooms)
                left.remove(r)
                place(i + 1, [*left, r - items[i]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randint(6, 20)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        counts = {x: items.count(x) for x in items}
        left = dict(counts)
        fixed = reduce_by_dominance(left, capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + _optimum(rest, capacity) == _optimum(items, capacity)
        held = {x: left.get(x, 0) for x in counts}
        for pattern, times in fixed:
            assert sum(x * c for x, c in pattern) <= capacity
            for x, c in pattern:
                held[x] += c * times
        assert held == counts


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(5)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 1025, 300), rng.integers(1, 40, 300), strict=True)}
    patterns = plan(counts)
    places, seen, fill = Places(patterns, 1024), set(), {}
    for length, n in counts.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            assert (s, o) not in seen
            seen.add((s, o))
            fill.setdefault(s, []).append((o, length))
    for pieces in fill.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *itertools.accumulate(x for _, x in pieces)][:-1] and sum(x for _, x in pieces) <= 1024
    assert len(fill) == places.sequences <= sum(times for _, times in best_fit(counts, 1024))
    assert plan({}) == [] and best_fit({}, 8) == []
    with pytest.raises(ValueError):
        plan({9: 1}, 8)


def test_exponent():
    tokens = {"a": 900, "b": 90, "c": 10, "d": 0}
    even = find_exponent(tokens, 1000, max_repetition=100)
    assert even == 0 and weights_at(tokens, even)["c"] == pytest.approx(1 / 3)
    limited = weights_at(tokens, find_exponent(tokens, 1000, max_repetition=2))
    assert max(limited[s] * 1000 / n for s, n in tokens.items() if n) == pytest.approx(2)
    aimed = weights_at(tokens, find_exponent(tokens, 1000, target_entropy=0.7))
    assert entropy(aimed) == pytest.approx(0.7) and aimed["d"] == 0
    assert find_exponent({"a": 0}, 0, max_repetition=1) == 1
    with pytest.raises(ValueError):
        find_exponent(tokens, 1, 1.0, 1.0)


def test_serialised_ids_come_back():
    ids = np.array([0, 5, 50256], "<u4").tobytes()
    assert widened(serialised(ids, 2), 2) == ids and widened(serialised(ids, 4), 4) == ids
    assert train([]) == b"" and isinstance(train([b"abc"]), bytes)


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        found = [a[i] for i in sorted(common_lines(a, b))]
        rest = iter(b)
        assert len(found) == _lcs(a, b) and all(x in rest for x in found)


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (None, []),
        ("", []),
        ("plain &amp; text", [("plain & text", False)]),
        ("<nav><p>menu</p></nav><article><h1>T</h1><p>a <b>b</b>\n c<br>d<p>e&nbsp;&lt;p&gt;</article><footer>f</footer>", [("T", True), ("a b c d", True), ("e <p>", True)]),
        ("<p>x</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> -->y", [("x", False), ("y", False)]),
        ("<article><div class='ad'>buy</div><p>keep</p><section id=comments><p>reader</p></section></article>", [("keep", True)]),
        ("<main><header><h1>Head</h1></header><aside>s</aside><p>t</main>", [("Head", True), ("t", True)]),
        ("<article><p>cut off <b", [("cut off", True)]),
        ("<article><p class='adapted header-text'>stay</p><form>go<input></form><div hidden>no</div></article>", [("stay", True)]),
        ("<ul><li>a<li>b</ul><div role=navigation>m</div>", [("a", False), ("b", False)]),
    ],
)
def test_blocks(page, wanted):
    assert list(zip(*blocks(page)[:2], strict=True)) == wanted


def test_host_and_path():
    assert host_and_path("https://A.b/c?d#e") == ("a.b", "/c?d") and host_and_path("//h") == ("h", "/")
    assert host_and_path(None) == ("", "") and host_and_path("x/y") == ("", "x/y")


def test_profiles_bind_and_bundle():
    made = Profiler(256)
    vectors = made.vectors(["abc", "ABC", "cba", None, "123 !", "abc abc"])
    assert np.allclose(vectors[0], vectors[1]) and not np.allclose(vectors[0], vectors[2])
    assert not vectors[3].any() and not vectors[4].any() and np.allclose(np.linalg.norm(vectors[[0, 2, 5]], axis=1), 1)
    one = np.zeros(256)
    for a, b, c in [" ab", "abc", "bc "]:
        one += np.roll(made._letter(ord(a)), 2) * np.roll(made._letter(ord(b)), 1) * made._letter(ord(c))
    assert np.allclose(vectors[0], one / np.linalg.norm(one), atol=1e-6)
