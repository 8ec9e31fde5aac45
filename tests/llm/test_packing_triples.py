"""Operator 4: triples are fixed in bulk where they dominate, and only there."""

import random
from functools import cache

from tessera.llm.packing import plan, reduce_by_dominance


def test_triples_are_fixed_at_large_counts():
    counts = {60: 5000, 22: 5000, 16: 5000}
    assert reduce_by_dominance(counts, 100) == [(((60, 1), (22, 1), (16, 1)), 5000)]
    assert not counts


@cache
def _fewest(pieces, capacity):
    """Sequences of an optimal packing: the longest piece with every set that fits beside it."""
    if not pieces:
        return 0
    first, rest = pieces[0], pieces[1:]
    best = len(pieces)
    for chosen in range(1 << len(rest)):
        beside = [x for i, x in enumerate(rest) if chosen >> i & 1]
        if first + sum(beside) <= capacity:
            best = min(best, 1 + _fewest(tuple(x for i, x in enumerate(rest) if not chosen >> i & 1), capacity))
    return best


def test_fixed_sets_keep_an_optimal_packing():
    rng = random.Random(11)
    triples = 0
    for _ in range(250):
        lengths = rng.sample(range(12, 75), 4)
        pieces = tuple(sorted((rng.choice(lengths) for _ in range(7)), reverse=True))
        left = {x: pieces.count(x) for x in set(pieces)}
        fixed = reduce_by_dominance(left, 100)
        triples += sum(sum(c for _, c in pattern) == 3 for pattern, _ in fixed)
        rest = tuple(sorted((x for x, n in left.items() for _ in range(n)), reverse=True))
        assert sum(times for _, times in fixed) + _fewest(rest, 100) == _fewest(pieces, 100)
    assert triples > 0


def test_large_counts_need_no_more_sequences():
    assert sum(times for _, times in plan({60: 5000, 22: 5000, 16: 5000}, 100)) == 5000
