"""BLAKE3 in key-derivation mode, over Arrow batches.

A message is a binary tree over chunks of 1,024 bytes. All chunks of all messages of
a batch are compressed side by side as columns of 32-bit numbers, block after block; then the
nodes of all trees are merged level by level, until each has its root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published specification: initial words, order of message words in each round, sizes and flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
ROUNDS, BLOCK, CHUNK = 7, 64, 1024
CHUNK_START, CHUNK_END, PARENT, ROOT, DERIVE_CONTEXT, DERIVE_MATERIAL = 1, 2, 4, 8, 32, 64
#: Columns and diagonals of the state that a round mixes.
MIXED = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
#: Bytes of messages that are hashed side by side.
BATCH_BYTES = 16 << 20


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values, (n, 8), of n nodes: ``chain`` (n, 8), message ``words`` (n, 16), and a number each."""
    n = len(chain)
    state = np.empty((16, n), np.uint32)
    state[:8] = chain.T
    state[8:12] = IV[:4, None]
    state[12], state[13] = counter & 0xFFFFFFFF, counter >> 32
    state[14], state[15] = length, flags
    m = np.ascontiguousarray(words.T)
    order = list(range(16))
    for _ in range(ROUNDS):
        for k, (a, b, c, d) in enumerate(MIXED):
            for word, one, two in ((m[order[2 * k]], 16, 12), (m[order[2 * k + 1]], 8, 7)):
                state[a] += state[b] + word
                state[d] = _turned(state[d] ^ state[a], one)
                state[c] += state[d]
                state[b] = _turned(state[b] ^ state[c], two)
        order = [order[p] for p in PERMUTATION]
    return (state[:8] ^ state[8:]).T


def digests(messages: list[bytes], keys: np.ndarray, flag: int) -> np.ndarray:
    """Root values (n, 8) of ``messages`` under ``keys`` (n, 8); ``flag`` says what the hash is for."""
    sizes = np.array([len(m) for m in messages], np.int64)
    chunks = np.maximum(1, -(-sizes // CHUNK))
    of = np.repeat(np.arange(len(messages)), chunks)
    at = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    held = np.zeros((len(of), CHUNK), np.uint8)
    flat, start = held.reshape(-1), 0
    for message, count in zip(messages, chunks.tolist(), strict=True):
        flat[start : start + len(message)] = np.frombuffer(message, np.uint8)
        start += count * CHUNK
    words = held.view("<u4").astype(np.uint32).reshape(len(of), CHUNK // BLOCK, 16)
    length = np.minimum(CHUNK, sizes[of] - at * CHUNK)
    blocks = np.maximum(1, -(-length // BLOCK))
    lone = chunks[of] == 1
    value = keys[of].copy()
    for k in range(CHUNK // BLOCK):
        live = np.flatnonzero(blocks > k)
        if not len(live):
            break
        last = blocks[live] == k + 1
        flags = flag | (CHUNK_START if k == 0 else 0) | np.where(last, CHUNK_END | np.where(lone[live], ROOT, 0), 0)
        value[live] = compress(value[live], words[live, k], at[live], np.minimum(BLOCK, length[live] - k * BLOCK), flags)
    while len(of) > len(messages):
        # Neighbours of one tree become a parent; a last one without a neighbour goes up as it is.
        count = np.bincount(of, minlength=len(messages))
        begin = np.cumsum(count) - count
        place = np.arange(len(of)) - begin[of]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[of]))
        root = count[of[left]] == 2
        merged = compress(keys[of[left]], np.concatenate([value[left], value[left + 1]], axis=1), np.zeros(len(left), np.int64), np.full(len(left), BLOCK), flag | PARENT | np.where(root, ROOT, 0))
        value[left] = merged
        kept = place % 2 == 0
        of, value = of[kept], value[kept]
    return value


def derived(contexts: list[str], materials: list[bytes]) -> list[str]:
    """Hexadecimal 32-byte keys derived from ``materials``, each in its context."""
    known = {c: k for k, c in enumerate(dict.fromkeys(contexts))}
    encoded = [c.encode("utf-8", "surrogatepass") for c in known]
    keys = digests(encoded, np.tile(IV, (len(encoded), 1)), DERIVE_CONTEXT) if encoded else np.zeros((0, 8), np.uint32)
    out: list[str] = []
    first = held = 0
    for k in range(len(materials) + 1):
        if k == len(materials) or held + len(materials[k]) > BATCH_BYTES and k > first:
            if k > first:
                own = keys[[known[c] for c in contexts[first:k]]]
                out += [row.astype("<u4").tobytes().hex() for row in digests(materials[first:k], own, DERIVE_MATERIAL)]
            first, held = k, 0
        if k < len(materials):
            held += len(materials[k])
    return out


def blake3_derived(context: Column, material: Column) -> Column:
    """The BLAKE3 key derived from ``material`` (binary or string) in ``context``; null if either is."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contexts, materials in parts:
            fine = [k for k, (c, m) in enumerate(zip(contexts, materials, strict=True)) if c is not None and m is not None]
            found: list[str | None] = [None] * len(contexts)
            for k, value in zip(fine, derived([contexts.iloc[k] for k in fine], [bytes(materials.iloc[k]) for k in fine]), strict=True):
                found[k] = value
            yield pd.Series(found, dtype=object)

    return run(context, material.cast("binary"))
