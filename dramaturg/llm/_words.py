"""Vectorised word and shingle hashing over batches of texts (numpy inside Spark tasks).

A word is a run of bytes other than space and \\x09-\\x0D, after lower-casing A-Z. A word's hash is
multilinear: each byte value and each position has a random 64-bit number, the products are summed
modulo 2**64 and mixed. A shingle's hash combines its word hashes the same way.
"""

from __future__ import annotations

import numpy as np

from dramaturg.llm._shared import sub_batches

_RANDOM = np.random.default_rng(20240601)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0

BATCH_BYTES = 4 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_block(block: np.ndarray) -> np.ndarray:
    gap = _SPACE[block]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not starts.size:
        return np.empty(0, np.uint64)
    block = block[starts[0]:]
    starts = starts - starts[0]
    lengths = np.diff(starts, append=block.size)
    place = np.arange(block.size, dtype=np.int64)
    place -= np.repeat(starts, lengths)
    weight = _PLACE[place & 1023]
    if lengths.max() > 1024:
        far = np.flatnonzero(place >= 1024)  # nearer bytes keep their weight, whatever else the block holds
        weight[far] *= mix64((place[far] >> 10).astype(np.uint64) + np.uint64(7))
    weight *= _BYTE[block]
    return mix64(np.add.reduceat(weight, starts))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one already lower-cased byte string, whatever its length."""
    if len(data) <= 2 * BATCH_BYTES:
        return _hash_block(np.frombuffer(data, np.uint8))
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BATCH_BYTES)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_hash_block(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(parts)


def word_batches(texts: list[str | None]):
    """Yield ``(first row, word counts, word hashes)`` for consecutive ranges of rows."""
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for i, j in sub_batches([len(e) for e in encoded], BATCH_BYTES):
        if j - i == 1:
            hashes = word_hashes(encoded[i])
            yield i, np.array([hashes.size]), hashes
            continue
        joined = b"\n".join(encoded[i:j])
        block = np.frombuffer(joined, np.uint8)
        gap = _SPACE[block]
        first = ~gap
        first[1:] &= gap[:-1]
        ends = np.cumsum([len(e) + 1 for e in encoded[i:j]])
        ends[-1] = block.size
        counts = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
        yield i, counts, _hash_block(block)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    if not words.size:
        return words
    if words.size < k:
        total = (words * _JOIN[: words.size]).sum(dtype=np.uint64, keepdims=True)
        return mix64(total + _JOIN[-1:] * np.uint64(words.size))
    n = words.size - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j: j + n] * _JOIN[j]
    return np.unique(mix64(total))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, in the order of the rows."""
    out: list[np.ndarray] = []
    for _, counts, hashes in word_batches(texts):
        at = 0
        for c in counts:
            out.append(shingles(hashes[at: at + c], k))
            at += c
    return out
