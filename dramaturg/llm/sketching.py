"""Fast similarity sketching of sets of 64-bit hashes (numpy inside Spark tasks)."""

from __future__ import annotations

import numpy as np

from dramaturg.llm._words import mix64

_FRACTION = np.uint64(40)
_EMPTY = np.uint64(2**64 - 1)


def _seeds(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fast_sketch(elements: np.ndarray, sizes: np.ndarray, t: int, salt: int = 11) -> np.ndarray:
    """Sketches of ``len(sizes)`` sets, one row of ``t`` coordinates each.

    Round i throws every element into a bin by that round's hash and keeps, in each bin, the least
    of ``i + fraction``; rounds t to 2t-1 throw all elements into bin ``round - t``, so that no
    coordinate stays empty. A set takes part until its bins are full: after about (t log t) / size
    rounds. Two sets agree in a coordinate with the probability of their Jaccard similarity, and
    the share of agreeing coordinates concentrates as it does for t independent hashes.
    Empty sets get coordinates of all ones.
    """
    n = len(sizes)
    out = np.full((n, t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    seeds = _seeds(2 * t, salt)
    rows = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        h = mix64(elements ^ seeds[i])
        value = (h & np.uint64((1 << 40) - 1)) | (np.uint64(i) << _FRACTION)
        place = ((h >> _FRACTION) % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, owner * t + place, value)
        full = (out[rows] != _EMPTY).all(axis=1)
        if full.any():
            rows = rows[~full]
            if not rows.size:
                break
            live = np.zeros(n, bool)
            live[rows] = True
            keep = live[owner]
            elements, owner = elements[keep], owner[keep]
    return out


def band_keys(sketches: np.ndarray, bands: int, width: int) -> np.ndarray:
    """A 64-bit key for each band of ``width`` coordinates; the band's number is part of it."""
    seeds = _seeds(bands + width, 13)
    shaped = sketches[:, : bands * width].reshape(len(sketches), bands, width)
    total = np.broadcast_to(seeds[:bands], shaped.shape[:2]).copy()
    for j in range(width):
        total = mix64(total ^ shaped[:, :, j]) * seeds[bands + j]
    return mix64(total).view(np.int64)


def set_fingerprint(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums a set that don't depend on the order of its elements."""
    out = np.zeros((len(sets), 2), np.uint64)
    a, b = _seeds(2, 17)
    for i, s in enumerate(sets):
        out[i, 0] = mix64(s ^ a).sum(dtype=np.uint64)
        out[i, 1] = mix64(s ^ b).sum(dtype=np.uint64)
    return out.view(np.int64)
