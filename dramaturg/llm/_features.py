"""Hashed features of whole texts for the classifiers trained here (numpy inside Spark tasks)."""

from __future__ import annotations

import numpy as np

from dramaturg.llm._words import mix64, word_batches

SHAPE_TERMS, EXTRA_TERMS = 1024, 4
STYLE_TERMS = SHAPE_TERMS + EXTRA_TERMS


def _shapes() -> np.ndarray:
    """A small number for each byte: lower case and non-ASCII, upper case, digit, or the sign itself."""
    out = np.ones(256, np.uint32)
    signs = 4
    for b in range(128):
        c = chr(b)
        if c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif not c.isalpha():
            out[b] = signs
            signs += 1
    return out


_SHAPE = _shapes()


def style_counts(text: bytes, words: np.ndarray) -> np.ndarray:
    """Counts of hashed 4-grams of byte shapes, and of words and lines that repeat.

    The last four: words equal to the word before, to the one before that, lines equal to the line
    before, and words in all. ``words`` are the text's word hashes.
    """
    out = np.zeros(STYLE_TERMS)
    shape = _SHAPE[np.frombuffer(text, np.uint8)]
    if shape.size >= 4:
        gram = ((shape[:-3] * np.uint32(131) + shape[1:-2]) * np.uint32(131) + shape[2:-1]) * np.uint32(131) + shape[3:]
        out[:SHAPE_TERMS] = np.bincount((gram * np.uint32(2654435761)) >> np.uint32(22), minlength=SHAPE_TERMS)
    out[SHAPE_TERMS] = (words[1:] == words[:-1]).sum()
    out[SHAPE_TERMS + 1] = (words[2:] == words[:-2]).sum()
    lines = text.split(b"\n")
    out[SHAPE_TERMS + 2] = sum(a == b for a, b in zip(lines, lines[1:], strict=False))
    out[SHAPE_TERMS + 3] = words.size
    return out


def word_counts(words: np.ndarray, terms: int) -> np.ndarray:
    return np.bincount((mix64(words) % np.uint64(terms)).astype(np.int64), minlength=terms)


def features(texts: list[str | None], word_terms: int = 0) -> np.ndarray:
    """One row a text: logarithms of counts per thousand, of styles and of hashed words."""
    out = np.zeros((len(texts), STYLE_TERMS + word_terms), np.float32)
    for first, counts, hashes in word_batches(texts):
        at = 0
        for i, c in enumerate(counts.tolist(), first):
            words, text = hashes[at: at + c], (texts[i] or "").encode("utf-8", "surrogatepass")
            at += c
            style = style_counts(text, words)
            out[i, :SHAPE_TERMS] = style[:SHAPE_TERMS] * (1000 / max(1, len(text)))
            out[i, SHAPE_TERMS:STYLE_TERMS] = style[SHAPE_TERMS:] * (1000 / max(1, c))
            if word_terms:
                out[i, STYLE_TERMS:] = word_counts(words, word_terms) * (1000 / max(1, c))
    return np.log1p(out, out=out)
