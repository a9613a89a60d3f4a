"""Language identification by a bidirectional gated recurrent network over bytes (operator 9).

The network is trained in numpy by backpropagation through time to label every byte of a window
with the language of its text; a document's probabilities are pooled over all its bytes.
"""

from __future__ import annotations

import regex

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._shared import id_residue, sub_batches, table, with_computed

_LETTER = regex.compile(r"\p{L}")
_GATES = ("z", "r", "n")


class BiGRU:
    """Forward and backward gated units over bytes; ``p`` maps names to float arrays.

    ``x?`` is a row for each byte value (its embedding times the input weights, and the bias),
    ``u?`` the recurrent weights, ``v`` and ``c`` the output layer over both directions.
    """

    def __init__(self, classes: int, hidden: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden, self.p = hidden, {}
        for d in "fb":
            for g in _GATES:
                self.p[f"{d}x{g}"] = rng.normal(0, 0.3, (256, hidden))
                self.p[f"{d}u{g}"] = rng.normal(0, hidden**-0.5, (hidden, hidden))
            self.p[f"{d}v"] = rng.normal(0, hidden**-0.5, (hidden, classes))
        self.p["c"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, d: str, data: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states [T, B, H] of one direction, and what going back needs."""
        p, steps = self.p, data.shape[0]
        h = np.zeros((data.shape[1], self.hidden), np.float32)
        states, kept = np.empty((steps, *h.shape), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = data[t]
            z = 1 / (1 + np.exp(-(p[d + "xz"][x] + h @ p[d + "uz"])))
            r = 1 / (1 + np.exp(-(p[d + "xr"][x] + h @ p[d + "ur"])))
            a = h @ p[d + "un"]
            n = np.tanh(p[d + "xn"][x] + r * a)
            kept.append((t, h, z, r, a, n))
            h = z * h + (1 - z) * n
            states[t] = h
        return states, kept

    def _backward(self, d: str, data: np.ndarray, kept: list, upstream: np.ndarray, grads: dict) -> None:
        p = self.p
        dh = np.zeros_like(upstream[0])
        for t, h, z, r, a, n in reversed(kept):
            dh = dh + upstream[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            da = dn * r
            for g, delta in (("z", dz), ("r", dr), ("n", dn)):
                np.add.at(grads[f"{d}x{g}"], data[t], delta)
            grads[d + "uz"] += h.T @ dz
            grads[d + "ur"] += h.T @ dr
            grads[d + "un"] += h.T @ da
            dh = dh * z + dz @ p[d + "uz"].T + dr @ p[d + "ur"].T + da @ p[d + "un"].T

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 6) -> None:
        """Adam on the mean cross-entropy over all positions; windows are [N, T] bytes."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(windows), batch)
            data, y = np.ascontiguousarray(windows[chosen].T), labels[chosen]
            grads = {k: np.zeros_like(v) for k, v in self.p.items()}
            f, kept_f = self._forward("f", data)
            b, kept_b = self._forward("b", data)
            logits = f @ self.p["fv"] + b @ self.p["bv"] + self.p["c"]
            q = np.exp(logits - logits.max(axis=2, keepdims=True))
            q /= q.sum(axis=2, keepdims=True)
            q[:, np.arange(batch), y] -= 1
            q /= q.shape[0] * batch
            grads["c"] = q.sum(axis=(0, 1))
            for d, states, kept in (("f", f, kept_f), ("b", b, kept_b)):
                grads[d + "v"] = np.einsum("tbh,tbc->hc", states, q)
                self._backward(d, data, kept, q @ self.p[d + "v"].T, grads)
            pace = rate * min(1, 4 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def position_logits(self, data: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Logits [T, B, C] for bytes [T, B]; the same sums as in training, without keeping steps.

        Lane b holds ``lengths[b]`` bytes from the top (None: all T). Bytes below them are never
        read by real positions: the backward direction starts at each lane's last byte.
        """
        steps, lanes = data.shape
        out = np.empty((steps, lanes, self.p["c"].size), np.float32)
        out[:] = self.p["c"]
        for d in "fb":
            p = self.p
            # a logistic unit is half a tanh of half its input, and half
            xz, uz = p[d + "xz"] / 2, p[d + "uz"] / 2
            xr, ur = p[d + "xr"] / 2, p[d + "ur"] / 2
            xn, un, v = p[d + "xn"], p[d + "un"] / 2, p[d + "v"]
            h = np.zeros((lanes, self.hidden), np.float32)
            z, r, a = (np.empty_like(h) for _ in range(3))
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x = data[t]
                np.matmul(h, uz, out=z)
                z += xz[x]
                np.tanh(z, out=z)
                np.matmul(h, ur, out=r)
                r += xr[x]
                np.tanh(r, out=r)
                r += 1
                np.matmul(h, un, out=a)
                a *= r
                a += xn[x]
                np.tanh(a, out=a)
                # h = z' h + (1 - z') n with z' = (1 + z) / 2
                h -= a
                z += 1
                h *= z
                h *= 0.5
                h += a
                if lengths is not None and d == "b":
                    h *= (t < lengths)[:, None]
                out[t] += h @ v
        return out

    def pooled(self, texts: list[bytes], window: int, lanes: int = 8192) -> np.ndarray:
        """Mean log-probabilities of every text over all its bytes, normalised to probabilities."""
        sums, counts = np.zeros((len(texts), self.p["c"].size)), np.array([len(t) for t in texts])
        for a, b in sub_batches(counts.tolist(), window * lanes):
            for data, owner, skip, lengths in _windows(texts, a, b, window, lanes):
                logits = self.position_logits(data, lengths)
                logits -= logits.max(axis=2, keepdims=True)
                logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
                at = np.arange(len(data))[:, None]
                if lengths is not None:
                    logits *= (at < lengths)[:, :, None]
                partly = np.flatnonzero(skip)
                logits[:, partly] *= (at >= skip[partly])[:, :, None]
                np.add.at(sums, owner, logits.sum(axis=0))
        mean = sums / np.maximum(counts, 1)[:, None]
        q = np.exp(mean - mean.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)


def _windows(texts: list[bytes], a: int, b: int, window: int, lanes: int):
    """Texts a..b as windows, ``lanes`` at a time: bytes [T, B], owners, how many bytes on top were read before, lengths.

    The last window of a text ends at its last byte and overlaps the one before. Texts shorter than
    a window come apart, sorted by length, with their lengths (None: all lanes are full).
    """
    sizes = np.array([len(t) for t in texts[a:b]])
    begins = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"".join(texts[a:b]), np.uint8)
    full = np.flatnonzero(sizes >= window)
    per = -(-sizes[full] // window)
    owner = np.repeat(full, per)
    place = (np.arange(owner.size) - np.repeat(np.cumsum(per) - per, per)) * window
    start = np.minimum(place, sizes[owner] - window)
    for i in range(0, owner.size, lanes):
        part = slice(i, i + lanes)
        first = begins[owner[part]] + start[part]
        yield joined[np.arange(window)[:, None] + first], a + owner[part], place[part] - start[part], None
    short = np.flatnonzero((sizes < window) & (sizes > 0))
    short = short[np.argsort(sizes[short], kind="stable")]
    for i in range(0, short.size, lanes):
        own = short[i: i + lanes]
        at = np.arange(sizes[own].max())[:, None] + begins[own]
        yield joined[np.minimum(at, joined.size - 1)], a + own, np.zeros(own.size, np.int64), sizes[own]


def training_windows(docs: DataFrame, languages: dict[str, int], per_language: int, windows: int, width: int) -> DataFrame:
    """About ``per_language`` texts of each language, ``windows`` pieces of ``width`` characters of each."""
    share = F.create_map(*[x for lang, n in languages.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    span = F.greatest(F.length("text") - width, F.lit(0)) + 1
    at = lambda i: F.substring("text", (F.pmod(F.xxhash64("doc_id", i), span) + 1).cast("int"), F.lit(width))
    return docs.filter(draw < share[F.col("lang")]).select(
        "lang", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(windows)), at))).alias("piece")
    )


def fit(docs: DataFrame, per_language: int = 400, windows: int = 16, width: int = 64, steps: int = 400, hidden: int = 8) -> tuple[BiGRU, list[str]]:
    """Train on a bounded sample: of each language about ``per_language`` texts of ``doc_id, text, lang``.

    Only languages present (not null) are learned; the driver gets at most ``windows`` pieces of
    ``width`` characters a text.
    """
    able = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    languages = {r["lang"]: r["count"] for r in able.groupBy("lang").count().orderBy("lang").collect()}
    names = sorted(languages)
    if not names:
        return BiGRU(1, hidden), []
    pieces = training_windows(able, languages, per_language, windows, width).orderBy("lang", "piece").collect()
    data, labels = np.zeros((len(pieces), width), np.uint8), np.array([names.index(r["lang"]) for r in pieces])
    for row, r in zip(data, pieces, strict=True):
        raw = np.frombuffer(r["piece"].encode(), np.uint8)[:width]
        row[:] = np.resize(raw, width)
    model = BiGRU(len(names), hidden)
    if len(names) > 1:
        model.train(data, labels, steps)
    return model, names


def identify(docs: DataFrame, model: BiGRU, names: list[str], text_col: str = "text", window: int = 64) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score``, from the whole text and nothing else.

    Defined results: a null text, a text without a letter, and every text if no language was
    learned get ``und`` with score 0. Ties go to the first language in order of names. Other
    columns and repeated rows pass through; columns named ``_lang`` or ``_score`` are replaced.
    The network starts anew every ``window`` bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, names))

    def compute(texts):
        model, names = shared.value
        able = [i for i, t in enumerate(texts) if names and t and _LETTER.search(t)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        probabilities = model.pooled([texts[i].encode("utf-8", "surrogatepass") for i in able], window)
        for i, q in zip(able, probabilities, strict=True):
            lang[i], score[i] = names[int(q.argmax())], float(q.max())
        return lang, score

    return with_computed(docs, text_col, "_lang string, _score double", compute)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, names = fit(docs.filter(id_residue("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model, names).select(
        "doc_id",
        F.coalesce(id_residue("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
    )
