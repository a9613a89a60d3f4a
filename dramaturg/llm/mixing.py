"""Mixing to target weights with soft domain membership (operator 8)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._features import features
from dramaturg.llm._shared import cut, table, with_computed
from dramaturg.llm.quality import sample_features

WORD_TERMS = 4096


class DomainModel:
    """Multinomial logistic regression on hashed words and styles."""

    def __init__(self, rows: np.ndarray, labels: list[str], domains: list[str], steps: int = 200, rate: float = 0.05, decay: float = 1e-4):
        self.domains = domains
        k = len(domains)
        self.mean = rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1], np.float32)
        self.scale = (1 / (rows.std(axis=0) + 0.1) if len(rows) else np.ones(rows.shape[1])).astype(np.float32)
        x = (rows - self.mean) * self.scale
        y = np.zeros((len(rows), k), np.float32)
        y[np.arange(len(rows)), [domains.index(v) for v in labels]] = 1
        self.w, self.b = np.zeros((rows.shape[1], k), np.float32), np.zeros(k, np.float32)
        first, second = np.zeros_like(self.w), np.zeros_like(self.w)
        for step in range(1, steps + 1 if len(rows) else 1):
            error = (self._softmax(x @ self.w + self.b) - y) / len(rows)
            g = x.T @ error + decay * self.w
            first = 0.9 * first + 0.1 * g
            second = 0.99 * second + 0.01 * g * g
            self.w -= rate / step**0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            self.b -= error.sum(axis=0)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        q = np.exp(x - x.max(axis=1, keepdims=True))
        return q / q.sum(axis=1, keepdims=True)

    def posteriors(self, rows: np.ndarray) -> np.ndarray:
        return self._softmax(((rows - self.mean) * self.scale) @ self.w + self.b)


def posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_tokens`` (words of the whole text) and ``_domains`` (a probability each)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        out = [shared.value.posteriors(features(texts[i: i + 512], WORD_TERMS)) for i in range(0, len(texts), 512)]
        return [[q.astype(np.float64) for part in out for q in part]]

    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return with_computed(docs.withColumn("_tokens", words.cast("bigint")), text_col, "_domains array<double>", compute)


def _totals(members: DataFrame, path: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the present rates, and the matrix of shared membership.

    The matrix is of the documents whose rate isn't 0. One pass; each task sends one row of k + k * k sums.
    """

    def sums(batches):
        import pyarrow as pa

        total = np.zeros(k + k * k)
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            r = rates_of(q, path)
            total[:k] += (n * r) @ q
            total[k:] += (((n * (r > 0))[:, None] * q).T @ q).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(total.size)], pa.int32()), pa.array(total)], names=["i", "x"])

    made = members.select("_tokens", "_domains").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(k + k * k)
    for r in made.collect():
        out[r["i"]] = r["x"]
    return out[:k], out[k:].reshape(k, k)


def rates_of(q: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far: each goes against the gradient and back to zero or more."""
    r = np.ones(len(q))
    for g in path:
        r = np.maximum(0, r - q @ g)
    return r


class Steps(list):
    """The steps of a fit, with the expected tokens of each domain (``have``), those wanted, and the domains ``missed``."""

    have: np.ndarray
    want: np.ndarray
    missed: list[str]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, rounds: int = 80, near: float = 1e-4, kept: str | None = None) -> Steps:
    """Projected gradient descent for rates r >= 0 with sum(r * tokens * posterior) = target tokens.

    Minimises sum_k (A_k - T_k)^2 / T_k over the rates, with steps measured by tokens: a document's
    step depends on its posteriors only, so its rate is a function of them and of the k numbers of
    each past step. Nothing is stored per document; each round is one pass with k sums a task.
    ``total`` is the number of tokens wanted (None: as many as there are, or with ``kept`` as many as
    leave that domain the tokens that it has).

    Steps are implicit ones: the gradient goes through the inverse of the membership matrix of the
    documents above 0, damped by 1 / ``reach``, so that weak domains move as fast as strong ones. A
    step that doesn't bring the totals nearer is taken back and damped more, down to the plain step
    of one over the curvature, which always does. Ends when all targets are met within ``near``,
    when the totals of a step stop changing, or after ``rounds`` passes; ``missed`` of the result
    names the domains that aren't met then.
    """
    k = len(domains)
    have, shared = _totals(members, [], k)
    weight = np.array([targets.get(d, 0.0) for d in domains])
    if total is None:
        total = have[domains.index(kept)] * weight.sum() / targets[kept] if kept else have.sum()
    want = weight / max(weight.sum(), 1e-12) * total
    size = np.maximum(want, max(1.0, 1e-6 * have.sum()))
    root = 1 / np.sqrt(size)
    least = 1 / max(np.linalg.eigvalsh(root[:, None] * shared * root[None, :]).max(), 1e-12)
    most = reach = 1e8 * least
    path = Steps()
    far = np.abs(have - want) > near * np.maximum(want, 1)
    for _ in range(rounds):
        if not far.any():
            break
        damped = reach > least
        step = np.linalg.solve(np.diag(size / reach) + shared, have - want) if damped else least * (have - want) / size
        now, shared_now = _totals(members, [*path, step], k)
        if damped and not (((now - want) * root) ** 2).sum() < 0.999 * (((have - want) * root) ** 2).sum():
            reach /= 3
            continue
        path.append(step)
        still = (np.abs(now - have) <= 0.01 * near * size).all()
        have, shared = now, shared_now
        far = np.abs(have - want) > near * np.maximum(want, 1)
        if still:
            break
        reach = min(most, 10 * max(reach, least))
    path.have, path.want, path.missed = have, want, [d for d, f in zip(domains, far, strict=True) if f]
    return path


def with_rates(members: DataFrame, path: list[np.ndarray]) -> DataFrame:
    """``members`` with ``_rate``, and ``_copies``: the rate rounded by a hash of the id, right in the mean."""
    out = with_computed(members, "_domains", "_rate double", lambda q: [rates_of(np.array(q, np.float64).reshape(len(q), -1), path) if q else []])
    draw: Column = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("_copies", F.floor(F.col("_rate") + draw).cast("int"))


def fit_model(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = 4096) -> DomainModel:
    """Fit on at most ``most`` labelled rows (``doc_id, label`` one of ``domains``)."""
    rows, labels = sample_features(docs, labelled.filter(F.col("label").isin(domains)), most, WORD_TERMS)
    return DomainModel(rows, labels, domains)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates that bring clean, low-quality and toxic tokens to 90, 6 and 4 per cent.

    Defined results: null and empty texts have no tokens, so any rate serves; they get the rate of
    their posteriors. A domain that no document resembles can't be reached; the others are.
    ``missed`` names, in every row, the domains whose tokens don't meet their target.
    Repeated rows have equal rates and copies. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    domains = ["clean", "low", "toxic"]
    model = fit_model(docs, table(spark, sf_dir, "labels").select("doc_id", domain.alias("label")), domains)
    members = cut(posteriors(docs, model).drop("text"))
    path = fit_rates(members, domains, {"clean": 0.90, "low": 0.06, "toxic": 0.04})
    return with_rates(members, path).select(
        "doc_id",
        F.col("_tokens").alias("tokens"),
        *[F.col("_domains")[i].alias(f"p_{d}") for i, d in enumerate(domains)],
        F.col("_rate").alias("rate"),
        F.col("_copies").alias("copies"),
        F.lit(path.missed).cast("array<string>").alias("missed"),
    )
