"""Quality by nearest-neighbour voting among labelled latent-semantic vectors (operator 2)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._features import STYLE_TERMS, features
from dramaturg.llm._shared import id_residue, table, with_computed


class Voters:
    """Labelled vectors in the latent space, and the way there."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dimensions: int = 32, neighbours: int = 15, seed: int = 3):
        self.neighbours = min(neighbours, len(labels))
        self.labels = labels.astype(np.float32)
        if not len(labels):
            return
        self.mean = rows.mean(axis=0)
        self.weight = 1 / (rows.std(axis=0) + 0.05)
        centred = (rows - self.mean) * self.weight
        # randomised range finder with power iterations, then an exact SVD of the small matrix
        width = min(dimensions + 10, *centred.shape)
        basis = centred @ np.random.default_rng(seed).normal(size=(centred.shape[1], width)).astype(np.float32)
        for _ in range(4):
            basis, _r = np.linalg.qr(basis)
            basis = centred @ (centred.T @ basis)
        basis, _r = np.linalg.qr(basis)
        self.axes = np.linalg.svd(basis.T @ centred, full_matrices=False)[2][:dimensions].T.astype(np.float32)
        self.vectors = self._unit(centred @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)).astype(np.float32)

    def scores(self, rows: np.ndarray, block: int = 1024) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled rows, by exact cosines."""
        out = np.full(len(rows), 0.5)
        for a in range(0, len(rows) if len(self.labels) else 0, block):
            vectors = self._unit((rows[a: a + block] - self.mean) * self.weight @ self.axes)
            cosine = vectors @ self.vectors.T
            near = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, : self.neighbours]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 2
            out[a: a + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def sample_features(docs: DataFrame, labelled: DataFrame, most: int, word_terms: int = 0) -> tuple[np.ndarray, list]:
    """Features of at most ``most`` labelled documents (``doc_id, label``), lowest id hash first.

    The ids are bounded and broadcast, so texts aren't shuffled; only feature rows come back.
    """
    chosen = labelled.filter("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    made = with_computed(texts, "text", "row binary", lambda t: [[r.astype(np.float16).tobytes() for r in features(t, word_terms)]])
    rows = made.select("doc_id", "label", "row").collect()
    rows.sort(key=lambda r: (r["doc_id"], str(r["label"]), r["row"]))
    flat = b"".join(r["row"] for r in rows)
    matrix = np.frombuffer(flat, np.float16).reshape(len(rows), STYLE_TERMS + word_terms)
    return matrix.astype(np.float32), [r["label"] for r in rows]


def fit(docs: DataFrame, labelled: DataFrame, most: int = 4096) -> Voters:
    """Fit on at most ``most`` labelled rows (``doc_id, label`` 0 or 1)."""
    rows, labels = sample_features(docs, labelled, most)
    return Voters(rows, np.array(labels, np.float32))


def score(docs: DataFrame, voters: Voters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score`` (0 to 1; higher: label 1 is likelier), from the whole text alone.

    The labelled vectors are broadcast: at most 4 096 rows of 32 numbers. Defined results: null and
    empty texts are scored as a text without any term; without labelled rows every score is 0.5;
    equal texts have equal scores up to rounding. Other columns and repeated rows pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def compute(texts):
        out = [shared.value.scores(features(texts[i: i + 1024])) for i in range(0, len(texts), 1024)]
        return [np.concatenate(out) if out else np.zeros(0)]

    return with_computed(docs, text_col, "_score double", compute)


def labelled_quality(spark, sf_dir: str) -> DataFrame:
    """Labels that may be learned from: those whose id's crc32 modulo 3 is not 1."""
    return table(spark, sf_dir, "labels").filter(id_residue("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, labelled_quality(spark, sf_dir))).select(
        "doc_id",
        F.coalesce(id_residue("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
