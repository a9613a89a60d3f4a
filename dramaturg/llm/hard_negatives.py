"""Hard negatives by exact integer scores, filtered by angles to reference directions (operator 12).

Every row keeps its norm and its angles to a few reference directions. By the triangle inequality
of angles, the angle between two rows lies between the difference and the sum of their angles to
any reference; cosines of that, times the norms, bound their score. A row is scored with an anchor
only where these bounds overlap what the anchor still looks for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dramaturg.llm._shared import shared_dir, small_batches, table, written

#: Angles are stored as 32-bit floats; this covers their rounding and that of arccos near 1.
SLACK = 1e-5
#: Scores of vectors whose norms multiply to less are exact in 64-bit floats, every partial sum included.
_EXACT = 2.0**53
_NONE = np.iinfo(np.int64).min


def integer_vector(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """Rows with an id, a label and a vector whose components are all finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))


def stacked(vectors: list[list[int]]) -> np.ndarray:
    """Rows of a matrix, shorter ones filled with zeros."""
    width = max(map(len, vectors), default=0)
    return np.array([[*v, *[0] * (width - len(v))] for v in vectors], np.int64).reshape(len(vectors), width)


def references(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """``count`` unit directions: centres of spherical k-means over a sample of vectors."""
    width = vectors.shape[1]
    x = vectors.astype(np.float64)
    size = np.linalg.norm(x, axis=1)
    x = x[size > 0] / size[size > 0, None]
    if not len(x):
        return np.zeros((0, width))
    centres = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def matrix(column: pa.Array, width: int | None = None, kind=np.int64) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    width = max(width or 0, int(lengths.max(initial=0)))
    if lengths.size and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def angled(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """``id, label, v, anchor`` with ``norm``, ``angles`` to the directions, the nearest one as ``cell`` and its ``angle``."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            x = matrix(batch.column(2), centres.shape[1]).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            wide = np.zeros((len(centres), x.shape[1]))
            wide[:, : centres.shape[1]] = centres
            cosines = np.divide(x @ wide.T, norm[:, None], out=np.zeros((len(x), len(centres))), where=norm[:, None] > 0)
            angles = np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)
            if not len(centres):
                angles = np.full((len(x), 1), np.pi / 2, np.float32)
            cell = angles.argmin(axis=1)
            own = angles[np.arange(len(x)), cell]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(norm), lists, pa.array(cell.astype(np.int32)), pa.array(own), batch.column(3)], names=["id", "label", "v", "norm", "angles", "cell", "angle", "anchor"])

    return rows.mapInArrow(run, "id bigint, label bigint, v array<bigint>, norm double, angles array<float>, cell int, angle float, anchor boolean")


def exact_scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of all rows of two matrices; ``most`` bounds the product of their norms."""
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**62:
        raise OverflowError("inner products don't fit 64 bits")
    return a @ b.T


def wanted_angles(low: np.ndarray, high: np.ndarray, norm: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The angles at which rows with norms between ``least`` and ``most`` can score between ``low`` and ``high``.

    Widened by a unit and a billionth of the largest score, and by :data:`SLACK`, against rounding.
    """
    room = 1.0 + 1e-9 * norm * most
    low, high = low - room, high + room
    big, small = np.maximum(norm * most, 1e-300), np.maximum(norm * least, 1e-300)
    # the cosine must reach low / (norms): the largest norms for a positive low, the smallest for a negative one
    upper = np.where(low <= 0, low / small, low / big)
    lower = np.where(high >= 0, high / small, high / big)
    return np.arccos(np.clip(lower, -1, 1)) - SLACK, np.arccos(np.clip(upper, -1, 1)) + SLACK


class Best:
    """The ``k`` best ids of each of ``n`` searches: higher scores first, then smaller ids.

    ``floor``: scores that the k-th best is known to reach.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.score, self.id = k, np.full((n, k), _NONE), np.zeros((n, k), np.int64)
        self.floor = np.full(n, _NONE) if floor is None else floor

    @property
    def least(self) -> np.ndarray:
        """Only scores that reach this may still enter."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Candidates of the searches ``which``: those where ``fit`` holds."""
        fit = fit & (scores >= self.least[which][:, None])
        many = np.flatnonzero(fit.sum(axis=1) > self.k)
        if many.size:  # only what is as good as the k-th can stay
            masked = np.where(fit[many], scores[many], _NONE)
            fit[many] &= scores[many] >= np.partition(masked, -self.k, axis=1)[:, [-self.k]]
        row, column = np.nonzero(fit)
        if not row.size:
            return
        rows = np.unique(row)
        owner = np.concatenate([row, np.repeat(rows, self.k)])
        score = np.concatenate([scores[row, column], self.score[which[rows]].ravel()])
        key = np.concatenate([ids[column], self.id[which[rows]].ravel()])
        order = np.lexsort((key, ~score, owner))
        owner = owner[order]
        place = np.arange(owner.size) - np.searchsorted(owner, owner)
        keep = place < self.k
        self.score[which[owner[keep]], place[keep]] = score[order][keep]
        self.id[which[owner[keep]], place[keep]] = key[order][keep]


class Anchors:
    """A block of anchors as arrays, in the order of their cells and angles."""

    def __init__(self, rows: list):
        self.id = np.array([r["id"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.v = stacked([r["v"] for r in rows])
        self.norm = np.array([r["norm"] for r in rows], np.float64)
        self.angles = np.array([r["angles"] for r in rows], np.float64)


def overlapping(batch: pa.RecordBatch, anchors: Anchors, low, high, group: int = 128) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """Anchors, rows and their integer scores, of those that may score between ``low()`` and ``high()``.

    Rows come in the order of their cells and angles. For a cell's rows, all references bound the
    angle to them as a whole; the anchors left have windows of angles to the cell's own reference,
    and a group of neighbouring anchors is scored with the rows from its first window to its last.
    """
    width = anchors.v.shape[1]
    v = matrix(batch.column(2), width)
    norm, angles = batch.column(3).to_numpy(), matrix(batch.column(4), kind=np.float64)
    cell, nearest = batch.column(5).to_numpy(), batch.column(6).to_numpy()
    mine = np.zeros((len(anchors.v), v.shape[1]), np.int64)
    mine[:, :width] = anchors.v
    # a run ends with its cell, and where the rows of another file begin
    ends = np.flatnonzero((cell[1:] != cell[:-1]) | (nearest[1:] < nearest[:-1])) + 1
    for begin, end in pairwise([0, *ends.tolist(), len(cell)] if len(cell) else []):
        own = angles[begin:end]
        first, last = own.min(axis=0), own.max(axis=0)
        least, most = norm[begin:end].min(), norm[begin:end].max()
        near, far = wanted_angles(low(), high(), anchors.norm, least, most)
        phi = anchors.angles
        shortest = np.maximum(0, np.maximum(phi - last, first - phi)).max(axis=1)
        longest = np.minimum(np.pi, np.minimum(phi + last, 2 * np.pi - phi - first)).min(axis=1)
        active = np.flatnonzero((shortest <= far) & (longest >= near))
        if not active.size:
            continue
        # rows of a cell are in the order of the angle to its reference
        c = cell[begin]
        along, phi = own[:, c], phi[active, c]
        start = np.searchsorted(along, np.maximum(phi - far[active], near[active] - phi), side="left")
        stop = np.searchsorted(along, np.minimum(phi + far[active], 2 * np.pi - phi - near[active]), side="right")
        some = start < stop
        active, start, stop = active[some], start[some], stop[some]
        order = np.argsort(start, kind="stable")
        for i in range(0, active.size, group):
            which = order[i: i + group]
            rows = slice(begin + int(start[which].min()), begin + int(stop[which].max()))
            yield active[which], rows, exact_scores(mine[active[which]], v[rows], float(anchors.norm[active[which]].max() * most))


class Searches:
    """What a block of anchors looks for.

    Without ``windows`` each anchor is a search for the best rows of its label; with them (lowest and
    highest scores, a column a positive) each anchor has a search a positive for rows of other labels.
    ``floor``: scores that a search's last result is known to reach.
    """

    def __init__(self, anchors: Anchors, k: int, windows: tuple[np.ndarray, np.ndarray] | None = None, floor: np.ndarray | None = None):
        self.anchors, self.k, self.windows, self.floor = anchors, k, windows, floor
        self.each = 1 if windows is None else windows[0].shape[1]

    def start(self) -> None:
        n = len(self.anchors.id)
        self.best = Best(n * self.each, self.k, self.floor)
        if self.windows is None:
            self.high = np.full(n, np.inf)
        else:
            self.open = self.windows[0] <= self.windows[1]
            self.high = np.where(self.open, self.windows[1], _NONE).max(axis=1).astype(np.float64)

    def low(self) -> np.ndarray:
        """The lowest score that any search of an anchor still takes."""
        if self.windows is None:
            return np.where(self.best.least == _NONE, -np.inf, self.best.least.astype(np.float64))
        least = np.maximum(self.best.least.reshape(-1, self.each), self.windows[0])
        return np.where(self.open, least, np.iinfo(np.int64).max).min(axis=1).astype(np.float64)

    def see(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        same = self.anchors.label[which][:, None] == labels[None, :]
        if self.windows is None:
            self.best.add(which, scores, ids, same & (self.anchors.id[which][:, None] != ids[None, :]))
            return
        bottom, top = self.windows
        for p in range(self.each):
            self.best.add(which * self.each + p, scores, ids, ~same & (scores >= bottom[which, p][:, None]) & (scores <= top[which, p][:, None]))


def _floor(searches: Searches, sample: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What the searches find in a sample: the whole table has nothing worse for them."""
    ids, labels, v = sample
    searches.start()
    a = searches.anchors
    width = max(a.v.shape[1], v.shape[1])
    wide = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a.v, v)]
    most = float(a.norm.max(initial=0) * np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
    for i in range(0, len(a.id), 256):
        searches.see(np.arange(i, min(i + 256, len(a.id))), exact_scores(wide[0][i: i + 256], wide[1], most), ids, labels)
    return searches.best.least


def _searched(rows: DataFrame, shared) -> DataFrame:
    """Every task's best rows of each search over its own rows: ``search, id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = shared.value
        searches.start()
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for which, part, scores in overlapping(batch, searches.anchors, searches.low, lambda: searches.high):
                searches.see(which, scores, ids[part], labels[part])
        search, place = np.nonzero(searches.best.score != _NONE)
        for i in range(0, max(search.size, 1), 65536):
            s, k = search[i: i + 65536], place[i: i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(searches.best.id[s, k]), pa.array(searches.best.score[s, k])], names=["search", "id", "score"])

    return rows.mapInArrow(run, "search bigint, id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, ratios: tuple[int, int] = (30, 90), key: str = "vec_id", vector: str = "embedding",
    label: str = "label", directions: int = 16, sample: int = 4096, block: int = 2048,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all anchors.

    Scores are integer inner products of vectors scaled by 256 and floored. Positives are an
    anchor's best rows of its label; a positive's negatives are the best rows of other labels whose
    score is between ``ratios`` per cent of the positive's. Equal scores go by the smaller id.

    Rows are written once, in the order of their nearest reference and the angle to it, so that a
    batch covers few angles. Anchors come in blocks of ``block``, which bounds what is broadcast;
    a block reads the table twice and each task sends on a fixed number of rows an anchor.
    Reference directions are fitted on ``sample`` rows, which also give each search a score that it
    reaches at least; both change what is skipped, not what is found.

    Defined results: rows without an id, a label or a vector of finite numbers take no part; of rows
    that repeat an id the one with the smallest label, then vector, does; shorter vectors are filled
    with zeros; an anchor without positives, or a positive without negatives, gives no rows; other
    columns aren't looked at. Scores beyond 64 bits are an error.
    """
    spark = rows.sparkSession
    small_batches(spark)
    own = usable(rows, vector, label, key).select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), integer_vector(F.col(vector)).alias("v"), anchor.alias("anchor"))
    own = own.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    own = written(own, "vectors")
    rows = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "label", "v").collect()
    drawn = np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), stacked([r["v"] for r in rows])
    kept = angled(own, references(drawn[2], directions))
    kept = written(kept.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id"), "angles")
    starts = written(kept.filter("anchor"), "anchors")
    place, last = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}", None
    while True:
        after = starts if last is None else starts.filter(
            (F.col("cell") > last[0]) | ((F.col("cell") == last[0]) & ((F.col("angle") > F.lit(last[1]).cast("float")) | ((F.col("angle") == F.lit(last[1]).cast("float")) & (F.col("id") > last[2]))))
        )
        taken = after.orderBy("cell", "angle", "id").limit(block).collect()
        if not taken:
            break
        _block(kept, Anchors(taken), drawn, positives, negatives, ratios).write.mode("append").parquet(place)
        if len(taken) < block:
            break
        last = (taken[-1]["cell"], taken[-1]["angle"], taken[-1]["id"])
    return spark.read.schema(RESULT).parquet(place) if last or taken else spark.createDataFrame([], RESULT)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _block(kept: DataFrame, anchors: Anchors, drawn: tuple, positives: int, negatives: int, ratios: tuple[int, int]) -> DataFrame:
    """The result for one block of anchors; both searches see all rows."""
    spark = kept.sparkSession
    n = len(anchors.id)
    shared = spark.sparkContext.broadcast(Searches(anchors, positives, floor=_floor(Searches(anchors, positives), drawn)))
    found = _best(_searched(kept, shared), positives).collect()  # at most ``positives`` an anchor
    shared.unpersist()
    score, ids = np.full((n, positives), _NONE), np.zeros((n, positives), np.int64)
    for r in found:
        score[r["search"], r["rank"] - 1], ids[r["search"], r["rank"] - 1] = r["score"], r["id"]
    known = score != _NONE
    low, high = ratios
    value = np.where(known, score, 0)
    # the smallest and the largest integer score inside the ratios; none if they cross
    hundreds, rest = np.divmod(value, 100)
    bottom, top = low * hundreds - (-low * rest // 100), high * hundreds + high * rest // 100
    bottom, top = np.where(known, bottom, 1), np.where(known, top, 0)
    shared = spark.sparkContext.broadcast(Searches(anchors, negatives, (bottom, top), _floor(Searches(anchors, negatives, (bottom, top)), drawn)))
    best = _best(_searched(kept, shared), negatives)
    at, place = np.nonzero(known)
    pairs = spark.createDataFrame(
        list(zip((at * positives + place).tolist(), anchors.id[at].tolist(), ids[at, place].tolist(), score[at, place].tolist(), strict=True)),
        "search bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
    )
    return best.join(pairs, "search").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
