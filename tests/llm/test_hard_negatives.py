"""Hard negatives against brute force: ties, equal vectors, large numbers, awkward rows; and what the filter skips."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dramaturg.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10, ratios=(30, 90)):
    import math

    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, [math.floor(256.0 * y) for y in v])
        own[i] = min(own.get(i, x), x)
    out = []
    for a, (label, v) in own.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in own.items() if i != a)
        for s, p in [x for x in scored if own[x[1]][0] == label][:positives]:
            inside = [(n, i) for n, i in scored if own[i][0] != label and ratios[0] * -s <= 100 * -n <= ratios[1] * -s]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("cell", F.lit(0)).repartition(4)
    return sorted(tuple(r) for r in H.mine(frame, F.col("vec_id") % 3 == 0, **options).collect())


def drawn(n, width=6, seed=0, scale=1.0, labels=4):
    rng = np.random.default_rng(seed)
    return [(i, (scale * rng.normal(size=width)).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"block": 7}, {"directions": 1}, {"sample": 20, "block": 30}])
def test_equals_brute_force(spark, options):
    rows = drawn(150)
    got = mined(spark, rows, **options)
    assert got == brute(rows, lambda i: i % 3 == 0) and got


def test_ties_equal_vectors_and_different_norms(spark):
    rows = drawn(120, 3, 1)
    rows = [(i, [round(x) * 0.5 for x in v] if i % 2 else [1.0, 0.0, 0.0], label) for i, v, label in rows]
    rows = [(i, [x * (i % 5) for x in v], label) for i, v, label in rows]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_large_numbers_are_exact_and_larger_ones_an_error(spark):
    rows = drawn(60, 4, 2, 1e6)
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, drawn(30, 4, 2, 1e9))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = drawn(40, 4, 3, labels=2) + [(None, [1.0, 2.0, 3.0, 4.0], 0), (50, None, 0), (51, [1.0, None, 2.0, 1.0], 1), (52, [nan, 1.0, 1.0, 1.0], 0), (53, [1.0, inf, 1.0, 1.0], 1), (54, [1.0, 2.0, 3.0, 4.0], None)]
    rows += [(57, [], 0), (60, [1.0, 2.0], 1), (63, [1.0, 1.0, 1.0, 1.0, 1.0], 0), (66, [0.0] * 4, 1)]
    rows += [rows[3], rows[3], (9, [9.0, 1.0, 1.0, 0.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    assert mined(spark, [(3, [1.0], 0)]) == [] and mined(spark, []) == []


def test_narrow_clusters_are_skipped():
    """The filter scores only part of the pairs where rows lie in clusters, and misses none that counts."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16)) * 256
    v = np.concatenate([c + rng.normal(size=(100, 16)) * 4 for c in centres]).astype(np.int64)
    directions = H.references(v, 8)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    angles = np.arccos(np.clip(unit @ directions.T, -1, 1))
    cell = angles.argmin(axis=1)
    order = np.lexsort((angles[np.arange(len(v)), cell], cell))
    v, angles, cell, norm = v[order], angles[order].astype(np.float32), cell[order], np.linalg.norm(v[order], axis=1)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(v))), pa.array(np.zeros(len(v), np.int64)), pa.array(v.tolist()), pa.array(norm), pa.array(angles.tolist(), pa.list_(pa.float32())), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(v)), cell])],
        names=["id", "label", "v", "norm", "angles", "cell", "angle"],
    )
    anchors = H.Anchors([{"id": i, "label": 0, "v": v[i].tolist(), "norm": norm[i], "angles": angles[i].tolist()} for i in range(0, 800, 20)])
    scores = anchors.v @ v.T
    low, high = np.sort(scores, axis=1)[:, -50].astype(float), scores.max(axis=1).astype(float)
    seen = np.zeros(scores.shape, bool)
    for which, part, found in H.overlapping(batch, anchors, lambda: low, lambda: high, group=4):
        assert (found == scores[which][:, part]).all()
        seen[which[:, None], np.arange(part.start, part.stop)[None, :]] = True
    assert seen[scores >= low[:, None]].all() and seen.mean() < 0.3
