"""Similar scenes by vectors, with same-scene exclusion; clusters."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.sources.scratch import cut

#: Tasks may not have this package on their path, so functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


def unit(a: Column, scale: float = 1.0) -> Column:
    """The vector at length ``scale``; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), size) * scale, x.cast("double")))


#: Queries and pool rows multiplied at once: 2 MB of products.
TILE = (256, 1024)


def _merged(kept_s: np.ndarray, kept_i: np.ndarray, queries: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> None:
    """Put pairs (query, similarity, id) that may be among the best into the ``k`` kept of each query, in place."""
    touched, at = np.unique(queries, return_inverse=True)
    q = np.concatenate([at, np.repeat(np.arange(len(touched)), k)])
    s, i = np.concatenate([s, kept_s[touched].ravel()]), np.concatenate([i, kept_i[touched].ravel()])
    # by similarity, then by the smaller id
    order = np.lexsort((i, -np.round(s, 12), q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    best = order[place < k]
    kept_s[touched], kept_i[touched] = s[best].reshape(-1, k), i[best].reshape(-1, k)


def _best(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, scenes: np.ndarray | None, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each query among the rows of the batches."""
    kept_s = np.full((len(ids), k), -np.inf)
    kept_i = np.zeros((len(ids), k), np.int64)
    for batch in (b.slice(at, TILE[1]) for b in batches for at in range(0, b.num_rows, TILE[1])):
        own = batch.column(0).to_numpy(zero_copy_only=False)
        vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        there = np.array(batch.column(2).to_pylist(), object) if scenes is not None else None
        for at in range(0, len(ids), TILE[0]):
            part = slice(at, at + TILE[0])
            s = matrix[part] @ vectors.T
            # what rounds to the last one kept may still go before it by its id
            q, p = np.nonzero(s >= kept_s[part, -1:] - 1e-11)
            left = ids[part][q] != own[p]
            if scenes is not None:
                left &= scenes[part][q] != there[p]
            q, p = q[left], p[left]
            if len(q):
                _merged(kept_s[part], kept_i[part], q, s[q, p], own[p], k)
    ok = np.isfinite(kept_s)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(ids[:, None], kept_i.shape)[ok]), pa.array(kept_i[ok]), pa.array(kept_s[ok])], names=["query_id", "vec_id", "similarity"]
    )


def top_k(pool: DataFrame, queries: DataFrame, k: int, exclude: str | None = None, block: int = 4096) -> DataFrame:
    """The ``k`` most similar pool rows of each query: ``query_id, vec_id, similarity, place``.

    Both have ``vec_id, embedding`` (and the ``exclude`` column: pool rows with the query's value
    are left out, as is the query itself). Queries are taken in blocks of at most ``block`` rows,
    each broadcast; tasks multiply tiles of their pool rows and of a block and send on only their own
    best k of each query, so what is shuffled doesn't depend on the pool's size, and what a task holds
    depends only on ``TILE`` and on ``block`` times ``k``. Ties go to the smaller id.
    """
    spark = pool.sparkSession
    columns = ["vec_id", "embedding", *([exclude] if exclude else [])]
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        part = queries.select(columns) if blocks == 1 else queries.select(columns).filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = part.orderBy("vec_id").collect()
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        matrix = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        scenes = np.array([r[exclude] for r in rows], object) if exclude else None
        shared = spark.sparkContext.broadcast((ids, matrix, scenes))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            if len(shared.value[0]):
                yield from _best(batches, *shared.value, k)

        found = pool.select(columns).mapInArrow(best, "query_id bigint, vec_id bigint, similarity double")
        out = found if out is None else out.unionAll(found)
    rank = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "vec_id")
    return out.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k)


def leak_diagnostics(queries: DataFrame, pool: DataFrame, scene: str) -> DataFrame:
    """How many queries have pool rows of their own scene, and how many such rows."""
    sizes = pool.groupBy(scene).agg(F.count(F.lit(1)).alias("_n"))
    own = queries.join(sizes, scene, "left").withColumn("_same", F.coalesce(F.col("_n") - 1, F.lit(0)))
    return own.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("_same") > 0).alias("with_same_scene"),
        F.round(F.avg("_same"), 6).alias("mean_excluded"), F.max("_same").alias("max_excluded"),
    )


def centroids(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``cluster, size, centroid``; elements are averaged as rows, with map-side sums."""
    items = rows.select(cluster, F.posexplode(vector).alias("_i", "_x"))
    means = items.groupBy(cluster, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("size"))
    return means.groupBy(cluster).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c")).select(cluster, "size", F.col("_c._m").alias("centroid"))


def distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def isolation(centres: DataFrame, cluster: str) -> DataFrame:
    """Mean distance to the other centroids over 1 + size; centroids are few."""
    a, b = centres.alias("a"), centres.alias("b")
    gaps = a.join(b, F.col(f"a.{cluster}") != F.col(f"b.{cluster}")).select(
        F.col(f"a.{cluster}").alias(cluster), F.col("a.size").alias("size"), distance(F.col("a.centroid"), F.col("b.centroid")).alias("_d")
    )
    return gaps.groupBy(cluster, "size").agg(F.round(F.avg("_d") / (1 + F.first("size")), 6).alias("isolation"))


def furthest_members(rows: DataFrame, centres: DataFrame, cluster: str, vector: str, n: int, key: str = "vec_id") -> DataFrame:
    far = rows.join(centres, cluster).withColumn("distance", F.round(distance(F.col(vector), F.col("centroid")), 6))
    rank = Window.partitionBy(cluster).orderBy(F.desc("distance"), key)
    return far.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= n).select(cluster, key, "distance", "place")


def mean_difference(rows: DataFrame, by: str, side: Column, vector: str) -> DataFrame:
    """``by, i, delta``: element-wise mean where ``side`` holds minus where it doesn't."""
    items = rows.select(by, side.alias("_side"), F.posexplode(vector).alias("i", "_x"))
    return items.groupBy(by, "i").agg(
        F.round(F.avg(F.when(F.col("_side"), F.col("_x").cast("double"))) - F.avg(F.when(~F.col("_side"), F.col("_x").cast("double"))), 6).alias("delta"),
        F.round(F.stddev_samp(F.col("_x").cast("double")), 6).alias("spread"),
    )


def clustered(rows: DataFrame, key: str, vector: str, most: int, seed: int = 42) -> tuple[DataFrame, int, float]:
    """``rows`` with ``cluster``, the number of clusters and its silhouette.

    k-means is fitted for each k from 3 below ``most`` (and below the number of rows); the first k
    of the best silhouette is kept. The number of fits doesn't depend on the data.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    made = rows.withColumn("features", array_to_vector(F.col(vector))).repartition(key).sortWithinPartitions(key)
    score, best, chosen = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean"), None, (3, -1.0)
    for k in range(3, max(4, min(most, rows.count()))):
        model = KMeans(k=k, seed=seed, maxIter=20).fit(made)
        found = score.evaluate(model.transform(made)) if len(model.clusterCenters()) > 1 else -1.0
        if best is None or found > chosen[1]:
            best, chosen = model, (k, found)
    return best.transform(made).drop("features").withColumnRenamed("prediction", "cluster"), *chosen


def three_way_split(rows: DataFrame, key: str, cluster: str, vector: str, n_ood: int, n_random: int, groups: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: the most isolated clusters are ``ood``, a diverse sample ``random``, the rest ``train``.

    Clusters are taken whole in order of isolation until ``n_ood``; of the one that doesn't fit the
    members furthest from its centre are taken. What remains is clustered anew into ``groups``; each
    gives its rounded share of ``n_random`` (one more for the largest while some are missing).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    centres = centroids(rows, cluster, vector)
    left, take = n_ood, {}
    for r in isolation(centres, cluster).orderBy(F.desc("isolation"), cluster).collect():  # one row a cluster
        take[r[cluster]] = min(left, r["size"])
        left -= take[r[cluster]]
    far = furthest_members(rows, centres, cluster, vector, n_ood, key)
    wanted = F.create_map(*[F.lit(x) for pair in take.items() for x in pair])
    ood = cut(far.filter(F.col("place") <= wanted[F.col(cluster)]).select(key))
    rest = rows.join(ood, key, "left_anti").withColumn("features", array_to_vector(F.col(vector))).repartition(key).sortWithinPartitions(key)
    n_rest = rest.count()
    if n_rest > n_random and min(groups, n_rest) >= 2:
        grouped = KMeans(k=min(groups, n_rest), seed=seed, maxIter=20).fit(rest).transform(rest).select(key, F.col("prediction").alias("group"))
        counts = {r["group"]: r["count"] for r in grouped.groupBy("group").count().collect()}
        share = {g: round(c / n_rest * n_random) for g, c in counts.items()}
        for g in sorted(counts, key=lambda g: (-counts[g], g))[: max(0, n_random - sum(share.values()))]:
            share[g] += 1
    else:
        grouped, share = rest.select(key, F.lit(0).alias("group")), {0: min(n_random, n_rest)}
    quota = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    order = Window.partitionBy("group").orderBy(F.xxhash64(key, F.lit(seed)), key)
    chosen = grouped.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= quota[F.col("group")]).select(key, F.lit("random").alias("_random"))
    named = rows.join(ood.withColumn("_ood", F.lit("ood")), key, "left").join(chosen, key, "left")
    return named.withColumn("split", F.coalesce("_ood", "_random", F.lit("train"))).drop("_ood", "_random")
