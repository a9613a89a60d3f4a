"""Sharding by histogram sort (operator 1), DataFrame functions only.

Rows are ordered by ``(xxhash64(text), id)``. Splitters between shards are found by counting, in
rounds, the exact bytes below candidate boundaries over all partitions and narrowing each
splitter's interval until the count meets the tolerance; then rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.llm._shared import cut, fresh, replaced, table, written

_LOW, _HIGH = -(2**63), 2**63 - 1


#: What is known of the rows of a cell: bytes, rows, and the extent of hashes and of ids.
_NONE = (0, 0, 0, 0, 0, 0)


def _counts() -> list[Column]:
    return [F.sum("size"), F.count(F.lit(1)), F.min("h"), F.max("h"), F.min("id"), F.max("id")]


def _count_below(keys: DataFrame, cells: list[tuple[tuple[int, int], tuple[int, int]]]) -> list[tuple]:
    """Exact bytes and rows, and the extent, of each cell ``[lower, upper)`` of the key order.

    ``cells`` are disjoint and sorted; their number is bounded by the parameters of the operator.
    One pass over the keys with a map-side sum; only one row a cell comes to the driver.
    """
    spark = keys.sparkSession
    probes = spark.createDataFrame(
        [(i, lo[0], lo[1], up[0], up[1]) for i, (lo, up) in enumerate(cells)],
        "cell int, lo_h bigint, lo_id bigint, up_h bigint, up_id bigint",
    )
    by_bucket = (
        probes.select("*", F.explode(F.sequence(_bucket(F.col("lo_h")), _bucket(F.col("up_h")))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("cell", "lo_h", "lo_id", "up_h", "up_id")).alias("near"))
    )
    here = lambda c: (
        ((F.col("h") > c.lo_h) | ((F.col("h") == c.lo_h) & (F.col("id") >= c.lo_id)))
        & ((F.col("h") < c.up_h) | ((F.col("h") == c.up_h) & (F.col("id") < c.up_id)))
    )
    found = (
        keys.join(F.broadcast(by_bucket), _bucket(F.col("h")) == F.col("bucket"))
        .select(F.get(F.filter("near", here), F.lit(0))["cell"].alias("cell"), "size", "h", "id")
        .filter(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(*_counts())
    )
    return _collected(found, len(cells))


def _collected(found: DataFrame, n: int) -> list[tuple]:
    out = [_NONE] * n
    for cell, *counts in found.collect():
        out[cell] = tuple(counts)
    return out


def _bucket(h: Column) -> Column:
    """The top 12 bits of the order-preserving hash, 0 to 4095."""
    return (F.shiftright(h, 52) + 2048).cast("int")


def _cut_points(lower: tuple[int, int], upper: tuple[int, int], known: tuple, parts: int) -> list[tuple[int, int]]:
    """Boundaries that cut a cell evenly within its extent: by hash, or by id where one hash is left."""
    _, _, h0, h1, id0, id1 = known
    if h0 == h1:
        points = [(h0, min(id0 + (id1 + 1 - id0) * j // parts, _HIGH)) for j in range(parts + 1)]
    else:
        points = [(h0 + -(-(h1 + 1 - h0) * j // parts), _LOW) for j in range(parts + 1)]
    return sorted({p for p in points if lower < p < upper})


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.002,
    parts: int = 128,
    rounds: int = 40,
    hot: float = 4.0,
    most_rows: int = 1 << 20,
) -> DataFrame:
    """Deal all rows into ``shards`` contiguous key ranges of near-equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 8. The first round counts 4 096
    cells of the hash range; later rounds cut only the cells that hold a splitter (or more than
    ``hot`` 4 096ths of all rows) into ``parts``. A splitter is settled once the bytes below it are
    within ``tolerance`` of a shard's share, or one key is left; then the nearer side is taken.
    ``rounds`` is far above what 128 bits of key need; should they not do, that is an error.
    Equal texts share a hash and lie side by side; ids split a hot text further, so a group that
    holds a third of all rows fills several shards. All counted boundaries also serve as blocks:
    rows are exchanged once by block, ranked inside their block and offset by the exact number of
    rows below it, so no block holds more than ``hot`` 4 096ths of the rows (at least 500, at most
    ``most_rows``). Where more rows than that repeat both text and id, all rows are written once
    with a number of their own, which takes the place of the id in their order.

    Defined results: a null text has size 8 and its own hash place; a null id sorts as the
    smallest. Rows that repeat both text and id have slots of their own. An empty table gives an empty result. All columns of ``docs`` are returned, with ``size, shard,
    slot`` and the hash ``h`` added under the names ``_size, _shard, _slot, _h`` (columns so named
    are replaced).
    """
    order_id = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LOW + 1))
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # the very last hash value is left free, so that an upper boundary above all keys exists
    h = F.least(hashed, F.lit(_HIGH - 1))
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(8)).cast("bigint")
    keys = cut(docs.select(h.alias("h"), order_id.alias("id"), size.alias("size")))

    step = 1 << 52
    edges = [(_LOW + step * j, _LOW) for j in range(4096)] + [(_HIGH, _LOW)]
    first = _collected(keys.groupBy(_bucket(F.col("h")).alias("cell")).agg(*_counts()), 4096)
    known = dict(zip(edges, first, strict=False))
    below: dict[tuple[int, int], tuple[int, int]] = {}
    at = (0, 0)
    for edge, cell in zip(edges, [*first, _NONE], strict=True):
        below[edge] = at
        at = (at[0] + cell[0], at[1] + cell[1])
    bytes_all, rows_all = at

    goals = [bytes_all * j / shards for j in range(1, shards)]
    slack = tolerance * bytes_all / shards
    limit = min(max(hot * rows_all / 4096, 500), most_rows)
    stuck: set[tuple[int, int]] = set()
    for _ in range(rounds):
        order = sorted(below)
        counts = [below[e][0] for e in order]
        todo: dict[tuple[int, int], tuple[int, int]] = {}
        for goal in goals:
            i = min(max(bisect_right(counts, goal) - 1, 0), len(order) - 2)
            if min(goal - counts[i], counts[i + 1] - goal) > slack and order[i] not in stuck:
                todo[order[i]] = order[i + 1]
        for a, b in zip(order, order[1:], strict=False):
            if below[b][1] - below[a][1] > limit and a not in stuck:
                todo[a] = b
        cells: list[tuple[tuple[int, int], tuple[int, int]]] = []
        for a in sorted(todo):
            points = _cut_points(a, todo[a], known[a], parts) if known[a][1] > 1 else []
            if points:
                cells += list(zip([a, *points], [*points, todo[a]], strict=True))
            else:
                stuck.add(a)
        if not cells:
            break
        for (a, b), cell in zip(cells, _count_below(keys, cells), strict=True):
            known[a] = cell
            below[b] = (below[a][0] + cell[0], below[a][1] + cell[1])
    else:
        raise RuntimeError(f"splitters aren't settled after {rounds} rounds")

    if any(known[a][1] > limit for a in stuck):
        (row,) = fresh(docs, "row")
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        return shard(numbered, shards, row, text_col, tolerance, parts, rounds, hot, most_rows).drop(row)

    order = sorted(below)
    counts = [below[e][0] for e in order]
    splitters = []
    for goal in goals:
        i = min(max(bisect_right(counts, goal) - 1, 0), len(order) - 2)
        splitters.append(order[i] if goal - counts[i] <= counts[i + 1] - goal else order[i + 1])
    blocks, slot_base = [], 0
    last = 0
    for n, edge in enumerate(order[:-1]):
        s = bisect_right(splitters, edge)
        if s != last or n == 0:
            slot_base, last = below[edge][1], s
        blocks.append((n, edge[0], edge[1], s, below[edge][1] - slot_base, order[n + 1][0]))
    return _deal(docs, h, order_id, size, blocks)


def _deal(docs: DataFrame, h: Column, order_id: Column, size: Column, blocks: list[tuple]) -> DataFrame:
    """The one exchange: look the block up by the top bits, rank rows inside it, add its offset."""
    spark = docs.sparkSession
    docs = replaced(docs, "_size", "_shard", "_slot", "_h")
    place, near, bucket, at, block = fresh(docs, "order_id", "near", "bucket", "at", "block")
    bounds = (
        spark.createDataFrame(blocks, "block int, lo_h bigint, lo_id bigint, shard int, base bigint, up_h bigint")
        .select("*", F.explode(F.sequence(_bucket(F.col("lo_h")), _bucket(F.greatest(F.col("lo_h"), F.col("up_h"))))).alias(bucket))
        .groupBy(bucket)
        .agg(F.sort_array(F.collect_list(F.struct("lo_h", "lo_id", "block", "shard", "base"))).alias(near))
    )
    at_or_above = lambda c: (c.lo_h < F.col("_h")) | ((c.lo_h == F.col("_h")) & (c.lo_id <= F.col(place)))
    placed = docs.select("*", h.alias("_h"), order_id.alias(place), size.alias("_size")).join(F.broadcast(bounds), _bucket(F.col("_h")) == F.col(bucket))
    placed = placed.withColumn(at, F.element_at(F.filter(near, at_or_above), -1)).drop(near, bucket)
    rank = Window.partitionBy(block).orderBy("_h", place, "_size")
    return (
        placed.select("*", F.col(at)["block"].alias(block), F.col(at)["shard"].alias("_shard"))
        .withColumn("_slot", F.col(at)["base"] + F.row_number().over(rank) - 1)
        .drop(at, block, place)
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's query: law ``bytes`` over all documents, 24 shards."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    return shard(docs, 24).select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
