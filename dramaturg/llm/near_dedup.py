"""Near-duplicate groups by fast similarity sketching, banding and exact verification (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._shared import cut, small_batches, table, tidy_shuffles
from dramaturg.llm._words import shingle_sets
from dramaturg.llm.components import components
from dramaturg.llm.sketching import band_keys, fast_sketch, set_fingerprint

BANDS, WIDTH = 32, 5
#: Coordinates, four bits each, of the longer sketches that choose pairs inside mixed buckets.
CODES = 1024
#: Members of a bucket that are compared in one go; larger buckets are cut into blocks.
BLOCK = 1024
_SKETCH_ROWS = 1_000_000


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, f1, f2, bands``: set size, fingerprint and band keys of every text."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(list(batch["text"]), k)
            sizes = np.array([s.size for s in sets])
            prints = set_fingerprint(sets)
            bands = np.empty((len(sets), BANDS), np.int64)
            start = 0
            while start < len(sets):  # a bounded number of elements at a time
                end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), _SKETCH_ROWS)))
                part = fast_sketch(np.concatenate(sets[start:end]), sizes[start:end], BANDS * WIDTH)
                bands[start:end] = band_keys(part, BANDS, WIDTH)
                start = end
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": sizes, "f1": prints[:, 0], "f2": prints[:, 1], "bands": list(bands)})

    return docs.mapInPandas(sketch, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, set``: the sorted distinct shingle hashes as bytes."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "set": [s.tobytes() for s in shingle_sets(list(batch["text"]), k)]})

    return docs.mapInPandas(whole, "doc_id bigint, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets have 100 * intersection >= percent * union."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (x.size + y.size - common))
            yield batch.loc[keep, ["a", "b"]]

    one, two = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInPandas(verify, "a bigint, b bigint")


def _coded(sets: DataFrame) -> DataFrame:
    """``doc_id, code``: a longer sketch of each set, four bits a coordinate."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), 1 + len(batch) // 500):
                elements = [np.frombuffer(batch["set"].iat[i], np.uint64) for i in part]
                if elements:
                    sketch = fast_sketch(np.concatenate(elements), np.array([e.size for e in elements]), CODES, 99)
                    low = (sketch & np.uint64(15)).astype(np.uint8)
                    packed = low[:, ::2] << 4 | low[:, 1::2]
                    yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part], "code": [c.tobytes() for c in packed]})

    return sets.mapInPandas(encode, "doc_id bigint, code binary")


def _chosen(rows: pd.DataFrame, sure: float, cut_: float, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one block that need a comparison; see :func:`_block_pairs`."""
    m = len(rows)
    rep, label, n = rows["rep"].to_numpy(), rows["label"].to_numpy(), rows["n"].to_numpy()
    key = rows["key"].iat[0]
    # a member of the second block is compared with the first only, and the other way round
    side = rows["block"].to_numpy()
    two = rows["lo"].iat[0] != rows["hi"].iat[0]
    packed = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(m, CODES // 2)
    code = np.concatenate([packed >> 4, packed & 15], axis=1)
    estimate = np.zeros((m, m), np.float32)
    for i in range(m):
        estimate[i] = (code == code[i]).mean(axis=1)
    estimate = (estimate - 1 / 16) / (15 / 16)  # of different coordinates one in 16 agrees in four bits
    able = np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
    other = able & (label[:, None] != label[None, :])
    if two:
        other &= side[:, None] != side[None, :]
    tied = (other & (estimate >= sure)) | (label[:, None] == label[None, :])
    # a spanning forest of the pairs taken to be similar; members of one label need no pair
    tree = np.full(m, -1)
    for start in range(m):
        if tree[start] >= 0:
            continue
        tree[start] = start
        frontier = [start]
        while frontier:
            i = frontier.pop()
            new = np.flatnonzero(tied[i] & (tree < 0))
            tree[new] = start
            frontier += new.tolist()
            for j in new:
                if label[i] != label[j]:
                    yield min(rep[i], rep[j]), max(rep[i], rep[j])
    if cut_ < sure:
        bands = np.array(list(rows["bands"]), np.int64)
        for i, j in zip(*np.nonzero(np.triu(other & (estimate >= cut_) & (tree[:, None] != tree[None, :]), 1)), strict=True):
            same = bands[i] == bands[j]
            if key == bands[i][same].min():  # of the buckets that both are in, only one compares them
                yield min(rep[i], rep[j]), max(rep[i], rep[j])


def _block_pairs(members: DataFrame, labels: DataFrame, codes: DataFrame, sure: float, cut_: float, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components in one bucket that could be similar.

    Only buckets with several components matter. Their members are compared by the long sketches,
    in blocks of bounded size, each block with itself and with each other one. Pairs estimated at
    ``sure`` or more tie members together, and only a spanning forest of them is returned; of pairs
    that are not tied together so, all estimated at ``cut_`` or more are.
    """
    labelled = members.join(labels, members["rep"] == labels["node"], "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.filter("first < last").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_ = labelled.join(mixed, "key").join(codes, labelled["rep"] == codes["doc_id"]).drop("doc_id")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = open_.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bands = [F.col("bands")] if cut_ < sure else []
    spread = spread.select("key", "rep", "n", "label", "code", *bands, "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group: list[pd.DataFrame] = []
        for batch in batches:
            change = (batch[["key", "lo", "hi"]] != batch[["key", "lo", "hi"]].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change).tolist()
            pairs: list[tuple[int, int]] = []
            for at, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.iloc[at:end]
                last = open_group[-1].iloc[0] if open_group else None
                if last is not None and tuple(last[["key", "lo", "hi"]]) != tuple(part.iloc[0][["key", "lo", "hi"]]):
                    pairs += _chosen(pd.concat(open_group), sure, cut_, percent)
                    open_group = []
                open_group.append(part)
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])
        if open_group:
            pairs = list(_chosen(pd.concat(open_group), sure, cut_, percent))
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"])

    grouped = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return grouped.mapInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of near-duplicate documents of every row.

    1. Every text is sketched to 160 coordinates in 32 bands of 5; a pair of similarity 0.8 shares
       no band with probability 3e-6. Texts of equal sets (size and 128-bit fingerprint) become one
       class, represented by its smallest id; only classes go on.
    2. Each class is linked with the smallest class of its buckets: one candidate pair a class.
       Full sets are compared, and components of the confirmed links are found.
    3. Where classes of one bucket are in several components, longer sketches (1 024 coordinates,
       standard error 0.013 at 0.8) choose pairs: first a spanning forest of those estimated at
       the threshold or above; then, with the new components, all pairs that may still be similar
       (estimated up to five standard errors below it). Pairs inside one component can change
       nothing. So large families of near copies cost a few comparisons a copy.
    All chosen pairs are confirmed on their full sets.

    Only ids and band keys are shuffled for all documents; full sets are made again for those
    classes only that share a bucket.

    Defined results: null texts and texts without words have no shingles and link with nothing.
    Rows with a null id are left out of links (component null, not kept). An id is one
    document: rows that repeat an id are all reported, and if their texts differ, what either
    links with is one component. An empty table gives an empty result.
    Returns ``doc_id, n_shingles, component_id, kept``.
    """
    small_batches(docs.sparkSession)
    with tidy_shuffles(docs.sparkSession):
        return _near_duplicates(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), k, percent)


def _near_duplicates(rows: DataFrame, k: int, percent: int) -> DataFrame:
    sketched = cut(_sketched(rows, k))
    classes = (
        sketched.filter("n > 0 and doc_id is not null")
        .groupBy("n", "f1", "f2")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.max("rep").alias("last")).filter("last > head.rep")
    members = cut(banded.join(heads.select("key", "head"), "key").select("key", "rep", "n", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n")))

    fits = F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * percent
    first = members.filter((F.col("head") < F.col("rep")) & fits).groupBy("rep").agg(F.min("head").alias("a"))
    first = first.select("a", F.col("rep").alias("b"))
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(_sets(rows.join(needed, "doc_id", "left_semi"), k))
    links = cut(_confirmed(first, sets, percent))
    labels = components(links)
    bands = classes.select(F.col("rep").alias("doc_id"), "bands")
    codes = cut(_coded(sets).join(bands, "doc_id"))

    agree = percent / 100 + (1 - percent / 100) / 16
    error = (agree * (1 - agree) / CODES) ** 0.5 * 16 / 15
    for sure, least in ((percent / 100, 1.0), (percent / 100 + 5 * error, percent / 100 - 5 * error)):
        pairs = cut(_block_pairs(members, labels, codes, sure, min(sure, least), percent))
        if not pairs.isEmpty():
            links = cut(links.unionAll(_confirmed(pairs, sets, percent)))
            labels = components(links)

    reps = classes.select("n", "f1", "f2", "rep")
    known = sketched.select("doc_id", "n", "f1", "f2").join(reps, ["n", "f1", "f2"], "left")
    known = known.join(labels, known["rep"] == labels["node"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return known.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
  FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN lowest USING (doc_id)
"""
