"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6).

Both sides are partitioned by size (powers of two of the number of shingles). A signature has m
bins and keeps the least hash of each bin; it agrees with another in a bin if the least hash of the
two sets' union lies in both. For a pair of partitions m is the smallest power of two for which a
document that holds ``percent`` of an item's shingles agrees with it nowhere with a probability of
at most ``miss``. So long documents get long signatures for short items, short ones don't.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._shared import cut, fresh, replaced, table, with_computed
from dramaturg.llm._words import mix64, shingle_sets

FIELDS = "_n_shingles bigint, _items array<bigint>, _containment double"


def bins_needed(doc_size: int, item_size: int, shared: int, miss: float) -> int:
    """log2 of the number of bins for sets of at most these sizes that share ``shared`` elements."""
    n = doc_size + item_size
    for log in range(1, 63):
        m = 2.0**log
        agree = -m / n * math.expm1(-n / m)
        if agree < 1 and shared * math.log1p(-agree) <= math.log(miss) or agree >= 1:
            return log
    return 62


def bin_minima(ordered: np.ndarray, log_bins: int) -> np.ndarray:
    """The least hash of each bin, of sorted hashes; a bin is a hash's leading bits."""
    bins = ordered >> np.uint64(64 - log_bins)
    first = np.ones(ordered.size, bool)
    first[1:] = bins[1:] != bins[:-1]
    return ordered[first]


class ItemIndex:
    """Signatures of the items, per size partition of documents; made when first asked for."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int, miss: float):
        self.ids, self.percent, self.miss = ids, percent, miss
        self.sets = [np.sort(mix64(s)) for s in sets]
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if s.size:
                self.classes.setdefault(int(s.size).bit_length() - 1, []).append(i)
        self._made: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def _signatures(self, doc_class: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        if doc_class not in self._made:
            out = []
            for item_class, members in self.classes.items():
                shared = -(-self.percent * 2**item_class // 100)
                log = bins_needed(2 ** (doc_class + 1), 2 ** (item_class + 1), shared, self.miss)
                minima = [bin_minima(self.sets[i], log) for i in members]
                value = np.concatenate(minima)
                owner = np.repeat(np.array(members), [m.size for m in minima])
                order = np.argsort(value, kind="stable")
                out.append((log, value[order], owner[order]))
            self._made[doc_class] = out
        return self._made[doc_class]

    def search(self, shingles: np.ndarray) -> tuple[list, float]:
        """Ids of the items that a document contains, and the largest containment among them."""
        if not shingles.size:
            return [], 0.0
        ordered = np.sort(mix64(shingles))
        candidates: set[int] = set()
        for log, value, owner in self._signatures(int(ordered.size).bit_length() - 1):
            minima = bin_minima(ordered, log)
            lo = np.searchsorted(minima, value)
            hit = minima[np.minimum(lo, minima.size - 1)] == value
            candidates.update(owner[hit].tolist())
        found, best = [], 0.0
        for i in sorted(candidates):
            item = self.sets[i]
            at = np.minimum(np.searchsorted(ordered, item), ordered.size - 1)
            common = int((ordered[at] == item).sum())
            if 100 * common >= self.percent * item.size:
                found.append(self.ids[i])
                best = max(best, common / item.size)
        return found, best


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    percent: int = 80,
    miss: float = 1e-6,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Add to each document the items of which it holds at least ``percent`` of the k-word shingles.

    The items' total bytes are counted first. Up to ``block_bytes`` of text (some ten thousand
    items) are broadcast and every document is searched in one pass without a shuffle; more items
    are searched in blocks of that size, with the table cut between passes. Candidates are
    confirmed on the whole shingle sets.

    Defined results: null texts and texts without words hold nothing; texts of fewer than k words
    have their whole sequence as one shingle; an empty item matches nothing. Items with equal
    texts are all reported, items with a null id as null. Without items every list is empty.
    All columns and rows of ``docs`` come back, with ``_n_shingles, _items, _containment``
    (columns so named are replaced).
    """
    spark = docs.sparkSession
    own = ("_n_shingles", "_items", "_containment")
    docs = replaced(docs, *own)
    chosen = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    size = chosen.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-size // block_bytes))
    columns = docs.columns
    before = fresh(docs, "n_before", "items_before", "containment_before")
    for b in range(blocks):
        # equal texts of a block are kept: the hash deals out by text and id
        part = chosen if blocks == 1 else chosen.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(
            ItemIndex([r["item_id"] for r in rows], shingle_sets([r["text"] for r in rows], k), percent, miss)
        )

        def search(texts, shared=shared):
            sets = shingle_sets(texts, k)
            found = [shared.value.search(s) for s in sets]
            return [s.size for s in sets], [f[0] for f in found], [f[1] for f in found]

        if b:
            docs = cut(docs.withColumnsRenamed(dict(zip(own, before, strict=True))))
        docs = with_computed(docs, text_col, FIELDS, search)
        if b:
            docs = docs.select(
                *columns,
                "_n_shingles",
                F.concat(before[1], "_items").alias("_items"),
                F.greatest(before[2], "_containment").alias("_containment"),
            )
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        F.col("_n_shingles").alias("n_shingles"),
        F.array_sort("_items").alias("item_ids"),
        F.round("_containment", 6).alias("containment"),
        (F.size("_items") > 0).alias("contaminated"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id AS id, true AS is_doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark
), w AS (
  SELECT id, is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM t
), s AS (
  SELECT id, is_doc, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), e AS (
  SELECT id, is_doc, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), hits AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) / any_value(i.n) AS containment
  FROM e d JOIN e i ON d.shingle = i.shingle AND d.is_doc AND NOT i.is_doc
  GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(i.n)
), per_doc AS (
  SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, round(max(containment), 6) AS containment FROM hits GROUP BY doc_id
)
SELECT s.id AS doc_id, len(s.shingles) AS n_shingles, coalesce(item_ids, []) AS item_ids,
  coalesce(containment, 0.0) AS containment, p.doc_id IS NOT NULL AS contaminated
FROM s LEFT JOIN per_doc p ON p.doc_id = s.id WHERE s.is_doc
"""
