"""Exact deduplication by 128-bit content hash (operator 4), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.llm._shared import cut, table


def normalised(text: str = "text"):
    """The text with each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark every row with the group of equal texts that it belongs to.

    Rows are grouped by the MD5 of the normalised text and by the text itself: the hash decides
    where a group meets, the bytes are compared only among rows of one hash, so a collision cannot
    merge two texts. The smallest id of a group stays. The aggregation combines on the map side
    first, so a text that a third of all rows share reaches the shuffle once per task.

    Hashes of more than one row are cut into the shared folder, without texts. Where such a hash
    belongs to one text (the comparison just made proves it), it alone leads a row to its group:
    the second shuffle moves ids and hashes only, and adaptive execution can split its hot
    partitions. Rows of hashes with several texts, if there are any, are joined by text.

    Defined results: null and empty texts form one group; a text of white space only is one space,
    a different group. Rows with a null id take part and sort after all ids; rows repeated with
    one id are all reported, each counts in ``group_size``, and all of the smallest id are
    ``kept``. An empty table gives an empty result. Further columns are ignored.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("hash", F.unhex(F.md5(F.col("norm").cast("binary"))))
    groups = rows.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    hashes = groups.groupBy("hash").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    hashes = cut(hashes.filter("group_size > 1"))
    columns = ["doc_id", "keep_id", "group_size", "sha", "lone"]
    bare = rows.select("doc_id", "hash", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    found = bare.join(hashes.filter("texts = 1"), "hash", "left").withColumn("lone", F.col("texts").isNull())
    clashing = hashes.filter("texts > 1").select("hash")
    if not clashing.isEmpty():
        exact = rows.join(clashing, "hash", "left_semi").join(groups.join(clashing, "hash", "left_semi"), ["hash", "norm"])
        exact = exact.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).withColumn("lone", F.lit(False))
        found = found.join(clashing, "hash", "left_anti").select(columns).unionAll(exact.select(columns))
    keep = F.when(F.col("lone"), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(F.col("lone"), F.lit(1)).otherwise(F.col("group_size")).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
