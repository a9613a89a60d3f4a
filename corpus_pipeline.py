"""A corpus pipeline of five stages; each reads what its predecessor wrote.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with the columns of
``docs``; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dramaturg.llm import decontamination, mixing, near_dedup, quality, sharding
from dramaturg.llm._shared import cut, shared_dir, table, written

#: Token weights of the mixture.
TARGETS = {"clean": 0.98, "toxic": 0.02}
SHARDS = 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.5; scores learn from the labelled documents.

    Null and empty texts are scored like others; repeated rows go or stay together; no rows give none.
    """
    voters = quality.fit(docs.select("doc_id", "text"), quality.labelled_quality(spark, sf_dir))
    return quality.score(docs, voters).filter("_score >= 0.5").select(docs.columns)


def told_apart(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` of ``docs`` and ``key``: the id, or a number below all ids where an id is null or has several texts.

    So a text goes only for a text like it. Equal rows share a key.
    """
    marked = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"))
    texts = marked.groupBy("doc_id").agg((F.min("_text") != F.max("_text")).alias("_several"), F.min("doc_id").isNull().alias("_null"))
    odd = cut(texts.filter("_several or _null").select("doc_id"))
    if odd.isEmpty():
        return docs.select("doc_id", "text", F.col("doc_id").alias(key))
    lowest = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0))).first()[0]
    same_id = F.col("m.doc_id").eqNullSafe(F.col("o.doc_id"))
    odd = marked.alias("m").join(odd.alias("o"), same_id, "left_semi").select("doc_id", "_text").distinct()
    odd = cut(odd.withColumn("_number", F.lit(lowest - 1) - F.monotonically_increasing_id()))
    found = marked.alias("m").join(odd.alias("o"), same_id & (F.col("m._text") == F.col("o._text")), "left")
    return found.select("m.doc_id", "m.text", F.coalesce("o._number", "m.doc_id").alias(key))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles, one document.

    It is the one with the smallest id; documents whose id is null or stands for several texts come
    first. Documents without words link with nothing and stay; rows that repeat id and text stay
    together; no rows give none.
    """
    own = told_apart(docs, "_key")
    found = near_dedup.near_duplicates(own.select(F.col("_key").alias("doc_id"), "text")).filter("not kept").select("doc_id").distinct()
    dropped = own.join(found.withColumnRenamed("doc_id", "_gone"), F.col("_key") == F.col("_gone"), "left_semi")
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text")).distinct()
    text = F.sha2(F.coalesce(F.col("d.text"), F.lit("")), 256)
    return docs.alias("d").join(dropped.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g._id")) & (text == F.col("g._text")), "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of every benchmark item's five-word shingles.

    Null and empty texts hold nothing and stay; repeated rows go or stay together; no rows give none.
    """
    searched = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return searched.filter(F.size("_items") == 0).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that clean and toxic tokens meet the targets.

    The total is what leaves the clean domain the tokens that it has, so that clean documents aren't
    dropped to make room for toxic ones. Targets that these documents can't meet (none of a domain
    is there) are warned of; the others are met. Null and empty texts have no tokens and the rate of
    their posteriors; repeated rows have equal rates; no rows give none.
    """
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    domains = list(TARGETS)
    model = mixing.fit_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", label.alias("label")), domains)
    members = written(mixing.posteriors(docs, model), "members")
    path = mixing.fit_rates(members, domains, TARGETS, kept="clean")
    if path.missed:
        warnings.warn(f"mixing misses the targets of {path.missed}: {path.have.tolist()} tokens of {domains}, wanted {path.want.tolist()}", stacklevel=2)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_copies")))
    return mixing.with_rates(members, path).withColumn("_copy", copies).select(docs.columns)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents, with the shard (near-equal bytes) and the place in it.

    Null texts have size 8; repeated rows have places of their own; no rows give none. Columns named
    ``shard`` or ``slot`` are replaced.
    """
    dealt = sharding.shard(docs, SHARDS)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return dealt.select(*kept, F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage but near duplicates and decontamination can be said in SQL.
ORACLE_SQL = None
