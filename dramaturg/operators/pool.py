"""The pool of field updates: from logs, from differences of snapshots, and from audits, as rows of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPDATE = ["corpus", "character", "episode", "field", "merge_type", "old_value", "new_value", "evidence_ids", "reasoning", "source", "from_version", "to_version"]


def _no_ids() -> Column:
    return F.array().cast("array<bigint>")


def from_snapshots(snapshots: DataFrame, order: list[str]) -> DataFrame:
    """Fields that differ where a character's version changes; ``fields`` of a snapshot is a map.

    A field that is new has a null old value; one that is gone, or null now, is no update. Rows:
    ``corpus, character, episode, version, fields`` and what orders them.
    """
    w = Window.partitionBy("corpus", "character").orderBy(*order)
    seen = snapshots.withColumns({"_version": F.lag("version").over(w), "_fields": F.lag("fields").over(w), "_episode": F.lag("episode").over(w)})
    bumped = seen.filter(F.col("_version").isNotNull() & ~F.col("_version").eqNullSafe(F.col("version")))
    rows = bumped.select("*", F.explode("fields").alias("field", "new_value")).withColumn("old_value", F.try_element_at("_fields", F.col("field")))
    rows = rows.filter(F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("old_value")))
    told = F.format_string("from snapshots %s/%s to %s/%s", "_episode", "_version", "episode", "version")
    return rows.select(
        "corpus", "character", "episode", "field", F.lit("unknown_diff").alias("merge_type"), "old_value", "new_value", _no_ids().alias("evidence_ids"), told.alias("reasoning"),
        F.lit("snapshot_diff").alias("source"), F.col("_version").alias("from_version"), F.col("version").alias("to_version"),
    )


def from_log(log: DataFrame) -> DataFrame:
    """One row a changed field: ``changes`` maps a field to ``old_value, new_value, merge_type, evidence_ids``; without a new value it's none."""
    rows = log.select("*", F.explode("changes").alias("field", "_c")).filter(F.col("_c")["new_value"].isNotNull())
    return rows.select(
        "corpus", "character", "episode", "field", F.coalesce(F.col("_c")["merge_type"], F.lit("unknown")).alias("merge_type"), F.col("_c")["old_value"].alias("old_value"),
        F.col("_c")["new_value"].alias("new_value"), F.coalesce(F.col("_c")["evidence_ids"], _no_ids()).alias("evidence_ids"), "reasoning", F.lit("evolution_log").alias("source"), "from_version", "to_version",
    )


def from_audits(audits: DataFrame) -> DataFrame:
    """One row an audit that applied anything: the evidence of all that it applied, each id once in order, and their reasons.

    ``applied`` is a list of ``evidence_ids, reasoning``; where no part has a reason the audit's own counts.
    """
    some = audits.filter(F.size("applied") > 0)
    ids = F.array_distinct(F.flatten(F.transform("applied", lambda a: F.coalesce(a["evidence_ids"], _no_ids()))))
    reasons = F.array_join(F.filter(F.transform("applied", lambda a: a["reasoning"]), lambda r: F.coalesce(r, F.lit("")) != ""), " | ")
    return some.select(
        "corpus", "character", "episode", F.coalesce("field", F.lit("personality")).alias("field"), F.lit("core_audit").alias("merge_type"), "old_value", "new_value", ids.alias("evidence_ids"),
        F.when(reasons != "", reasons).otherwise(F.col("reasoning")).alias("reasoning"), F.lit("core_audit").alias("source"), F.lit(None).cast("string").alias("from_version"), F.lit(None).cast("string").alias("to_version"),
    )


def update_id(*parts: Column, digits: int = 12) -> Column:
    """The first hex digits of the MD5 of the parts, which tell an update from others; nulls count as empty."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, digits)


def pooled(sources: list[DataFrame], stratum: Column, bucket: Column) -> DataFrame:
    """All sources as one pool, with ``update_id``, the field's ``stratum`` (audits are core) and the episode's ``bucket``."""
    rows = reduce(DataFrame.unionByName, [s.select(UPDATE) for s in sources])
    key = update_id(*(F.col(c) for c in ("source", "corpus", "character", "episode", "field")), F.substring("new_value", 1, 80))
    return rows.select(key.alias("update_id"), "*", F.when(F.col("source") == "core_audit", "core").otherwise(stratum).alias("stratum"), bucket.alias("bucket"))


def with_evidence(pool: DataFrame, scenes: DataFrame) -> DataFrame:
    """``pool`` with ``evidence``: cited scenes in the order of citation, those that aren't there marked missing.

    ``scenes``: ``scene_id, summary, significance``. An update that cites nothing has an empty list.
    Updates with one ``update_id`` (the same change told twice) share their evidence: all that either
    cites, by place of citation, then by id.
    """
    cited = pool.select("update_id", F.posexplode("evidence_ids").alias("_at", "scene_id"))
    found = cited.join(scenes.select("scene_id", "summary", "significance"), "scene_id", "left").groupBy("update_id", "_at", "scene_id").agg(F.min(F.struct("summary", "significance")).alias("_s"))
    entry = F.struct("_at", "scene_id", F.coalesce("_s.summary", F.lit("")).alias("summary"), "_s.significance", F.col("_s.summary").isNull().alias("missing"))
    told = found.groupBy("update_id").agg(F.sort_array(F.collect_set(entry)).alias("_e"))
    parts = F.transform("_e", lambda e: F.struct(e["scene_id"].alias("scene_id"), e["summary"].alias("summary"), e["significance"].alias("significance"), e["missing"].alias("missing")))
    none = F.array().cast("array<struct<scene_id:bigint,summary:string,significance:string,missing:boolean>>")
    return pool.join(told, "update_id", "left").withColumn("evidence", F.coalesce(parts, none)).drop("_e")
