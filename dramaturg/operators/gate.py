"""The update gate over proposals with cited scenes: what may be cited, thresholds by tier, and the value's own checks.

Evidence is ``dataset, character, scene_id, ep, significance, status`` (active, expired or consumed);
proposals are ``dataset, character, ep, proposal_id, field, resistance, updated_at, old_value,
new_value, merge_type, cited``. ``resistance`` is null for fields that the persona doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.functions.text import word_recall
from dramaturg.operators.fold import KEPT_LENGTH, KEPT_WORDS, RECENT_MEDIUM, STOP_WORDS
from dramaturg.operators.state import GATES

PROPOSAL = ["dataset", "character", "ep", "proposal_id"]


def scene_ids(cited: Column) -> Column:
    """Canonical ids ``s01_e02_c03`` named in a citation, however it is written: ``S1E2_c3``, ``scene s01-e02-c03``."""
    found = F.regexp_extract_all(F.lower(cited), F.lit(r"(s\d+[_\s-]?e\d+[_\s-]?c\d+)"), F.lit(1))
    number = lambda one, sign: F.lpad(F.regexp_extract(one, sign + r"(\d+)", 1).cast("bigint").cast("string"), 2, "0")
    # a longer number keeps all its digits
    wide = lambda one, sign: F.when(F.length(F.regexp_extract(one, sign + r"0*(\d+)", 1)) > 2, F.regexp_extract(one, sign + r"0*(\d+)", 1)).otherwise(number(one, sign))
    return F.transform(found, lambda one: F.concat(F.lit("s"), wide(one, "s"), F.lit("_e"), wide(one, "e"), F.lit("_c"), wide(one, "c")))


def citable(proposals: DataFrame, evidence: DataFrame, medium: int = RECENT_MEDIUM) -> DataFrame:
    """What proposals may cite of what they cite: ``PROPOSAL, scene_id, scene_ep, significance, place``.

    Any field may cite active evidence of its character up to the proposal's episode: all high, and
    of medium the latest ``medium`` by then. Moderate and core fields may cite all high evidence of
    the past as well, consumed or not. ``place`` is the order of citation; an id counts once.
    """
    raw = proposals.select(*PROPOSAL, "resistance", F.posexplode("cited").alias("_at", "_raw"))
    named = raw.select(*PROPOSAL, "resistance", "_at", F.explode(scene_ids(F.col("_raw"))).alias("scene_id"))
    once = named.groupBy(*PROPOSAL, "resistance", "scene_id").agg(F.min("_at").alias("place"))
    told = evidence.filter(F.col("significance").isin("high", "medium")).withColumnRenamed("ep", "scene_ep")
    # how many active medium ones a character had up to each of them: the latest are told by the difference
    active = (F.col("status") == "active") & (F.col("significance") == "medium")
    so_far = Window.partitionBy("dataset", "character").orderBy("scene_ep", "scene_id").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("_nth", F.count_if(active).over(so_far))
    cited = once.join(told, ["dataset", "character", "scene_id"]).filter(F.col("scene_ep") <= F.col("ep"))
    upto = told.groupBy("dataset", "character", "scene_ep").agg(F.max("_nth").alias("_n"))
    asked = proposals.select("dataset", "character", "ep").distinct()
    both = asked.withColumn("scene_ep", F.col("ep")).unionByName(upto, allowMissingColumns=True)
    seen = Window.partitionBy("dataset", "character").orderBy("scene_ep").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_seen", F.coalesce(F.max("_n").over(seen), F.lit(0))).filter(F.col("ep").isNotNull()).select("dataset", "character", "ep", "_seen")
    cited = cited.join(both, ["dataset", "character", "ep"])
    lately = active & (F.col("_nth") > F.col("_seen") - medium)
    high = (F.col("significance") == "high") & ((F.col("status") == "active") | F.col("resistance").isin("moderate", "core"))
    return cited.filter(lately | high).select(*PROPOSAL, "scene_id", "scene_ep", "significance", "place")


def decided(proposals: DataFrame, evidence: DataFrame, gates: dict[str, tuple[int, int, int]] = GATES, stop_words: list[str] | None = None) -> DataFrame:
    """``PROPOSAL, field, decision, ids``: the first reason to reject, or ``accepted``, and the ids that count.

    In order: ``no_evidence`` (nothing cited may be cited), ``no_field``, ``few_episodes`` and ``few_high``
    (low fields: one high or two medium, else ``few_events``), ``cooldown``, ``empty``, ``too_short`` and
    ``forgets`` (unless it replaces), ``no_change``. A merge without a type is incremental.
    """
    counted = citable(proposals, evidence).groupBy(*PROPOSAL).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "scene_id"))), lambda s: s["scene_id"]).alias("ids"), F.countDistinct("scene_ep").alias("episodes"),
        F.count_if(F.col("significance") == "high").alias("high"), F.count_if(F.col("significance") == "medium").alias("medium"),
    )
    p = proposals.join(counted, PROPOSAL, "left")
    r = F.when(F.col("resistance").isin(list(gates)), F.col("resistance")).otherwise("low")
    bound = lambda i: F.coalesce(*(F.when(r == name, g[i]) for name, g in gates.items()))
    new, old = F.coalesce("new_value", F.lit("")), F.coalesce("old_value", F.lit(""))
    merges = (F.coalesce("merge_type", F.lit("incremental")) != "replacement") & (old != "")
    recall = word_recall(old, new, sorted(STOP_WORDS) if stop_words is None else stop_words)
    decision = (
        F.when(F.col("ids").isNull(), "no_evidence")
        .when(F.col("resistance").isNull(), "no_field")
        .when((r == "low") & (F.col("high") < 1) & (F.col("medium") < 2), "few_events")
        .when((r != "low") & (F.col("episodes") < bound(0)), "few_episodes")
        .when((r != "low") & (F.col("high") < bound(1)), "few_high")
        .when(F.col("updated_at").isNotNull() & (F.col("ep") - F.col("updated_at") < bound(2)), "cooldown")
        .when(F.trim(new) == "", "empty")
        .when(merges & (F.length(new) < KEPT_LENGTH * F.length(old)), "too_short")
        .when(merges & (recall < KEPT_WORDS), "forgets")
        .when(F.trim(new) == F.trim(old), "no_change")
        .otherwise("accepted")
    )
    return p.select(*PROPOSAL, "field", decision.alias("decision"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
