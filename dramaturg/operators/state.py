"""Time-evolving state of characters: as-of lookups, evidence, gates, runs, decay.

Rows carry a character and an ordinal ``ep`` of narrative time; every join has the character (or
the data set) as an equality key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(samples: DataFrame, snapshots: DataFrame, key: str, time: str, value: str, default: str) -> DataFrame:
    """The latest snapshot strictly before each sample; ``default`` where there is none.

    Samples and snapshots of a key are merged in one window instead of a range join: one shuffle,
    linear in the rows.
    """
    columns = samples.columns
    both = samples.withColumns({"_s": F.lit(1), value: F.lit(None).cast(snapshots.schema[value].dataType)}).unionByName(
        snapshots.select(key, time, value, F.lit(0).alias("_s")), allowMissingColumns=True
    )
    # samples come before snapshots of their own time, so only earlier snapshots count
    seen = Window.partitionBy(key).orderBy(F.col(time), F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(value, ignorenulls=True).over(seen)
    return both.withColumn(value, F.coalesce(found, F.lit(default))).filter("_s = 1").select(*columns, value)


def backfill(rows: DataFrame, index: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill nulls of ``columns`` from an index by key."""
    named = index.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(named, key, "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def attach_evidence(updates: DataFrame, evidence: DataFrame, key: str, ids: str, evidence_id: str, text: str) -> DataFrame:
    """Cited evidence in the order of citation; ids that aren't found are marked missing."""
    cited = updates.select(key, F.posexplode(ids).alias("_at", evidence_id))
    found = cited.join(evidence.select(evidence_id, text), evidence_id, "left")
    entry = F.struct("_at", F.col(evidence_id), F.col(text), F.col(text).isNull().alias("missing"))
    return found.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("evidence"), F.count_if(F.col(text).isNull()).alias("n_missing"))


def evidence_summary(evidence: DataFrame, by: str, low: int = 1, core: int = 16, core_high: int = 6) -> DataFrame:
    """Distinct episodes, high events and which thresholds a character meets."""
    episodes, high = F.countDistinct("ep"), F.count_if(F.col("significance") == "high")
    medium = F.count_if(F.col("significance") == "medium")
    return evidence.groupBy(by).agg(
        episodes.alias("episodes"), high.alias("high"), medium.alias("medium"),
        ((high >= low) | (medium >= 2)).alias("meets_low"),
        (episodes >= 3).alias("meets_moderate"),
        ((episodes >= core) & (high >= core_high)).alias("meets_core"),
    )


def recent_evidence(evidence: DataFrame, by: str, order: list[Column], n: int = 20) -> DataFrame:
    """All high evidence and the latest ``n`` medium of each character."""
    rank = F.row_number().over(Window.partitionBy(by, "significance").orderBy(*order))
    return evidence.withColumn("_r", rank).filter((F.col("significance") == "high") | ((F.col("significance") == "medium") & (F.col("_r") <= n))).drop("_r")


def checkpoints(episodes: DataFrame, by: str, every: int = 24) -> DataFrame:
    """Every ``every``-th episode of a character and its last."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("ep"))
    last = F.max("ep").over(Window.partitionBy(by))
    return episodes.withColumns({"place": place, "_last": last}).filter((F.col("place") % every == 0) | (F.col("ep") == F.col("_last"))).drop("_last")


def evidence_status(now: Column, consumed: Column, age: int = 8) -> Column:
    """consumed, expired (medium and older than ``age``) or active; high never expires."""
    return F.when(consumed, "consumed").when((F.col("significance") == "medium") & (now - F.col("ep") > age), "expired").otherwise("active")


#: Fields by how hard they are to change; distinct episodes, high events and cooldown asked of each.
GATES = {"low": (0, 1, 2), "moderate": (3, 0, 3), "core": (16, 6, 16)}


def update_gate() -> Column:
    """The first reason to reject a proposal, or ``accepted``.

    Columns: ``resistance, episodes, high, medium, since_update, old_value, new_value, recall,
    merge_type, field_exists``. Ratios just at their bound are accepted.
    """
    r = F.col("resistance")
    bound = lambda i: F.when(r == "core", GATES["core"][i]).when(r == "moderate", GATES["moderate"][i]).otherwise(GATES["low"][i])
    enough = F.when(r == "low", (F.col("high") >= 1) | (F.col("medium") >= 2)).otherwise((F.col("episodes") >= bound(0)) & (F.col("high") >= bound(1)))
    merge = (F.col("merge_type") != "replacement") & (F.coalesce("old_value", F.lit("")) != "")
    return (
        F.when(~F.col("field_exists"), "no_field")
        .when(~enough, "threshold")
        .when(F.col("since_update") < bound(2), "cooldown")
        .when(F.trim("new_value") == "", "empty")
        .when(merge & (F.length("new_value") < 0.8 * F.length("old_value")), "too_short")
        .when(merge & (F.col("recall") < 0.5), "forgets")
        .when(F.trim("new_value") == F.trim("old_value"), "no_change")
        .otherwise("accepted")
    )


def runs(claims: DataFrame, by: list[str], index: str) -> DataFrame:
    """Consecutive indexes with the same keys as one row: ``start, stop, length`` (gaps and islands)."""
    island = F.col(index) - F.row_number().over(Window.partitionBy(*by).orderBy(index))
    return claims.withColumn("_island", island).groupBy(*by, "_island").agg(
        F.min(index).alias("start"), F.max(index).alias("stop"), F.count(F.lit(1)).alias("length")
    ).drop("_island")


def fill_gaps(timeline: DataFrame, by: str, index: str, value: str, longest: int = 8) -> DataFrame:
    """Nulls between two equal values are filled, if there are at most ``longest`` of them."""
    w = Window.partitionBy(by).orderBy(index)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(index, value))
    before, after = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    gap = after[index] - before[index] - 1
    filled = F.when((before[value] == after[value]) & (gap <= longest), before[value])
    return timeline.withColumn("filled", F.coalesce(F.col(value), filled))


def first_seen(claims: DataFrame, by: list[str], time: str) -> DataFrame:
    return claims.groupBy(*by).agg(F.min(time).alias("first_seen"))


def changes(snapshots: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Snapshots whose value differs from the one before (the first isn't a change), nulls left out."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(time))
    return snapshots.withColumn("old_value", before).filter(F.col("old_value").isNotNull() & F.col(value).isNotNull() & (F.col("old_value") != F.col(value)))


def neighbours_agree(snapshots: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Whether the rows before and after have the same value as each other."""
    w = Window.partitionBy(*by).orderBy(time)
    return snapshots.withColumn("continuous", F.coalesce(F.lag(value).over(w) == F.lead(value).over(w), F.lit(False)))


def within_band(cited: DataFrame, other: DataFrame, key: str, time: str, band: int) -> DataFrame:
    """Rows of ``other`` that lie within ``band`` of a cited time of the same key (a semi-join).

    Times are dealt to cells of the band's width and their neighbours, so the join is an equi-join.
    """
    width = band + 1
    cell = F.floor(F.col(time) / width)
    near = cited.select(key, F.col(time).alias("_t"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell")).distinct()
    here = other.withColumn("_cell", cell)
    return here.join(near, [key, "_cell"], "left_semi") if band == 0 else here.alias("o").join(
        near.alias("n"),
        (F.col(f"o.{key}") == F.col(f"n.{key}")) & (F.col("o._cell") == F.col("n._cell")) & (F.abs(F.col(f"o.{time}") - F.col("n._t")) <= band),
        "left_semi",
    ).drop("_cell")


def unreciprocated(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` without the edge ``b, a``."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return edges.join(back, ["a", "b"], "left_anti")


def aligned_tiers(edges: DataFrame) -> DataFrame:
    """A tier that both sides claim is lowered to the lower one; a tier nobody returns stays."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tier").alias("_t")).groupBy("a", "b").agg(F.max("_t").alias("_t"))
    return edges.join(back, ["a", "b"], "left").withColumn("aligned", F.least("tier", F.coalesce("_t", "tier"))).drop("_t")


def decay() -> Column:
    """Which rule turns a claim into a former one: ``listed_as_ex``, ``not_returned``, ``forgotten``, or ``keeps``.

    Columns: ``role, age, returned, since_mention, other_lists_ex, continuous, main, married``.
    """
    role = F.col("role")
    exempt = role.startswith("ex-") | role.startswith("late ") | role.startswith("former ") | F.col("continuous")
    return (
        F.when(exempt, "keeps")
        .when(F.col("other_lists_ex"), "listed_as_ex")
        .when((F.col("age") >= 10) & ~F.col("returned") & F.col("main") & ~F.col("married"), "not_returned")
        .when((~F.col("main") | ~F.col("returned")) & (F.col("since_mention") > 6) & ~F.col("married"), "forgotten")
        .otherwise("keeps")
    )


def cumulative_evidence(evidence: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """The texts up to and with each row, a line each."""
    up_to = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return evidence.withColumn("so_far", F.array_join(F.collect_list(text).over(up_to), "\n"))
