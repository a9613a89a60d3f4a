"""Corrections of relationship states against evidence, and assertions on inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lost_roles(before: DataFrame, after: DataFrame, breakups: DataFrame, always: list[str]) -> DataFrame:
    """Entries ``owner, name, role`` that a new state dropped and that have to come back.

    Roles in ``always`` come back whatever happened, others unless a breakup of the pair is on record.
    """
    gone = before.join(after.select("owner", "name"), ["owner", "name"], "left_anti")
    broken = breakups.select("owner", "name", F.lit(True).alias("_broken")).distinct()
    return gone.join(broken, ["owner", "name"], "left").filter(F.col("role").isin(always) | F.col("_broken").isNull()).drop("_broken")


def uncorroborated(claims: DataFrame, band: int = 0) -> DataFrame:
    """Claims ``owner, name, ep`` between main characters that the other side never makes near that time."""
    from dramaturg.operators.state import within_band

    other = claims.select(F.col("name").alias("owner"), F.col("owner").alias("name"), "ep").withColumn("pair", F.struct("owner", "name"))
    mine = claims.withColumn("pair", F.struct("owner", "name"))
    return mine.join(within_band(other.select("pair", "ep"), mine, "pair", "ep", band).select("owner", "name", "ep"), ["owner", "name", "ep"], "left_anti").drop("pair")


def borrowed_partners(votes: DataFrame) -> DataFrame:
    """For each partner, the owner with most votes; owners with fewer have borrowed the partner (``owner, partner, n``)."""
    top = Window.partitionBy("partner").orderBy(F.desc("n"), "owner")
    return votes.withColumn("true_owner", F.first("owner").over(top)).filter(F.col("owner") != F.col("true_owner"))


def audited(proposals: DataFrame, every: int = 24, cooldown: int = 2, least_cited: int = 2, longest: int = 80) -> DataFrame:
    """Core audits: of each character's checkpoint at most one valid change, and a pause between changes.

    ``character, checkpoint, field, new_value, cited``. Adds ``decision``. Characters' checkpoints
    are numbered, so a pause of ``cooldown`` means that many checkpoints without a change between.
    """
    valid = (F.col("cited") >= least_cited) & (F.length("new_value") <= longest) & (F.trim("new_value") != "")
    first = F.row_number().over(Window.partitionBy("character", "checkpoint").orderBy(F.when(valid, 0).otherwise(1), F.desc("cited"), "field"))
    ranked = proposals.withColumn("_valid", valid).withColumn("_first", first)
    before = F.max(F.when(F.col("_valid") & (F.col("_first") == 1), F.col("checkpoint"))).over(
        Window.partitionBy("character").orderBy("checkpoint").rangeBetween(Window.unboundedPreceding, -1)
    )
    decision = (
        F.when(~F.col("_valid"), "invalid").when(F.col("_first") > 1, "second").when(F.col("checkpoint") - before <= cooldown, "cooldown").otherwise("applied")
    )
    return ranked.withColumn("decision", decision).drop("_valid", "_first")


def forwarded(snapshots: DataFrame, by: str, time: str, value: str, at: int, new: str) -> DataFrame:
    """``value`` set to ``new`` from time ``at`` on, until a snapshot differs from the one at ``at``."""
    w = Window.partitionBy(by)
    base = F.max(F.when(F.col(time) == at, F.col(value))).over(w)
    diverged = F.min(F.when((F.col(time) > at) & ~F.col(value).eqNullSafe(base), F.col(time))).over(w)
    reach = (F.col(time) >= at) & (diverged.isNull() | (F.col(time) < diverged)) & base.isNotNull()
    return snapshots.withColumn("forwarded", F.when(reach, new).otherwise(F.col(value)))


def rater_mismatch(raters: dict[str, DataFrame], key: str) -> DataFrame:
    """Items that not all raters have, with who has them; empty if all is well."""
    every = None
    for name, rows in raters.items():
        one = rows.select(key, F.lit(name).alias("rater")).distinct()
        every = one if every is None else every.unionAll(one)
    return every.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("rater")), ",").alias("raters"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < len(raters)).drop("_n")


def best_checkpoint(metrics: DataFrame, by: str, step: str, loss: str, patience: int) -> DataFrame:
    """The best step before ``patience`` steps without a better one have passed."""
    order = Window.partitionBy(by).orderBy(step)
    best = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, 0))
    better = F.when(F.col(loss) == best, F.row_number().over(order))
    since = F.row_number().over(order) - F.max(better).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = metrics.withColumn("_since", since).withColumn("_stopped", F.max("_since").over(order.rowsBetween(Window.unboundedPreceding, 0)) >= patience)
    return marked.filter(~F.col("_stopped")).groupBy(by).agg(F.min_by(step, F.struct(loss, step)).alias("best_step"), F.min(loss).alias("best_loss"))
