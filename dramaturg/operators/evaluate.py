"""Scores: joins, duplicate policies, summaries, paired comparisons, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.sources.scratch import cut


def attach_left(rows: DataFrame, lookup: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """Left join with a default where nothing is found, and ``found`` to count misses by."""
    return rows.join(lookup.select(key, value, F.lit(True).alias("found")), key, "left").withColumns(
        {value: F.coalesce(value, F.lit(default)), "found": F.coalesce("found", F.lit(False))}
    )


def merge_scores(scores: DataFrame, similarities: DataFrame, key: str, column: str, zero_fill: bool) -> DataFrame:
    """Left join of similarities; a missing one counts as 0 (``zero_fill``) or stays null."""
    out = scores.join(similarities.select(key, column), key, "left")
    return out.withColumn(column, F.coalesce(column, F.lit(0.0))) if zero_fill else out


def dedupe(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with one key the first in ``order`` (pass descending columns for last-wins)."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def summary(rows: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """n, mean, standard deviation and standard error; one row has error 0."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), digits).alias("sd"),
        F.round(F.coalesce(F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))), F.lit(0.0)), digits).alias("sem"),
    )


def exact_mean(value: str, digits: int = 6) -> Column:
    """Mean of values of at most ``digits`` decimals, the same in whatever order rows come, so that equal samples have equal means."""
    return F.try_divide(F.sum(F.col(value).cast(f"decimal(18,{digits})")).cast("double"), F.count(value))


def pairs(rows: DataFrame, key: list[str], method: str, value: str, baseline: str) -> DataFrame:
    """``method, delta`` for every key that both the method and the baseline have."""
    base = rows.filter(F.col(method) == baseline).select(*key, F.col(value).alias("_base"))
    other = rows.filter(F.col(method) != baseline)
    return other.join(base, key).select(*key, method, (F.col(value) - F.col("_base")).alias("delta"))


def paired_comparison(deltas: DataFrame, method: str, digits: int = 6) -> DataFrame:
    """Mean difference, Cohen's d, t statistic and wins, ties and losses against the baseline."""
    n, mean, sd = F.count("delta"), F.avg("delta"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0))
    return deltas.groupBy(method).agg(
        n.alias("n"),
        F.round(mean, digits).alias("delta"),
        F.round(F.coalesce(F.try_divide(mean, sd), F.lit(0.0)), digits).alias("cohen_d"),
        F.round(F.try_divide(mean, sd / F.sqrt(n)), digits).alias("t"),
        F.count_if(F.col("delta") > 0).alias("wins"),
        F.count_if(F.col("delta") == 0).alias("ties"),
        F.count_if(F.col("delta") < 0).alias("losses"),
        F.round(F.count_if(F.col("delta") > 0) * 100.0 / n, 1).alias("win_pct"),
    )


def with_average_rank(rows: DataFrame, by: list[str], value: str, rank: str, ties: str | None = None) -> DataFrame:
    """``rows`` with the rank of ``value`` in its group, ties at the mean of their places (and how many tie).

    Distinct values are counted first and dealt to ranges; a range's place in its group is the sum
    of the ranges before it, so a large group is ranked by many tasks.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")).repartitionByRange(*by, value)
    # ranges are drawn anew each time a plan runs, so the dealt counts are fixed first
    dealt = cut(counts.withColumn("_p", F.spark_partition_id()))
    upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "_p").agg(F.sum("_c").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(starts, [*by, "_p"])
    ranks = placed.select(*by, value, (F.col("_start") + F.col("_before") + (F.col("_c") + 1) / 2.0).alias(rank), *([F.col("_c").alias(ties)] if ties else []))
    return rows.join(ranks, [*by, value])


def wilcoxon(deltas: DataFrame, method: str) -> DataFrame:
    """Signed-rank sums without zero differences, with the normal approximation corrected for ties."""
    nonzero = deltas.filter("delta <> 0").withColumn("_size", F.abs("delta"))
    ranked = with_average_rank(nonzero, [method], "_size", "r", "_ties")
    n = F.count(F.lit(1))
    # each of t tied rows adds (t * t - 1), so a tie group adds t^3 - t
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.sum(F.col("_ties") * F.col("_ties") - 1) / 48
    plus = F.sum(F.when(F.col("delta") > 0, F.col("r")).otherwise(0.0))
    return ranked.groupBy(method).agg(
        n.alias("n"),
        plus.alias("w_plus"),
        F.sum(F.when(F.col("delta") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"),
        F.round(F.try_divide(plus - n * (n + 1) / 4, F.sqrt(spread)), 6).alias("z"),
    )


def macro_average(rows: DataFrame, method: str, group: str, value: str) -> DataFrame:
    """Unweighted mean over groups of the groups' means."""
    means = rows.groupBy(method, group).agg(F.avg(value).alias("_m"))
    return means.groupBy(method).agg(F.count("_m").alias("groups"), F.round(F.avg("_m"), 6).alias("macro"))


def best_marks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mark the best and the second value of each group; ties share a mark, nulls get none."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last()))
    mark = F.when(F.col(value).isNull(), "").when(place == 1, "best").when(place == 2, "second").otherwise("")
    return rows.withColumn("mark", mark)


def describe(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes, median and total."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.stddev_pop(value), 4).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.percentile(value, 0.5), 4).alias("median"),
        F.sum(value).alias("total"),
    )


def merge_descriptions(stats: DataFrame, by: list[str]) -> DataFrame:
    """Several descriptions as one: means, deviations and medians weighted by n."""
    weighted = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n")), 3).alias(c)
    return stats.groupBy(*by).agg(
        F.sum("n").alias("n"), weighted("mean"), weighted("std"), weighted("median"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total")
    )


def latency(rows: DataFrame, by: str, seconds: str, count: str) -> DataFrame:
    total, n = F.sum(seconds), F.sum(count)
    return rows.groupBy(by).agg(
        F.round(total, 4).alias("total_seconds"), n.alias("samples"),
        F.round(F.try_divide(total * 1000, n), 4).alias("ms_per_sample"), F.round(F.try_divide(n, total), 4).alias("samples_per_second"),
    ).filter("samples > 0")


def table_of(rows: DataFrame, by: list[str], method: str, methods: list[str], value: str) -> DataFrame:
    """A row for each group and a column for each method; methods are named, so one pass suffices."""
    return rows.groupBy(*by).pivot(method, methods).agg(F.round(F.avg(value), 4))
