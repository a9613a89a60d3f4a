"""Agreement between raters and between measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.operators.evaluate import with_average_rank


def pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation; null where a side doesn't vary."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(r, 6).alias("r"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks; rows where a side is null are left out."""
    whole = rows.select(*by, x, y).dropna(subset=[x, y])
    ranked = with_average_rank(with_average_rank(whole, by, x, "_x"), by, y, "_y")
    return pearson(ranked, by, "_x", "_y").withColumnRenamed("r", "rho")


def krippendorff(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """Interval alpha: 1 - Do / De over units of at least two ratings.

    The mean squared difference of ordered pairs is twice the sample variance, so no pairs are made.
    """
    v = F.col(value).cast("double")
    units = ratings.groupBy(unit).agg(F.count(v).alias("_n"), F.var_samp(v).alias("_v"), F.avg(v).alias("_m")).filter("_n > 1")
    # the variance over all ratings, from each unit's count, mean and variance
    centre = F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")
    sizes = units.agg(F.avg(2 * F.col("_v")).alias("observed"), F.count(F.lit(1)).alias("units"), F.sum("_n").alias("_all"), centre.alias("_centre"))
    away = F.col("_m") - sizes.select("_centre").scalar()
    spread = units.select(((F.col("_n") - 1) * F.col("_v") + F.col("_n") * away * away).alias("_s")).agg(F.sum("_s").alias("_ss"))
    return sizes.withColumn("expected", 2 * F.try_divide(spread.scalar(), F.col("_all") - 1)).select("units", F.round(1 - F.try_divide("observed", "expected"), 6).alias("alpha"))


def cohen_kappa(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Kappa of two yes-or-no columns; 1 where chance agreement is total."""
    n = F.count(F.lit(1))
    yes_a, yes_b = F.count_if(F.col(a)) / n, F.count_if(F.col(b)) / n
    chance = yes_a * yes_b + (1 - yes_a) * (1 - yes_b)
    same = F.count_if(F.col(a) == F.col(b)) / n
    return rows.groupBy(*by).agg(n.alias("n"), F.round(same, 6).alias("agreement"), F.round(F.when(chance == 1, 1.0).otherwise(F.try_divide(same - chance, 1 - chance)), 6).alias("kappa"))


def fleiss_kappa(labels: DataFrame, item: str, label: str) -> DataFrame:
    """Kappa of several raters an item, all items with equally many."""
    counts = labels.groupBy(item, label).agg(F.count(F.lit(1)).alias("_c"))
    items = counts.groupBy(item).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_sq"))
    agreement = items.agg(F.avg(F.try_divide(F.col("_sq") - F.col("_n"), F.col("_n") * (F.col("_n") - 1))).alias("_p"), F.count(F.lit(1)).alias("items"), F.sum("_n").alias("_all"))
    shares = counts.groupBy(label).agg(F.sum("_c").alias("_t")).agg(F.sum(F.col("_t").cast("double") * F.col("_t")).alias("_s"))
    out = agreement.withColumn("_s", shares.scalar())
    return out.withColumn("_e", F.col("_s") / (F.col("_all").cast("double") * F.col("_all"))).select("items", F.round(F.when(F.col("_e") == 1, 1.0).otherwise(F.try_divide(F.col("_p") - F.col("_e"), 1 - F.col("_e"))), 6).alias("kappa"))


def majority(labels: DataFrame, item: str, label: str, tie: str = "partial") -> DataFrame:
    """The most frequent label of each item; ``tie`` where the first place is shared."""
    counts = labels.groupBy(item, label).agg(F.count(F.lit(1)).alias("_c"))
    top = counts.groupBy(item).agg(F.max("_c").alias("_m"))
    firsts = counts.join(top, item).filter("_c = _m").groupBy(item).agg(F.count(F.lit(1)).alias("_k"), F.min(label).alias("_l"))
    return firsts.select(item, F.when(F.col("_k") > 1, tie).otherwise(F.col("_l")).alias("consensus"))


def direction_agreement(rows: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Share of groups in which two differences have one sign."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.signum(first) == F.signum(second)).cast("double")), 6).alias("agreement")
    )
