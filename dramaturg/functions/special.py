"""Tails of the t and normal distributions for small aggregated tables (Arrow functions)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or tiny)
            c = 1 + up / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, df) / 2 < p else (low, middle)
    return (low + high) / 2


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_interval(rows: DataFrame, n: str, mean: str, sem: str, level: float = 0.95, digits: int = 4) -> DataFrame:
    """Add ``low`` and ``high`` of the t interval; the mean itself below two rows."""

    @F.pandas_udf("double")
    def factor(n: pd.Series) -> pd.Series:
        return n.map(lambda k: t_quantile((1 + level) / 2, k - 1) if k > 1 else 0.0).astype(float)

    wide = rows.withColumn("_f", factor(n))
    return wide.select(
        *[F.round(c, digits).alias(c) if c in (mean, sem, "sd") else F.col(c) for c in rows.columns],
        F.round(F.col(mean) - F.col("_f") * F.col(sem), digits).alias("low"), F.round(F.col(mean) + F.col("_f") * F.col(sem), digits).alias("high"),
    )


def paired_p_value(rows: DataFrame) -> DataFrame:
    """``method, n, t, z`` to p values; null below two (t) or five (Wilcoxon) pairs."""

    @F.pandas_udf("double")
    def by_t(n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, k - 1) if k > 1 and not pd.isna(x) else None for k, x in zip(n, t, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def by_z(n: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([normal_two_sided(x) if k >= 5 and not pd.isna(x) else None for k, x in zip(n, z, strict=True)], dtype="float64")

    p = rows.select("method", "n", F.round(by_t("n", "t"), 6).alias("p_t"), F.round(by_z("n", "z"), 6).alias("p_wilcoxon"))
    return p.withColumn("significant", F.coalesce(F.col("p_wilcoxon") < 0.05, F.lit(False)))
