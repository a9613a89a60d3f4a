"""Rater and judge reports, method order, quotas, weighted draws and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.operators.dialogue import hash_order


def by_judge(scores: DataFrame, by: list[str], judge: str, value: str, default: str) -> DataFrame:
    """n and mean for each group and judge; ``primary`` marks the default judge, or a group's first judge if it has no default."""
    out = scores.groupBy(*by, judge).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"))
    first = Window.partitionBy(*by)
    chosen = F.coalesce(F.max(F.when(F.col(judge) == default, F.col(judge))).over(first), F.min(judge).over(first))
    return out.withColumn("primary", F.col(judge) == chosen)


def rater_stats(ratings: DataFrame, rater: str, score: str, label: str, labels: list[str]) -> DataFrame:
    """Mean, population variance and deviation, and the percentage of each label, for every rater."""
    share = [F.round(F.avg(F.when(F.col(label) == x, 100.0).otherwise(0.0)), 1).alias(f"pct_{x}") for x in labels]
    return ratings.groupBy(rater).agg(
        F.round(F.avg(score), 4).alias("mean_score"), F.round(F.var_pop(score), 4).alias("var_score"), F.round(F.stddev_pop(score), 4).alias("std_score"), *share
    )


def most_complete(records: DataFrame, by: str, place: str, fields: list[str]) -> DataFrame:
    """The record of each group with most filled fields, the earliest among equals; none if no field is filled."""
    filled = sum((F.when(F.lower(F.trim(c)).isin("none", "") | F.col(c).isNull(), 0).otherwise(1) for c in fields), F.lit(0))
    order = Window.partitionBy(by).orderBy(F.col("filled").desc(), place)
    return records.withColumn("filled", filled).withColumn("_r", F.row_number().over(order)).filter("_r = 1 and filled > 0").drop("_r")


def in_method_order(rows: DataFrame, method: str, canonical: list[str]) -> DataFrame:
    """``rows`` with ``place``: the canonical index of the method; others follow in order of names.

    The methods are ranked among themselves, not the rows.
    """
    index = F.nullif(F.array_position(F.array(*map(F.lit, canonical)), F.col(method)), F.lit(0))
    ranked = rows.select(method).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.coalesce(index, F.lit(len(canonical) + 1)), method)))
    return rows.join(F.broadcast(ranked) if canonical else ranked, method)


def quota_plan(methods: DataFrame, kind: str, name: str, total: int, full: int = 8, extended: int = 4) -> DataFrame:
    """A quota for each method: ``full`` or ``extended``, and what is left of ``total`` dealt in turn to full methods."""
    base = methods.withColumn("_base", F.when(F.col(kind) == "full", full).otherwise(extended))
    sums = base.agg(F.sum("_base").alias("given"), F.count_if(F.col(kind) == "full").alias("n")).first()
    spare, n = max(total - (sums["given"] or 0), 0), max(sums["n"] or 0, 1)
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(name)) - 1
    more = F.when(F.col(kind) == "full", F.lit(spare // n) + F.when(turn < spare % n, 1).otherwise(0)).otherwise(0)
    return base.withColumn("quota", (F.col("_base") + more).cast("int")).drop("_base")


def quota_sample(rows: DataFrame, quotas: DataFrame, method: str, stratum: str, item: str, total: int) -> DataFrame:
    """At most ``quota`` rows a method, dealt over its strata in turn, no item twice for a method; then filled up to ``total``.

    Rows of a stratum come in hash order, strata take turns, so a stratum that runs out leaves its
    turns to the others. If all quotas together give fewer than ``total``, the next rows in the
    same order fill up.
    """
    once = rows.withColumn("_d", F.row_number().over(Window.partitionBy(method, item).orderBy(hash_order(item), stratum))).filter("_d = 1").drop("_d")
    turn = F.row_number().over(Window.partitionBy(method, stratum).orderBy(hash_order(item), item))
    place = F.row_number().over(Window.partitionBy(method).orderBy("_turn", stratum))
    dealt = once.withColumn("_turn", turn).withColumn("place", place).drop("_turn").join(quotas.select(method, "quota"), method)
    # counts of a method at each place, not its rows, decide how far the filling goes
    chosen = dealt.filter(F.col("place") <= F.col("quota"))
    missing = total - chosen.count()
    if missing <= 0:
        return chosen.withColumn("filler", F.lit(False))
    rest = dealt.filter(F.col("place") > F.col("quota")).orderBy(F.col("place") - F.col("quota"), method).limit(missing)
    return chosen.withColumn("filler", F.lit(False)).unionByName(rest.withColumn("filler", F.lit(True)))


def drawn_with_replacement(sizes: DataFrame, name: str, n: str, weight: str, draws: int, batch: int, seed: int, cells: int = 1024) -> DataFrame:
    """``draw, batch, name, row``: data sets by weight, rows uniformly inside; an incomplete last batch isn't drawn.

    Draws are numbered rows with hashes as random numbers. Each data set owns a range of numbers as
    long as its share of the weights; ranges are dealt to ``cells``, so draws find theirs by an
    equality join, whatever the number of data sets. Data sets without rows or weight aren't drawn.
    """
    spark = sizes.sparkSession
    uniform = lambda salt: F.pmod(F.xxhash64("draw", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    some = sizes.select(F.col(name).alias("_name"), F.col(n).cast("bigint").alias("_n"), F.col(weight).cast("double").alias("_w")).filter("_n > 0 and _w > 0")
    # one row a data set: the table of ranges is small beside the draws
    upto = Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_w").over(Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = some.withColumns({"_high": F.sum("_w").over(upto) / total, "_at": F.row_number().over(Window.orderBy("_name"))})
    ranges = ranges.withColumn("_low", F.coalesce(F.lag("_high").over(Window.orderBy("_name")), F.lit(0.0)))
    ranges = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") * cells), F.least(F.floor(F.col("_high") * cells), F.lit(cells - 1)))))
    made = spark.range(draws // batch * batch).withColumnRenamed("id", "draw").withColumn("_u", uniform(1)).withColumn("_cell", F.floor(F.col("_u") * cells))
    drawn = made.join(ranges, "_cell").filter((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")))
    return drawn.select("draw", F.floor(F.col("draw") / batch).alias("batch"), F.col("_name").alias(name), F.floor(uniform(2) * F.col("_n")).alias("row"))


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order that tells all rows apart: a limit for trying things out, the same on every run."""
    return rows.orderBy(*order).limit(n)


def batches(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """Rows of each group in batches of a fixed size: ``batch`` from 0."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size))


def fullest_of_scene(samples: DataFrame, scene: str, place: str, context: str, line: Column) -> DataFrame:
    """Each scene's last sample with its own line added to its context: the whole scene."""
    last = F.max_by(F.struct(F.col(context).alias("c"), line.alias("l")), place)
    return samples.groupBy(scene).agg(last.alias("_l")).select(scene, F.concat_ws("\n", F.nullif(F.col("_l.c"), F.lit("")), "_l.l").alias("scene_text"))


def rendered_markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small report table as Markdown. For aggregates only: the rows come to the driver, in the order given."""
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in rows.select(*columns).collect():
        out.append("| " + " | ".join("-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(out) + "\n"


def rendered_latex(rows: DataFrame, columns: list[str]) -> str:
    """The same as a LaTeX tabular; signs that LaTeX reads are escaped."""
    def text(v):
        return "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("\\", r"\textbackslash ").replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")

    body = [" & ".join(text(v) for v in r) + r" \\" for r in rows.select(*columns).collect()]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", " & ".join(map(text, columns)) + r" \\ \hline", *body, r"\end{tabular}", ""])


def write_csv(rows: DataFrame, path: str) -> None:
    """A small aggregate as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
