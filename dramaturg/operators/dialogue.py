"""From conversation turns to samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.functions.text import stable_id

#: Speakers that stand for all present.
NOISE_SPEAKERS = ["#ALL#", "All", "ALL", "Everyone"]


def cumulative_context(turns: DataFrame, scene: str, index: str, speaker: str, text: str, last: int | None = None) -> DataFrame:
    """Add ``context``: the earlier non-empty turns of the scene as ``speaker: text`` lines.

    ``last`` keeps only so many turns before (the frame stays bounded for very long scenes).
    """
    start = Window.unboundedPreceding if last is None else -last
    before = Window.partitionBy(scene).orderBy(index).rowsBetween(start, -1)
    name = F.when(F.col(speaker).isin(NOISE_SPEAKERS), "Everyone").otherwise(F.col(speaker))
    line = F.when(F.trim(text) != "", F.concat(name, F.lit(": "), F.trim(text)))
    return turns.withColumn("context", F.array_join(F.collect_list(line).over(before), "\n"))


def next_utterance_samples(turns: DataFrame, speakers: list[str], least_words: int = 3, first: int = 3) -> DataFrame:
    """Samples: what a main speaker says at turn ``first`` or later, given all that was said before."""
    flat = turns.withColumn("text", F.trim(F.regexp_replace("text", r"\s*\n\s*", " ")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return (
        cumulative_context(flat, "conv_id", "turn", "role", "text")
        .filter(F.col("role").isin(speakers) & ~F.col("role").isin(NOISE_SPEAKERS) & (F.col("turn") >= first) & (words >= least_words) & (F.col("context") != ""))
        .select(stable_id("S_", F.col("conv_id"), F.col("turn")).alias("question_id"), "role", F.col("context").alias("input"), F.col("text").alias("output"))
    )


def last_target_samples(turns: DataFrame, target: str) -> DataFrame:
    """One sample a scene: the target's last turn with all before it; none if it is the first turn."""
    scene = Window.partitionBy("conv_id")
    last = F.max(F.when(F.col("role") == target, F.col("turn"))).over(scene)
    flat = turns.withColumn("text", F.trim(F.regexp_replace("text", r"\s*\n\s*", " "))).withColumn("last", last)
    return (
        cumulative_context(flat, "conv_id", "turn", "role", "text")
        .filter((F.col("turn") == F.col("last")) & (F.col("context") != ""))
        .select("conv_id", "turn", F.col("context").alias("input"), F.col("text").alias("output"))
    )


def merged_continuations(lines: DataFrame, scene: str, index: str, line: str) -> DataFrame:
    """Lines without a colon are appended to the turn before them."""
    starts = F.sum(F.when(F.instr(line, ":") > 0, 1).otherwise(0)).over(Window.partitionBy(scene).orderBy(index))
    grouped = lines.withColumn("_group", starts).groupBy(scene, "_group")
    return grouped.agg(F.min(index).alias(index), F.sort_array(F.collect_list(F.struct(index, line))).alias("_l")).select(
        scene, index, F.array_join(F.col(f"_l.{line}"), " ").alias(line)
    )


def hash_order(*columns: str) -> Column:
    """The order that stands for a seeded shuffle: MD5 of the columns' values."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary"))


def hash_share(column: str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the MD5; needs no global sort."""
    return F.conv(F.substring(hash_order(column), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split(rows: DataFrame, time: str, boundary: Column, key: str, share: float = 0.2) -> DataFrame:
    """Add ``split``: beyond ``boundary`` ood_test, else random_test for a share of keys, else train."""
    return rows.withColumn(
        "split", F.when(F.col(time) >= boundary, "ood_test").when(hash_share(key) < share, "random_test").otherwise("train")
    )


def split_overlaps(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``left_split, right_split, shared_keys`` for splits that share keys (none, if all is well)."""
    pairs = rows.select(key, split).distinct().groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    left = pairs.select(key, "s", F.posexplode("s").alias("i", "left_split"))
    return (
        left.select("left_split", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("right_split"))
        .groupBy("left_split", "right_split")
        .agg(F.count(F.lit(1)).alias("shared_keys"))
    )


def missing_from(rows: DataFrame, key: str, split: str, wanted: str) -> DataFrame:
    """Keys that have rows in some split but none in ``wanted``."""
    return rows.select(key).distinct().join(rows.filter(F.col(split) == wanted).select(key).distinct(), key, "left_anti")


def scene_fingerprint(context: Column, lines: int = 2) -> Column:
    """First hex digits of the SHA-1 of the first non-empty context lines."""
    head = F.slice(F.filter(F.transform(F.split(context, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, lines)
    return F.substring(F.sha1(F.array_join(head, "\n").cast("binary")), 1, 16)


def chat_entry(messages: Column, name: Column, reference: Column, answering: str = "assistant", others: str = "用户") -> Column:
    """``context, target`` of a chat: turns by ``answering`` are labelled with the character's name, all other turns
    with ``others``; blank turns are left out. Null if there is no context, name or target.

    ``messages`` is a list of records with ``role`` and ``text``.
    """
    told = F.filter(messages, lambda m: F.coalesce(F.trim(m["text"]), F.lit("")) != "")
    lines = F.transform(told, lambda m: F.concat(F.when(m["role"] == answering, name).otherwise(F.lit(others)), F.lit(": "), F.trim(m["text"])))
    whole = (F.size(told) > 0) & (F.trim(name) != "") & (F.trim(reference) != "")
    return F.when(whole, F.struct(F.array_join(lines, "\n").alias("context"), F.trim(reference).alias("target")))
