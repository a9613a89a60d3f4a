"""Readers and writers of document, line and partitioned files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: an array of rows or one row a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, missing_ok: bool = True) -> DataFrame:
    """JSON lines; ``strict`` fails on a bad line, else bad lines are skipped. A missing path is empty."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    try:
        return spark.read.schema(schema).option("mode", mode).json(path)
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that a tolerant read skips."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).filter(F.trim("value") != "").select(parsed["_bad"].alias("line")).filter("line is not null")


def keyed_last(rows: DataFrame, key: str) -> DataFrame:
    """Tolerant keyed load: rows without a key go, the last row of a key by file and place wins."""
    rows = rows.filter(F.col(key).isNotNull()).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "_at")]), "_at").alias("_r")).select(key, "_r.*")


def session_map(spark: SparkSession, path: str, book: int) -> DataFrame:
    """Sessions of one book from a map of sessions: ``session_id, position, dialogue``."""
    kind = "map<string, struct<position string, dialogue array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("session_id", "s"))
    return whole.select("session_id", "s.position", "s.dialogue").filter(F.col("position").startswith(f"Book{book}-"))


def season_files(spark: SparkSession, root: str, seasons: list[int]) -> DataFrame:
    """Scenes of the asked seasons, one file each, as ``season, scene_id, turn, speakers, transcript``."""
    kind = "episodes array<struct<episode_id string, scenes array<struct<scene_id string, utterances array<struct<speakers array<string>, transcript string>>>>>>"
    files = json_documents(spark, [f"{root}/season_{n:02d}.json" for n in seasons], kind).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("int").alias("season"), F.explode("episodes").alias("e")
    )
    scenes = files.select("season", "e.episode_id", F.explode("e.scenes").alias("s"))
    return scenes.select("season", "episode_id", "s.scene_id", F.posexplode("s.utterances").alias("turn", "u")).select(
        "season", "episode_id", "scene_id", "turn", "u.speakers", "u.transcript"
    )


def discovered(spark: SparkSession, root: str, file_glob: str = "*.jsonl") -> DataFrame:
    """``track, method, split, files, newest`` of score files under track=/method=/split= folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", file_glob).option("recursiveFileLookup", "false").load(root).select("track", "method", "split", "modificationTime", "length")
    return files.filter("length > 0 and method not like '\\_%'").groupBy("track", "method", "split").agg(F.count(F.lit(1)).alias("files"), F.max("modificationTime").alias("newest"))


def stale(found: DataFrame, summaries: DataFrame) -> DataFrame:
    """Methods without a summary or with score files newer than it (``method, summarised_at``)."""
    newest = found.groupBy("method").agg(F.max("newest").alias("newest"))
    return newest.join(summaries, "method", "left").filter("summarised_at is null or newest > summarised_at").select("method", "newest")


def write_splits(rows: DataFrame, path: str, split: str = "split", kind: str = "json") -> None:
    """One folder a split; columns that begin with ``_`` are private and not written."""
    public = [c for c in rows.columns if not c.startswith("_")]
    rows.select(public).write.mode("overwrite").partitionBy(split).format(kind).save(path)


def merge_splits(rows: DataFrame, key: str, split: str, priority: list[str]) -> DataFrame:
    """Union of splits; of a key that several have, the split latest in ``priority`` wins."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(split))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), rank).alias("_r")).select(key, "_r.*")
