"""Readers of files whose layout or payload varies, by glob, by fallback and by method."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SESSION = "struct<session_id string, episode string, significance string, summary string>"


def _text_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``path, body``: whole files; an empty table where nothing is there."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, body string")
        raise


def _rows(body: Column, item: str, wrappers: list[str]) -> Column:
    """The rows of a JSON body: a list, a list under one of the wrapper keys, or the values of a map of rows or of lists."""
    kept = {"mode": "PERMISSIVE"}
    as_list = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{item}>", kept))
    wrapped = [F.from_json(F.get_json_object(body, f"$.{w}"), f"array<{item}>", kept) for w in wrappers]
    of_lists = F.flatten(F.map_values(F.from_json(body, f"map<string, array<{item}>>", kept)))
    of_rows = F.map_values(F.from_json(body, f"map<string, {item}>", kept))
    first = F.coalesce(as_list, *wrapped, F.when(F.size(F.filter(of_lists, lambda x: x.isNotNull())) > 0, of_lists), of_rows)
    return F.filter(first, lambda x: x.isNotNull())


def session_archives(spark: SparkSession, path: str, glob: str = "*_session_archive.json") -> DataFrame:
    """``character, session_id, episode, significance, summary`` of all archives.

    A file holds a list, ``{"sessions": [...]}``, ``{"archive": [...]}`` or a map of lists by
    character; the character is the file's name before the ending.
    """
    ending = glob.lstrip("*").replace(".", r"\.")
    files = _text_files(spark, path, glob)
    name = F.regexp_extract(F.url_decode("path"), rf"([^/]+){ending}$", 1)
    return files.select(name.alias("character"), F.explode(_rows(F.col("body"), SESSION, ["sessions", "archive"])).alias("s")).select("character", "s.*")


def optional_log(spark: SparkSession, path: str, item: str, wrappers: list[str]) -> DataFrame:
    """Rows of a log that may be missing (then none), a list, or wrapped in one of the keys."""
    return _text_files(spark, path).select(F.explode(_rows(F.col("body"), item, wrappers)).alias("r")).select("r.*")


def ratings(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Ratings as a list, under ``ratings`` or ``items``, or as the values of a map."""
    return optional_log(spark, path, item, ["ratings", "items"])


def split_or_flat_scores(spark: SparkSession, root: str, splits: list[str], file_name: str, schema: str) -> DataFrame:
    """Scores of ``root/<split>/<file>`` with their split; if no split has the file, of ``root/<file>`` with split ``all``."""
    found = None
    for split in splits:
        try:
            part = spark.read.schema(schema).json(f"{root}/{split}/{file_name}").withColumn("split", F.lit(split))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is not None:
        return found
    try:
        return spark.read.schema(schema).json(f"{root}/{file_name}").withColumn("split", F.lit("all"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, split string")


def local_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A data set by its ending: Parquet, JSON lines, CSV, or a JSON document; a folder is read as Parquet."""
    kind = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
    ending = kind[2].lower() if kind[0] else ""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ending in ("jsonl", "ndjson"):
        return reader.json(path)
    if ending == "json":
        return reader.option("multiLine", True).json(path)
    if ending == "csv":
        return reader.option("header", True).csv(path)
    if ending in ("parquet", ""):
        return reader.parquet(path)
    raise ValueError(f"no reader for .{ending} files")


def profile_texts(spark: SparkSession, root: str, method: str, split: str, sources: dict[str, tuple[str, str] | None]) -> DataFrame:
    """``key, profile_text`` of a method: ``sources`` names its file (with ``{split}``) and text field; None: it uses no profile."""
    if method not in sources:
        raise ValueError(f"unknown method {method!r}")
    source = sources[method]
    if source is None:
        return spark.createDataFrame([], "key string, profile_text string")
    file_name, field = source
    body = _text_files(spark, f"{root}/{file_name.format(split=split)}").select(F.explode(F.from_json("body", "map<string, string>")).alias("key", "value"))
    text = F.when(F.ltrim("value").startswith("{"), F.get_json_object("value", f"$.{field}")).otherwise(F.col("value"))
    return body.select("key", text.alias("profile_text")).filter("profile_text is not null")


def earlier_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report's summary as one row; none where it is missing or can't be read."""
    parsed = _text_files(spark, path).select(F.from_json("body", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("s"))
    return parsed.filter("s._bad is null").select("s.*").drop("_bad")


def task_registry(spark: SparkSession, path: str) -> DataFrame:
    """Flat task files (``key: value`` lines) as ``task_name, settings``, sorted by name."""
    files = _text_files(spark, path, "*.yaml")
    name = F.regexp_extract("path", r"([^/]+)\.yaml$", 1)
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""), F.lit(" \"'"))))
    return files.select(name.alias("task_name"), F.map_from_entries(pairs).alias("settings")).orderBy("task_name")


def cached(spark: SparkSession, path: str, key: str, build) -> DataFrame:
    """The table under ``path`` if it was made for ``key`` (a fingerprint of its inputs), else ``build()`` written there anew.

    Each key has a folder of its own, so a reader of an older one isn't disturbed.
    """
    place = f"{path}/{key}"
    try:
        return spark.read.parquet(place)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def backed_up_path(path: str, stamp: str) -> str:
    """Where the version of a snapshot of that time goes; the current one isn't overwritten."""
    return f"{path.rstrip('/')}.{stamp}"


def checkpointed_write(rows: DataFrame, path: str, key: str, parts: int) -> None:
    """Write rows in ``parts`` commits by hash of the key; parts that are there already are left alone.

    A run that stops goes on with the first missing part.
    """
    spark = rows.sparkSession
    for part in range(parts):
        place = f"{path}/part={part}"
        try:
            spark.read.text(f"{place}/_SUCCESS")
            continue
        except AnalysisException:
            pass
        rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part).write.mode("overwrite").parquet(place)


def json_report(rows: DataFrame, path: str) -> str:
    """A small aggregate as pretty JSON text, written as one text file."""
    body = json.dumps([r.asDict(recursive=True) for r in rows.collect()], indent=2, ensure_ascii=False, default=str)
    rows.sparkSession.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return body
