"""Folders of any file system that Spark reaches: discovery by skip rules, and overwriting that can be taken back."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession

#: Folders that hold no results, besides those that begin with "_" or ".".
SKIPPED = ("figures", "generated_loras")
LEVELS = ("dataset", "track", "main", "method", "split")


def _open(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _open(spark, path)
    return fs.exists(place)


def listed(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """``name, is_folder, bytes, modified`` (milliseconds) of what lies in a folder, by name; none if there is no folder."""
    fs, place = _open(spark, path)
    if not fs.exists(place) or not fs.getFileStatus(place).isDirectory():
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place))


def is_hidden(name: str) -> bool:
    return name.startswith(("_", ".")) or name in SKIPPED


def walked(spark: SparkSession, root: str, levels: int) -> Iterator[tuple[str, ...]]:
    """The folders ``levels`` deep below a root, without hidden and skipped ones on the way.

    Only folders are listed, on the driver: their number is that of experiments, not of rows.
    """
    if not levels:
        yield ()
        return
    for name, folder, _, _ in listed(spark, root):
        if folder and not is_hidden(name):
            for rest in walked(spark, f"{root}/{name}", levels - 1):
                yield (name, *rest)


def discovered_methods(spark: SparkSession, root: str, score_files: str = "judge_*.jsonl", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """A row for each folder of the layout ``levels`` with at least one score file that isn't empty: the levels, ``files, bytes, newest``."""
    rows = []
    for names in walked(spark, root, len(levels)):
        found = [(n, b, t) for n, folder, b, t in listed(spark, "/".join((root, *names))) if not folder and b and not is_hidden(n) and fnmatch(n, score_files)]
        if found:
            rows.append((*names, len(found), sum(b for _, b, _ in found), max(t for _, _, t in found)))
    return spark.createDataFrame(rows, ", ".join(f"{level} string" for level in levels) + ", files int, bytes bigint, newest bigint")


def _moved(spark: SparkSession, old: str, new: str) -> None:
    fs, place = _open(spark, old)
    if not fs.rename(place, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} couldn't be moved to {new}")


def _deleted(spark: SparkSession, path: str) -> None:
    fs, place = _open(spark, path)
    fs.delete(place, True)


def overwritten(rows: DataFrame, path: str, stamp: str) -> str | None:
    """Write ``rows`` as Parquet to ``path``; what was there is kept as ``path.stamp``, whose place is returned.

    The new table is written beside the old one first, so ``rows`` may be read from ``path``. Both
    moves are renames. A run that stops between is finished or taken back by :func:`recovered`,
    which is also called here first.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    recovered(spark, path)
    backup = f"{path}.{stamp}"
    if exists(spark, backup):
        raise FileExistsError(backup)
    rows.write.mode("overwrite").parquet(f"{path}.new")
    had = exists(spark, path)
    if had:
        _moved(spark, path, backup)
    _moved(spark, f"{path}.new", path)
    return backup if had else None


def recovered(spark: SparkSession, path: str) -> str:
    """Finish or take back an overwrite that stopped: ``whole`` (nothing to do), ``finished``, ``taken_back`` or ``nothing``.

    A new table that is complete takes the place of a missing one; one that isn't is deleted. If the
    old one was moved away and no new one is complete, the latest backup moves back.
    """
    path = path.rstrip("/")
    folder, _, name = path.rpartition("/")
    new = f"{path}.new"
    complete = exists(spark, f"{new}/_SUCCESS")
    if exists(spark, path):
        if exists(spark, new):
            _deleted(spark, new)
        return "whole"
    if complete:
        _moved(spark, new, path)
        return "finished"
    if exists(spark, new):
        _deleted(spark, new)
    backups = [(t, n) for n, is_folder, _, t in listed(spark, folder) if is_folder and n.startswith(f"{name}.")]
    if not backups:
        return "nothing"
    _moved(spark, f"{folder}/{max(backups)[1]}", path)
    return "taken_back"
