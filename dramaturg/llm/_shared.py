"""Helpers shared by the training-data operators: cutting lineage, reading tables, slicing batches."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dramaturg.sources.scratch import scratch_dir as shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back."""
    place = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later result depends on."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, in upper or lower case, which an operator will add."""
    own = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in own]) if own & {c.lower() for c in df.columns} else df


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches to Python hold at most ``most`` bytes (a larger row is alone) from now on.

    A worker keeps several forms of a batch at a time, and two workers share an executor's memory
    with its JVM. A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > most or now <= 0:
        spark.conf.set(key, str(most))


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside drop their shuffle files as each of them ends, not when driver garbage goes.

    For operators of many jobs, each of which ends in a table of its own.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_residue(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def sub_batches(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a run of rows into consecutive ranges of about ``limit`` bytes; a larger row is alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def extended(df: DataFrame, fields: str) -> StructType:
    """The schema of ``df`` with the columns ``fields`` (DDL) at its end."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def with_computed(df: DataFrame, column: str, fields: str, compute) -> DataFrame:
    """``df`` with the columns ``fields`` (DDL) that ``compute`` makes of one column's values.

    ``compute`` gets a list of Python values and returns one list or array per field. Rows pass
    through in Arrow batches, so that other columns keep their types and nulls. Columns of ``df``
    with the names of the new ones are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    extra = StructType.fromDDL(fields)
    df = replaced(df, *extra.names)
    at = df.columns.index(column)
    arrow = to_arrow_schema(extra)

    def run(batches):
        for batch in batches:
            made = compute(batch.column(at).to_pylist())
            arrays = [pa.array(v, type=f.type, from_pandas=False) for v, f in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))
