"""Functions of every string in a nested value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def map_strings(value: Column, kind: DataType, change: Callable[[Column], Column]) -> Column:
    """``value`` with ``change`` applied to each string inside, whatever the nesting; keys of maps and all else stay.

    The expression follows the type, so nothing leaves the JVM. Nulls stay null at every depth.
    """
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), change(value))
    if isinstance(kind, ArrayType) and has_strings(kind.elementType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, change))
    if isinstance(kind, MapType) and has_strings(kind.valueType):
        return F.transform_values(value, lambda _, x: map_strings(x, kind.valueType, change))
    if isinstance(kind, StructType) and has_strings(kind):
        return F.when(value.isNotNull(), F.struct(*(map_strings(value[f.name], f.dataType, change).alias(f.name) for f in kind)))
    return value


def has_strings(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return has_strings(kind.elementType)
    if isinstance(kind, MapType):
        return has_strings(kind.valueType)
    if isinstance(kind, StructType):
        return any(has_strings(f.dataType) for f in kind)
    return isinstance(kind, StringType)


def with_strings(rows: DataFrame, column: str, change: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with the strings inside one column changed."""
    return rows.withColumn(column, map_strings(F.col(column), rows.schema[column].dataType, change))
