"""Columns of frames, their types, and the hidden row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError

#: Ordinal of a row in its source, where a later step depends on row order. Never written out.
ORDER = "__ord"


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORDER]


def hide(df: DataFrame) -> DataFrame:
    """The frame without its ordinal."""
    return df.drop(ORDER) if ORDER in df.columns else df


def ordered(df: DataFrame) -> DataFrame:
    """The frame with an ordinal; one that is missing follows the order of partitions."""
    return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, column: Column | str) -> T.DataType:
    if isinstance(column, str):
        return df.schema[column].dataType
    return df.select(column.alias("x")).schema["x"].dataType


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def require(df: DataFrame, names: list[str], where: str, error: type[Exception] = ExpressionError) -> None:
    missing = [n for n in names if n not in visible(df)]
    if missing:
        raise error(f"{where}: no column {', '.join(map(repr, missing))}; there are {', '.join(visible(df))}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as null: missing values are one thing from the scan on."""
    found = {f.name: F.when(~F.isnan(col(f.name)), col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.withColumns(found) if found else df
