"""What an adapter is, what it writes, and how it is made from a resource."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AdapterError, PermissionDeniedError, RegistryError
from ..functions.frames import col, hide, is_number, is_time, ordered
from ..quality.contracts import DataframeContract
from ..registry import ADAPTERS


class LoadMode(StrEnum):
    """How a frame goes into a collection."""

    REPLACE = "replace"
    APPEND = "append"
    UPSERT = "upsert"
    SCD2 = "scd2"
    DELETE = "delete"


@dataclass
class LoadResult:
    """What a write did."""

    collection: str
    mode: str
    rows_in: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    created_table: bool = False


@dataclass
class WriteRequest:
    """A frame and how it goes into a collection."""

    frame: DataFrame
    collection: str | None
    mode: LoadMode = LoadMode.REPLACE
    key: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    scd: Any = None  # the blueprint's scd section
    as_of: Any = None
    chunksize: int | None = 10_000
    contract: DataframeContract | None = None

    def __post_init__(self) -> None:
        self.mode, self.key = LoadMode(self.mode), [self.key] if isinstance(self.key, str) else list(self.key or [])
        self.frame = hide(self.frame)
        if self.mode in (LoadMode.UPSERT, LoadMode.SCD2, LoadMode.DELETE):
            missing = [k for k in self.key if k not in self.frame.columns]
            if not self.key or missing:
                raise AdapterError(f"mode {self.mode} needs keys of the frame" + f"; {', '.join(missing)} aren't there" * bool(missing))
        if self.mode is LoadMode.SCD2:
            lost = [c for c in (self.scd.track if self.scd else ["(no scd block)"]) if c not in self.frame.columns]
            if lost:
                raise AdapterError(f"scd2: columns to track aren't there: {', '.join(lost)}")
        lost = [c for c in self.partition_by if c not in self.frame.columns]
        if lost:
            raise AdapterError(f"partition columns aren't there: {', '.join(lost)}")

    def effective(self) -> datetime:
        """When new versions begin: the partition's value, else today."""
        if isinstance(self.as_of, datetime):
            return self.as_of
        if isinstance(self.as_of, date):
            return datetime(self.as_of.year, self.as_of.month, self.as_of.day)
        if self.as_of:
            return datetime.fromisoformat(str(self.as_of))
        return datetime.combine(date.today(), datetime.min.time())


def newer_than(df: DataFrame, since: tuple[str, Any] | None) -> DataFrame:
    """Rows with cursor > value; a frame without the cursor is given whole. Spark pushes it down."""
    if since is None or since[1] is None or since[0] not in df.columns:
        return df
    cursor, value = since
    kind = df.schema[cursor].dataType
    if is_time(kind):
        value = F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)).cast(kind)
    elif is_number(kind):
        value = F.lit(float(value) if "." in str(value) or "e" in str(value).lower() else int(value))
    else:
        value = F.lit(value.isoformat() if isinstance(value, date) else str(value))
        return df.where(col(cursor).cast("string") > value)
    return df.where(col(cursor) > value)


class Adapter:
    """A provisioned resource: the blueprint's section of it."""

    def __init__(self, resource: Any, spark: SparkSession | None = None):
        self.resource, self.params = resource, resource.params
        self.name = resource.name
        self.spark = spark or SparkSession.builder.getOrCreate()

    def _permit(self, what: str) -> None:
        if what not in self.resource.allow:
            raise PermissionDeniedError(f"resource {self.name!r} doesn't allow to {what}")

    def read(self, collection: str | None = None, since: tuple[str, Any] | None = None, numbered: bool = False) -> DataFrame:
        """``numbered``: with the hidden ordinal of each row."""
        self._permit("read")
        frame = self._read(collection, since)
        return self._numbered(frame) if numbered else frame

    def _numbered(self, frame: DataFrame) -> DataFrame:
        return ordered(frame)

    def write(self, frame: DataFrame, collection: str | None = None, **how: Any) -> LoadResult:
        return self.write_batch([WriteRequest(frame, collection, **how)])[0]

    def write_batch(self, requests: Sequence[WriteRequest]) -> list[LoadResult]:
        """Writes all or, where the sink allows it, none."""
        self._permit("write")
        return self._write_batch(requests)

    def write_once(self, requests: Sequence[WriteRequest], stream: str, batch: int) -> list[LoadResult]:
        """Writes a batch of a stream. Here a batch that is tried again is written again; keyed modes
        then change nothing."""
        return self.write_batch(requests)

    def has_table(self, collection: str) -> bool:
        raise NotImplementedError

    def _read(self, collection: str | None, since: tuple[str, Any] | None) -> DataFrame:
        raise NotImplementedError

    def _write_batch(self, requests: Sequence[WriteRequest]) -> list[LoadResult]:
        raise NotImplementedError

    def dispose(self) -> None:
        pass


def create_adapter(resource: Any, spark: SparkSession | None = None, name: str | None = None) -> Adapter:
    """The adapter of a resource; ``name`` is that of its section."""
    if name is not None:
        resource = resource.model_copy(update={"name": name})
    try:
        kind = ADAPTERS.get(resource.adapter)
    except RegistryError as e:
        raise AdapterError(str(e)) from None
    return kind(resource, spark)


_DDL = {"integer": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.TimestampNTZType(), "category": T.StringType()}


def declared_types(frame: DataFrame, contract: DataframeContract | None) -> DataFrame:
    """The frame with columns in the types that a contract declares."""
    from ..quality.contracts import _SAME

    for name, rule in contract.columns.items() if contract else ():
        kind = _DDL.get(_SAME.get(rule.dtype or "", rule.dtype or ""))
        if name in frame.columns and kind is not None and frame.schema[name].dataType != kind and not (isinstance(kind, T.DoubleType) and is_number(frame.schema[name].dataType)) and not (is_time(kind) and is_time(frame.schema[name].dataType)):
            frame = frame.withColumn(name, col(name).cast(kind))
    return frame
