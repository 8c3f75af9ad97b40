"""High-water marks in a control table: (pipeline, task, cursor) -> value with its type."""

from __future__ import annotations

import logging
from datetime import date, datetime
from typing import Any

from pyspark.sql import functions as F

from ..durations import parse_duration
from ..sources.base import Adapter, LoadMode, WriteRequest

log = logging.getLogger("weirflow")


def _encode(value: Any) -> tuple[str, str]:
    if isinstance(value, bool) or value is None:
        return str(value), "string"
    if isinstance(value, int):
        return str(value), "integer"
    if isinstance(value, float):
        return repr(value), "float"
    if isinstance(value, datetime):
        return value.isoformat(sep=" "), "datetime"
    if isinstance(value, date):
        return value.isoformat(), "date"
    return str(value), "string"


_DECODE = {"integer": int, "float": float, "datetime": datetime.fromisoformat, "date": date.fromisoformat, "string": str}


class WatermarkStore:
    """Marks in a table of any adapter that can upsert."""

    def __init__(self, adapter: Adapter, table: str):
        self.adapter, self.table = adapter, table

    def get(self, pipeline: str, task: str, cursor: str) -> Any:
        """The mark, or None: where the table isn't there or can't be read the extract starts cold."""
        try:
            if not self.adapter.has_table(self.table):
                return None
            row = self.adapter._read(self.table, None).where((F.col("pipeline") == pipeline) & (F.col("task") == task) & (F.col("cursor_name") == cursor)).first()
        except Exception:
            log.warning("the watermark of %s can't be read: a cold start", task, exc_info=True)
            return None
        return _DECODE.get(row["kind"], str)(row["value"]) if row else None

    def set(self, pipeline: str, task: str, cursor: str, value: Any) -> None:
        text, kind = _encode(value)
        frame = self.adapter.spark.createDataFrame([(pipeline, task, cursor, text, kind)], "pipeline string, task string, cursor_name string, value string, kind string")
        self.adapter.write_batch([WriteRequest(frame, self.table, LoadMode.UPSERT, ["pipeline", "task", "cursor_name"])])


def minus(value: Any, lookback: str | None) -> Any:
    """The mark less the lookback, where it is a time; others stay."""
    if not lookback or value is None:
        return value
    span = parse_duration(lookback)
    if isinstance(value, datetime | date):
        return value - span
    if isinstance(value, str):
        try:
            moment = datetime.fromisoformat(value)
        except ValueError:
            return value
        back = moment - span
        return back.date().isoformat() if len(value) <= 10 and back.time() == datetime.min.time() else back.isoformat(sep="T" if "T" in value else " ")
    return value


def resolve_since(store: WatermarkStore | None, pipeline: str, task: str, incremental) -> tuple[str, Any] | None:
    """Where an incremental extract begins: the mark less the lookback, else ``initial``."""
    if incremental is None or incremental.strategy == "full":
        return None
    if incremental.strategy == "cdc":
        log.warning("task %s: change capture isn't supported by this source; it is read in full", task)
        return None
    mark = store.get(pipeline, task, incremental.cursor) if store else None
    if mark is None:
        return (incremental.cursor, incremental.initial) if incremental.initial is not None else None
    return incremental.cursor, minus(mark, incremental.lookback)


