"""What a run knows and carries along."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import StateError
from ..notify import Notifier


class Frames(dict):
    """Frames by name. A task puts its own when it is done; that is one store into a dictionary,
    and plans can't change, so tasks on other threads need neither locks nor copies."""

    def __missing__(self, name: str) -> DataFrame:
        raise StateError(f"there is no frame {name!r}; there are {', '.join(sorted(self)) or 'none'}")

    def get(self, name: str, *otherwise: Any) -> Any:
        """The frame; without one ``otherwise`` if it is given, else an error."""
        return super().get(name, *otherwise) if otherwise else self[name]

    def set(self, name: str, frame: DataFrame) -> None:
        self[name] = frame


@dataclass
class ExecutionContext:
    """Frames, adapters, parameters and stores of a run."""

    config: Any = None
    state: Frames = field(default_factory=Frames)
    spark: SparkSession | None = None
    #: the blueprint's id, under which watermarks are kept
    pipeline: str = "pipeline"
    adapters: dict[str, Any] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    partition_value: Any = None
    secret_values: set[str] = field(default_factory=set)
    watermark_store: Any = None
    checkpoint_store: Any = None
    notifier: Notifier | None = None
    run_id: str = "run"
    #: frames whose row order a later step depends on; extracts number their rows
    ordered: set[str] = field(default_factory=set)
    load_results: list[Any] = field(default_factory=list)
    pending_watermarks: dict[tuple[str, str], Any] = field(default_factory=dict)
    persisted: list[DataFrame] = field(default_factory=list)
    #: what a frame was made from, for checkpoint keys
    origins: dict[str, str] = field(default_factory=dict)

    def stage_watermark(self, task: str, cursor: str, value: Any) -> None:
        old = self.pending_watermarks.get((task, cursor))
        if value is not None and (old is None or value > old):
            self.pending_watermarks[task, cursor] = value

    def flush_watermarks(self) -> None:
        """Stores the marks; called only when all tasks have succeeded."""
        if self.watermark_store is not None:
            for (task, cursor), value in self.pending_watermarks.items():
                self.watermark_store.set(self.pipeline, task, cursor, value)
        self.pending_watermarks.clear()
