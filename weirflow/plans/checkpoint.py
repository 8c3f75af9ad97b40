"""Outputs of transform tasks kept as Parquet, by what they were made from."""

from __future__ import annotations

import hashlib
import json
import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("weirflow")


def digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


class CheckpointStore:
    """Frames under ``store``/task/key. The key covers the steps and the origins of all inputs, so
    an edited task or another input is made anew."""

    def __init__(self, spark: SparkSession, store: str, reuse: bool = True):
        self.spark, self.store, self.reuse = spark, store.rstrip("/"), reuse

    def _path(self, task: str, key: str, name: str) -> str:
        return f"{self.store}/{task}/{key}/{name}"

    def load(self, task: str, key: str, names: list[str]) -> dict[str, DataFrame] | None:
        if not self.reuse:
            return None
        jvm, out = self.spark._jvm, {}
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self._path(task, key, name) + "/_SUCCESS")
            if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                return None
            out[name] = self.spark.read.parquet(self._path(task, key, name))
        log.info("task %s: its checkpoint is used", task)
        return out

    def save(self, task: str, key: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(self._path(task, key, name))
        return {name: self.spark.read.parquet(self._path(task, key, name)) for name in frames}
