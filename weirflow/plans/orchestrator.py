"""Runs a blueprint's tasks in order, as many at once as it allows."""

from __future__ import annotations

import logging
import time
import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from datetime import datetime

from pyspark.sql import SparkSession

from ..config import PipelineConfig
from ..durations import parse_duration
from ..errors import TransformError, WeirflowError
from ..notify import Notifier
from ..secret_providers import RedactingFilter
from ..sources import create_adapter
from . import dag
from .checkpoint import CheckpointStore
from .context import ExecutionContext
from .runner import run_extract, run_load, run_transform, with_retry
from .watermark import WatermarkStore

log = logging.getLogger("weirflow")


class Orchestrator:
    """A run of a pipeline."""

    def __init__(self, config: PipelineConfig, spark: SparkSession | None = None):
        self.config, self.spark = config, spark
        self.pipeline = str(config.metadata.get("id", "pipeline"))
        self.readers = dag.consumers(config)

    def order(self) -> list[str]:
        return dag.order(self.config)

    def _context(self) -> ExecutionContext:
        config, spark = self.config, self.spark or SparkSession.builder.getOrCreate()
        o = config.orchestration
        ctx = ExecutionContext(config=config, spark=spark, pipeline=self.pipeline, params=dict(config.params), secret_values=set(config.secrets), run_id=uuid.uuid4().hex[:12])
        used = {t.resource for t in config.tasks.values() if hasattr(t, "resource")} | ({o.watermark_store.resource} if o.watermark_store else set())
        ctx.adapters = {name: create_adapter(config.resources[name], spark, name) for name in sorted(used)}
        if o.watermark_store:
            ctx.watermark_store = WatermarkStore(ctx.adapters[o.watermark_store.resource], o.watermark_store.table)
        if o.checkpoint.enabled and o.checkpoint.store:
            ctx.checkpoint_store = CheckpointStore(spark, o.checkpoint.store, o.checkpoint.reuse)
        ctx.notifier = Notifier(o.notifications.on_failure)
        ctx.partition_value = config.partition.bounds.start if config.partition else None
        ctx.ordered = dag.ordered_frames(config)
        return ctx

    def run(self, ctx: ExecutionContext | None = None) -> ExecutionContext:
        """Runs all tasks and returns the context with every frame. The first error is raised,
        after tasks that had begun are done; watermarks move only if there is none."""
        graph = dag.sorter(self.config)  # cycles are errors before anything is opened
        ctx = ctx or self._context()
        hide = RedactingFilter(ctx.secret_values)
        log.addFilter(hide)
        zone = ctx.spark.conf.get("spark.sql.session.timeZone")
        if "timezone" in self.config.settings.model_fields_set:
            ctx.spark.conf.set("spark.sql.session.timeZone", self.config.settings.timezone)
        began, error = time.monotonic(), None
        try:
            error = self._schedule(graph, ctx)
            if error is None:
                ctx.flush_watermarks()
        finally:
            log.removeFilter(hide)
            ctx.spark.conf.set("spark.sql.session.timeZone", zone)
            self._time_limits(time.monotonic() - began)
            for adapter in ctx.adapters.values():
                adapter.dispose()
        if error is not None:
            ctx.notifier.send("failure", f"pipeline {self.pipeline}: {error}")
            self.release(ctx)
            raise error
        return ctx

    @staticmethod
    def release(ctx: ExecutionContext) -> None:
        """Lets go of frames that the run kept."""
        for frame in ctx.persisted:
            frame.unpersist()
        ctx.persisted.clear()

    def _schedule(self, graph, ctx: ExecutionContext) -> Exception | None:
        o, first, running = self.config.orchestration, None, {}
        with ThreadPoolExecutor(o.max_parallelism, thread_name_prefix="weirflow") as pool:
            while graph.is_active():
                if first is None or not o.fail_fast:
                    for name in sorted(graph.get_ready()):
                        running[pool.submit(self._task, name, ctx)] = name
                if not running:
                    break
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for future in done:
                    name = running.pop(future)
                    try:
                        future.result()
                    except Exception as e:
                        task = self.config.tasks[name]
                        if task.on_failure != "fail":
                            log.warning("task %s failed and is passed over (%s): %s", name, task.on_failure, e)
                        else:
                            first = first or (e if isinstance(e, WeirflowError) else TransformError(f"task {name}: {e}"))
                            log.error("task %s failed: %s", name, e)
                            if o.fail_fast:
                                continue
                    graph.done(name)
                if first is not None and o.fail_fast and not running:
                    break
        return first

    def _task(self, name: str, ctx: ExecutionContext) -> None:
        task, began = self.config.tasks[name], datetime.now()
        work = {
            "extract": lambda: run_extract(name, task, ctx),
            "transform": lambda: run_transform(name, task, ctx, self.readers),
            "load": lambda: run_load(name, task, ctx),
        }
        with_retry(task.retry, f"task {name}", work[task.stage])
        log.info("task %s done in %.3g s", name, (datetime.now() - began).total_seconds())

    def _time_limits(self, seconds: float) -> None:
        sla = self.config.orchestration.sla
        if sla.max_runtime and seconds > parse_duration(sla.max_runtime).total_seconds():
            Notifier(self.config.orchestration.notifications.on_sla).send("sla", f"pipeline {self.pipeline} took {seconds:.0f} s; its limit is {sla.max_runtime}")
        elif sla.warn_after and seconds > parse_duration(sla.warn_after).total_seconds():
            log.warning("pipeline %s took %.0f s, over %s", self.config.pipeline_id, seconds, sla.warn_after)


def run_pipeline(config: PipelineConfig, spark: SparkSession | None = None) -> ExecutionContext:
    return Orchestrator(config, spark).run()


