"""Runs one task: an extract, a fold of transform steps, or a batch of loads."""

from __future__ import annotations

import logging
import re
import time
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config.format import Retry
from ..durations import parse_duration
from ..errors import TransformError, WeirflowError
from ..functions.frames import col, hide
from ..operators import build_transform
from ..operators.collection import aligned
from ..quality.contracts import check_contract, check_expectations
from ..sources.base import WriteRequest
from .checkpoint import digest
from .context import ExecutionContext
from .dag import made_by, makers, read_by
from .watermark import resolve_since

log = logging.getLogger("weirflow")


def _message(e: Exception) -> str:
    return str(e).splitlines()[0] if str(e) else type(e).__name__


def with_retry(policy: Any, what: str, run):
    """Tries again after errors of the package and of Spark; the last one is raised."""
    policy = policy or Retry()
    delay = parse_duration(policy.delay).total_seconds()
    limit = parse_duration(policy.timeout).total_seconds() if policy.timeout is not None else None
    began = time.monotonic()
    for attempt in range(1, policy.attempts + 1):
        try:
            return run()
        except (WeirflowError, PySparkException) as e:
            late = limit is not None and time.monotonic() - began > limit
            if attempt == policy.attempts or late:
                if isinstance(e, WeirflowError) and policy.attempts == 1:
                    raise
                raise TransformError(f"{what}: failed after {attempt} attempts: {_message(e)}") from e
            log.warning("%s: attempt %d failed (%s); again in %.3g s", what, attempt, _message(e), delay)
            time.sleep(delay)
            delay *= policy.backoff


def _validate(frame: DataFrame, name: str | None, mode: str, ctx: ExecutionContext) -> None:
    if name is not None and ctx.config is not None:
        check_contract(hide(frame), ctx.config.schemas[name], mode, lambda other: ctx.state.get(other, None), name)


def _keep(frame: DataFrame, ctx: ExecutionContext) -> DataFrame:
    """A frame that is read several times, kept in memory and on disk for the run."""
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    ctx.persisted.append(kept)
    return kept


# ---------------------------------------------------------------- extract
def run_extract(name: str, task: Any, ctx: ExecutionContext) -> None:
    adapter = ctx.adapters[task.resource]
    since = resolve_since(ctx.watermark_store, ctx.pipeline, name, task.incremental)
    for step in task.steps:
        frame = adapter.read(step.collection, since, numbered=step.output in ctx.ordered)
        _validate(frame, step.contract, task.validate_, ctx)
        cursor = task.incremental.cursor if task.incremental and task.incremental.strategy == "watermark" else None
        if cursor and cursor in frame.columns:
            # what is marked must be what is loaded
            frame = _keep(frame, ctx)
            mark = frame.agg(F.max(col(cursor)).alias("m")).first()["m"]
            ctx.stage_watermark(name, cursor, mark)
            # what a lost executor held is read again, and may then hold newer rows: they are the next run's
            frame = frame.where(col(cursor).isNull() if mark is None else col(cursor).isNull() | (col(cursor) <= F.lit(mark)))
        ctx.state.set(step.output, frame)
        ctx.origins[step.output] = digest("extract", adapter.resource.model_dump(), step.model_dump(), str(since), _fingerprint(frame))


def _fingerprint(frame: DataFrame) -> str:
    """What names, sizes and times of all files of a frame come to; frames without files are new each time.

    The files are listed and hashed by a Spark job, and one row comes back.
    """
    files = frame.inputFiles()
    if not files:
        return f"unknown-{time.time()}"
    plain = [re.sub(r"([\\\\{}\[\]*?])", r"\\\1", unquote(f)) for f in files]
    listed = frame.sparkSession.read.format("binaryFile").load(plain).select("path", "length", "modificationTime")
    one = F.xxhash64("path", "length", "modificationTime")
    row = listed.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum(one.cast("decimal(20,0)"))).first()
    return f"{row[0]}-{row[1]}-{row[2]}"


# ---------------------------------------------------------------- transform
def _steps(name: str, task: Any, ctx: ExecutionContext, rejects_read: bool) -> tuple[DataFrame, DataFrame | None]:
    flowing = ctx.state.get(task.input) if task.input else None
    rejected: list[DataFrame] = []
    if flowing is not None:
        _validate(flowing, task.input_contract, task.validate_, ctx)
    for k, step in enumerate(task.steps):
        where = f"task {name}, step {step.id or k + 1} ({step.action})"
        try:
            action = build_transform(step.action, step.with_)
            if flowing is None and action.tier != "collection":
                raise TransformError("no frame flows into the step: the task has no input")
            if step.on_error == "quarantine":
                if not action.supports_quarantine:
                    raise TransformError("this action can't quarantine rows")
                if rejects_read:
                    flowing = _keep(flowing, ctx)  # both outputs see one reading of it
                flowing, bad = action.apply_safe(flowing, ctx)
                rejected.append(hide(bad))
            else:
                if step.on_error == "skip":
                    action.verify(flowing, ctx)
                flowing = action.run(flowing, ctx)
        except (WeirflowError, PySparkException) as e:
            if step.on_error == "skip":
                log.warning("%s: skipped: %s", where, _message(e))
                continue
            raise (type(e) if isinstance(e, WeirflowError) else TransformError)(f"{where}: {_message(e)}") from e
    if not rejected:
        return flowing, None
    # a later step's rows may hold a column in another type already: such columns become text
    names = list(dict.fromkeys(c for f in rejected for c in f.columns))
    return flowing, reduce(lambda a, b: a.unionByName(b), aligned(rejected, names))


#: Actions that shuffle. What comes of them is kept if it is read again; other frames are read
#: anew from the scan, which then reads only the columns and rows that each reader needs.
_WIDE = frozenset({"join", "merge", "fuzzy_join", "group", "window", "sort", "dedupe", "compare_diff"})


def run_transform(name: str, task: Any, ctx: ExecutionContext, readers: dict[str, int]) -> None:
    names = made_by(task)
    store = ctx.checkpoint_store if task.checkpoint else None
    key = digest("transform", [s.model_dump() for s in task.steps], task.input, [ctx.origins.get(n, f"?{time.time()}") for n in read_by(task)])
    found = store.load(name, key, names) if store else None
    if found is None:
        frame, bad = _steps(name, task, ctx, bool(readers.get(names[-1])) and len(names) > 1)
        found = {task.output: frame}
        if len(names) > 1:
            found[names[1]] = bad
        if store:
            try:
                found = store.save(name, key, found)
            except PySparkException as e:
                raise TransformError(f"task {name}: {_message(e)}") from e
        elif any(s.action in _WIDE for s in task.steps):
            checks = bool(task.output_contract and task.validate_ != "off") + bool(task.expectations)
            if readers.get(task.output, 0) + checks > 1:
                found[task.output] = _keep(found[task.output], ctx)
    try:
        _validate(found[task.output], task.output_contract, task.validate_, ctx)
        check_expectations(hide(found[task.output]), task.expectations)
    except PySparkException as e:  # a value that a step refuses, seen when rows are read
        raise TransformError(f"task {name}: {_message(e)}") from e
    for output, frame in found.items():
        ctx.state.set(output, frame)
        ctx.origins[output] = key


# ---------------------------------------------------------------- load
def run_load(name: str, task: Any, ctx: ExecutionContext) -> None:
    adapter, requests = ctx.adapters[task.resource], []
    for step in task.steps:
        frame = ctx.state.get(step.input)
        _validate(frame, step.input_contract, task.validate_, ctx)
        contract = ctx.config.schemas.get(step.input_contract) if step.input_contract else None
        requests.append(WriteRequest(hide(frame), step.collection, step.mode, step.key or [], step.write.partition_by, step.scd, ctx.partition_value, step.write.chunksize, contract))
    try:
        results = adapter.write_batch(requests)
    except PySparkException as e:
        made = makers(ctx.config)
        inputs = ", ".join(f"{s.input} (of task {made.get(s.input)})" for s in task.steps)
        raise TransformError(f"task {name}, reading {inputs}: {_message(e)}") from e
    for r in results:
        log.info("%s: %s", name, r)
    ctx.load_results += results


