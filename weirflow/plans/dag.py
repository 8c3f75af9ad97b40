"""The graph of a blueprint: what its tasks read and make, what is wrong with it, and its order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from graphlib import CycleError, TopologicalSorter
from typing import Any

from ..errors import DependencyError, TransformError
from ..functions.pipe import is_pipe
from ..operators import build_transform

#: Keys under which a step names frames beside the flowing one.
_OPERANDS = {"join": ("left", "right"), "merge": ("left", "right"), "fuzzy_join": ("left", "right"), "compare_diff": ("source", "target", "left", "right")}
_LISTS = frozenset({"union", "concat", "append"})
_KEYED = frozenset({"upsert", "scd2", "delete"})


def made_by(task: Any) -> list[str]:
    """Frames that a task makes: the last one is that of the rejected rows, where there is one."""
    if task.stage == "extract":
        return [step.output for step in task.steps]
    if task.stage == "load":
        return []
    return [task.output, f"{task.output}__rejected"] if any(s.on_error == "quarantine" for s in task.steps) else [task.output]


def read_by(task: Any) -> list[str]:
    """Frames that a task reads."""
    if task.stage == "extract":
        return []
    if task.stage == "load":
        return [step.input for step in task.steps]
    named = [task.input] if task.input else []
    for step in task.steps:
        block = step.with_ if isinstance(step.with_, dict) else {}
        named += [block[key] for key in _OPERANDS.get(step.action, ()) if key in block]
        if step.action in _LISTS and isinstance(block.get("frames"), list):
            named += block["frames"]
    return [name for name in named if isinstance(name, str) and not is_pipe(name)]


def makers(config: Any) -> dict[str, str]:
    """The task that makes each frame."""
    return {frame: name for name, task in config.tasks.items() for frame in made_by(task)}


# ---------------------------------------------------------------- what is wrong
def _contracts(task: Any) -> Iterator[str]:
    holders = task.steps if task.stage in ("extract", "load") else [task]
    for holder in holders:
        for key in ("contract", "input_contract", "output_contract"):
            name = getattr(holder, key, None)
            if name is not None:
                yield name


def _step_problems(task: Any) -> Iterator[str]:
    if task.stage == "extract" and task.incremental and task.incremental.strategy == "watermark" and not task.incremental.cursor:
        yield "the watermark strategy needs a cursor"
    for step in task.steps:
        if task.stage == "transform" and step.action in _LISTS:
            frames = step.with_.get("frames") if isinstance(step.with_, dict) else None
            if not frames or not isinstance(frames, list):
                yield f"{step.action} needs a list of frames"
        if task.stage == "load":
            if step.mode in _KEYED and not step.key:
                yield f"mode {step.mode} needs a key"
            if (step.mode == "scd2") != (step.scd is not None):
                yield "an scd block goes with mode scd2, and only with it"
            if step.write.partition_by and step.mode != "replace":
                yield "partition_by goes with mode replace only"


def problems(config: Any) -> list[str]:
    """All that a blueprint's parts say about each other and isn't so."""
    out: list[str] = []
    times = Counter(frame for task in config.tasks.values() for frame in made_by(task))
    for frame in (f for f, n in times.items() if n > 1):
        out.append(f"frame {frame!r} is made by both " + " and ".join(repr(n) for n, t in config.tasks.items() if frame in made_by(t)))
    for name, task in config.tasks.items():
        wanted = {
            "names unknown resources": [r for r in [getattr(task, "resource", None)] if r is not None and r not in config.resources],
            "depends on unknown tasks": [d for d in task.depends_on if d not in config.tasks],
            "names unknown schemas": [c for c in _contracts(task) if c not in config.schemas],
            "reads frames that no task makes:": [f for f in read_by(task) if f not in times],
        }
        out += [f"task {name!r} {what} {', '.join(sorted(set(lost)))}" for what, lost in wanted.items() if lost]
        out += [f"task {name!r}: {wrong}" for wrong in _step_problems(task)]
    store = config.orchestration.watermark_store
    if store and store.resource not in config.resources:
        out.append(f"the watermark store's resource {store.resource!r} is unknown")
    return out


# ---------------------------------------------------------------- order
def sorter(config: Any) -> TopologicalSorter:
    """Tasks, each after those that it depends on and those that make what it reads."""
    made = makers(config)
    graph = TopologicalSorter({name: {*task.depends_on, *(made[f] for f in read_by(task))} - {name} for name, task in config.tasks.items()})
    try:
        graph.prepare()
    except CycleError as e:
        raise DependencyError(f"tasks wait for each other: {' -> '.join(e.args[1])}") from e
    return graph


def order(config: Any) -> list[str]:
    graph, out = sorter(config), []
    while graph.is_active():
        ready = sorted(graph.get_ready())
        out += ready
        graph.done(*ready)
    return out


def consumers(config: Any) -> dict[str, int]:
    """How many tasks read each frame."""
    return dict(Counter(frame for task in config.tasks.values() for frame in set(read_by(task))))


def _order_matters(task: Any) -> bool:
    """Whether a step of the task depends on the order of rows."""
    for step in task.steps:
        try:
            if build_transform(step.action, step.with_).needs_order():
                return True
        except TransformError:
            continue  # the run says what is wrong with it
        if "|first}" in str(step.with_) or "|last}" in str(step.with_):
            return True
    return False


def ordered_frames(config: Any) -> set[str]:
    """Frames whose row order reaches a step that depends on it; only these carry ordinals."""
    made = makers(config)
    wanted = [f for t in config.tasks.values() if t.stage == "transform" and _order_matters(t) for f in read_by(t)]
    out: set[str] = set()
    while wanted:
        frame = wanted.pop()
        if frame not in out:
            out.add(frame)
            wanted += read_by(config.tasks[made[frame]])
    return out
