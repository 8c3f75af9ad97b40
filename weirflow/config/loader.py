"""From files or dictionaries to a validated blueprint."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pydantic import ValidationError

from ..errors import ConfigError
from ..secret_providers import EnvSecretProvider, SecretProvider
from .interpolation import Interpolator
from .format import Document


@dataclass(frozen=True)
class PipelineConfig:
    """A validated blueprint, the parameters it was given, and the secrets that it holds.

    The document's sections are attributes: ``config.tasks``, ``config.resources`` and so on.
    """

    document: Document
    params: Mapping[str, Any] = field(default_factory=dict)
    secrets: frozenset[str] = frozenset()

    def __getattr__(self, section: str) -> Any:
        if section.startswith("_") or section == "document":
            raise AttributeError(section)
        return getattr(self.document, section)


_FOLDED = ("retry", "on_failure", "checkpoint", "validate")


def _read(path: Path) -> dict:
    try:
        text = path.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    try:
        found = json.loads(text) if path.suffix.lower() == ".json" else yaml.safe_load(text)
    except (ValueError, yaml.YAMLError) as e:
        raise ConfigError(f"{path} isn't valid: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{path} isn't a mapping")
    return found


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` wins; mappings are merged and lists are joined."""
    out = dict(base)
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = deep_merge(out[key], value)
        elif isinstance(value, list) and isinstance(out.get(key), list):
            out[key] = out[key] + value
        else:
            out[key] = value
    return out


def _imported(document: dict, folder: Path, seen: set[Path]) -> dict:
    document = dict(document)
    names = document.pop("imports", None) or []
    base: dict = {}
    for name in [names] if isinstance(names, str) else names:
        path = (folder / name).resolve()
        if path in seen:
            raise ConfigError(f"{path} is imported twice or in a circle")
        seen.add(path)
        base = deep_merge(base, _imported(_read(path), path.parent, seen))
    return deep_merge(base, document)


def _templated(document: dict) -> dict:
    templates = document.get("templates") or {}
    defaults = document.get("defaults") or {}
    tasks = {}
    for name, task in (document.get("tasks") or {}).items():
        if not isinstance(task, dict):
            raise ConfigError(f"task {name!r} isn't a mapping")
        task = dict(task)
        chain, parent = [], task.pop("extends", None)
        while parent is not None:
            if parent in chain or parent not in templates:
                raise ConfigError(f"task {name!r}: template {parent!r} " + ("extends itself" if parent in chain else "doesn't exist"))
            chain.append(parent)
            template = dict(templates[parent])
            parent = template.pop("extends", None)
            task = {**template, **task}
        for key in _FOLDED:
            if key in defaults and key not in task:
                task[key] = copy.deepcopy(defaults[key])
        tasks[name] = task
    return {**document, "tasks": tasks}


def _typed(name: str, kind: str, value: Any) -> Any:
    try:
        if kind == "integer":
            return int(value)
        if kind == "float":
            return float(value)
        if kind == "boolean":
            return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    except (TypeError, ValueError) as e:
        raise ConfigError(f"parameter {name!r}: {value!r} isn't {kind}") from e
    return str(value)


def _parameters(declared: dict, given: dict) -> dict:
    out = dict(given)
    for name, spec in declared.items():
        spec = spec or {}
        value = given.get(name, spec.get("default"))
        if value is None:
            if spec.get("required"):
                raise ConfigError(f"parameter {name!r} is required")
            continue
        value = _typed(name, spec.get("type", "string"), value)
        allowed = spec.get("allowed")
        if allowed is not None and value not in [_typed(name, spec.get("type", "string"), a) for a in allowed]:
            raise ConfigError(f"parameter {name!r}: {value!r} isn't one of {allowed}")
        out[name] = value
    return out


def load_config(source: str | Path | dict, *, params: dict[str, Any] | None = None, secret_provider: SecretProvider | None = None, strict: bool = True) -> PipelineConfig:
    """The blueprint of a YAML or JSON file, or of a dictionary."""
    if isinstance(source, dict):
        document = _imported(copy.deepcopy(source), Path.cwd(), set())
    else:
        path = Path(source).resolve()
        document = _imported(_read(path), path.parent, {path})
    document = _templated(document)
    given = _parameters(document.get("parameters") or {}, dict(params or {}))
    provider = secret_provider or EnvSecretProvider()
    secrets: set[str] = set()

    def secret(path: str) -> str:
        value = provider.get(path)
        secrets.add(str(value))
        return value

    variables = Interpolator(document.get("vars") or {}, given, secret, strict).resolve(document.get("vars") or {})
    resolved = Interpolator(variables, given, secret, strict).resolve({k: v for k, v in document.items() if k not in ("vars", "parameters")})
    resolved |= {"vars": variables, "parameters": document.get("parameters") or {}}
    try:
        made = Document.model_validate(resolved)
    except ValidationError as e:
        raise ConfigError("; ".join(f"{'.'.join(map(str, x['loc']))}: {x['msg']}" for x in e.errors())) from e
    from ..plans.dag import problems  # plans need blueprints, which need them only here

    wrong = problems(made)
    if wrong:
        raise ConfigError("; ".join(wrong))
    return PipelineConfig(made, given, frozenset(secrets))
