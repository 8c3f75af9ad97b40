"""``${namespace:reference}`` tokens in blueprints."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from typing import Any

from ..errors import InterpolationError, SecretError

_TOKEN = re.compile(r"\$\{(env|var|param|secret):([^}]+)\}")


class Interpolator:
    """Resolves tokens: env, var, param and secret. ``pipe`` tokens are left for the run.

    A value that is one token keeps the type of what it refers to; inside other text it becomes
    text. Without ``strict`` a token that has no value stays.
    """

    def __init__(self, variables: dict, params: dict, secret: Callable[[str], str], strict: bool = True):
        self.variables, self.params, self.secret, self.strict = variables, params, secret, strict

    def _look(self, space: str, path: str) -> Any:
        if space == "env":
            name, default = path.split(":-", 1) if ":-" in path else (path, None)
            if name in os.environ or default is not None:
                return os.environ.get(name, default)
            raise InterpolationError(f"environment variable {name} isn't set")
        if space == "secret":
            try:
                return self.secret(path)
            except (KeyError, SecretError) as e:
                raise SecretError(f"no secret {path!r}") from e
        source = self.variables if space == "var" else self.params
        if path in source:
            return source[path]
        here: Any = source
        for part in path.split("."):
            if not isinstance(here, dict) or part not in here:
                raise InterpolationError(f"no {'variable' if space == 'var' else 'parameter'} {path!r}")
            here = here[part]
        return here

    def _value(self, match: re.Match) -> Any:
        try:
            return self._look(match[1], match[2].strip())
        except InterpolationError:
            if self.strict:
                raise
            return match[0]

    def resolve(self, node: Any, depth: int = 0) -> Any:
        if isinstance(node, dict):
            return {self.resolve(k, depth) if isinstance(k, str) else k: self.resolve(v, depth) for k, v in node.items()}
        if isinstance(node, list):
            return [self.resolve(v, depth) for v in node]
        if not isinstance(node, str) or "${" not in node:
            return node
        if depth > 20:
            raise InterpolationError(f"tokens refer to each other: {node!r}")
        whole = _TOKEN.fullmatch(node)
        out = self._value(whole) if whole else _TOKEN.sub(lambda m: str(self._value(m)), node)
        return self.resolve(out, depth + 1) if out != node and (whole is None or whole[1] != "secret") else out
