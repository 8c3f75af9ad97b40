"""Where ``${secret:path}`` values come from, and a log filter that hides them."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from typing import Protocol

from .errors import SecretError
from .registry import register_secret_provider


class SecretProvider(Protocol):
    def get(self, path: str) -> str: ...


class MappingSecretProvider:
    """Secrets from a dictionary."""

    def __init__(self, values: Mapping[str, str] | None = None):
        self._values = dict(values or {})

    def get(self, path: str) -> str:
        if path not in self._values:
            raise SecretError(f"no secret {path!r}")
        return self._values[path]


@register_secret_provider("env")
class EnvSecretProvider:
    """Secrets from environment variables: by a mapping of paths, else ``a/b`` is ``A_B``."""

    def __init__(self, names: Mapping[str, str] | None = None):
        self._names = dict(names or {})

    def get(self, path: str) -> str:
        name = self._names.get(path) or "".join(c if c.isalnum() else "_" for c in path).upper()
        if name not in os.environ:
            raise SecretError(f"no secret {path!r}: {name} isn't set")
        return os.environ[name]


class RedactingFilter(logging.Filter):
    """Replaces secret values in log records."""

    def __init__(self, secrets: set[str]):
        super().__init__()
        self._secrets = sorted((s for s in secrets if s), key=len, reverse=True)

    def filter(self, record: logging.LogRecord) -> bool:
        text = record.getMessage()
        for secret in self._secrets:
            text = text.replace(secret, "***")
        record.msg, record.args = text, None
        return True
