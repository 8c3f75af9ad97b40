"""Durations: ``30s``, ``10m``, ``2h``, ``7d``, ``1w``; bare numbers are seconds."""

import re
from datetime import timedelta

from .errors import ConfigError

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
_SHAPE = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([smhdw]?)\s*", re.I)


def parse_duration(value: str | float) -> timedelta:
    found = _SHAPE.fullmatch(str(value))
    if not found or isinstance(value, bool):
        raise ConfigError(f"not a duration: {value!r}")
    return timedelta(**{_UNITS[found[2].lower() or "s"]: float(found[1])})
