"""Notifications of failures and missed time limits."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from .errors import RegistryError
from .registry import NOTIFIERS, register_notifier

log = logging.getLogger("weirflow")


@register_notifier("log")
class LogNotifier:
    def notify(self, event: str, message: str, target: str | None = None) -> None:
        log.error("[%s] %s%s", event, message, f" -> {target}" if target else "")


class Notifier:
    """Sends an event to each channel; an unknown type is logged, and a failing one doesn't stop the run."""

    def __init__(self, channels: Iterable):
        self._channels = []
        for channel in channels:
            try:
                made = NOTIFIERS.get(channel.type)()
            except RegistryError:
                log.warning("unknown notification type %r: logged instead", channel.type)
                made = LogNotifier()
            self._channels.append((made, channel.target))

    def send(self, event: str, message: str) -> None:
        for channel, target in self._channels:
            try:
                channel.notify(event, message, target)
            except Exception:
                log.exception("a notification failed")
