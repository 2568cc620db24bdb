"""Calls on an instance that a fault may spoil: it is built anew once, and the calls that the fault hit are made once more."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

POISONED = "instance_poisoned"


class Recovering:
    """call(f) gives f(instance), a reply of ok, code and more.

    A reply with the code POISONED makes the caller that sees it first build a new instance; others whose call failed meanwhile wait for
    that and call once more on the new one. A reply that succeeded is kept. A second fault is handed on.
    """

    def __init__(self, build: Callable[[], Any]):
        self._build, self._lock = build, threading.Lock()
        self._instance, self.builds = build(), 1

    def call(self, f: Callable[[Any], dict]) -> dict:
        instance, number = self._instance, self.builds
        reply = f(instance)
        if reply.get("ok") is not False:
            return reply
        with self._lock:  # a rebuild that runs is waited for
            rebuilt = self.builds > number
            if not rebuilt and reply.get("code") == POISONED:
                self._instance, self.builds, rebuilt = self._build(), self.builds + 1, True
        return f(self._instance) if rebuilt else reply
