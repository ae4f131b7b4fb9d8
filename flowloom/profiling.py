"""Wall-clock scopes of the driver's side: off unless switched on, then one entry a name."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass
class Entry:
    calls: int = 0
    seconds: float = 0.0
    least: float = float("inf")
    most: float = 0.0


class Profiler:
    """Sums the time of named scopes; safe to use from several threads."""

    def __init__(self, enabled: bool = False):
        self.enabled, self._lock, self.entries = enabled, threading.Lock(), {}

    @contextmanager
    def scope(self, name: str):
        if not self.enabled:
            yield
            return
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            with self._lock:
                e = self.entries.setdefault(name, Entry())
                e.calls, e.seconds = e.calls + 1, e.seconds + took
                e.least, e.most = min(e.least, took), max(e.most, took)

    def reset(self) -> None:
        with self._lock:
            self.entries.clear()

    def summary(self) -> list[tuple[str, int, float, float, float, float]]:
        """(name, calls, seconds, mean, least, most), the longest first."""
        with self._lock:
            rows = [(n, e.calls, e.seconds, e.seconds / e.calls, e.least, e.most) for n, e in self.entries.items()]
        return sorted(rows, key=lambda r: -r[2])


PROFILER = Profiler()
