"""Wall-clock timers by name."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Timers:
    """Seconds and number of runs of each part; parts may be nested. Spark is lazy: what a part doesn't run isn't in its time."""

    seconds: dict[str, float] = field(default_factory=dict)
    runs: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def part(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.runs[name] = self.runs.get(name, 0) + 1

    def rate(self, name: str, cells: int) -> float:
        """Cell updates a second of a part that updates so many cells a run."""
        return cells * self.runs[name] / self.seconds[name]

    def report(self) -> str:
        rows = sorted(self.seconds, key=self.seconds.get, reverse=True)
        return "\n".join(f"{n}: {self.seconds[n]:.3f} s, {self.runs[n]} runs" for n in rows)
