"""A log of steps with their time and the driver's peak memory."""

from __future__ import annotations

import resource
import time
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class StepLog:
    steps: list[dict] = field(default_factory=list)

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        try:
            yield self
        finally:
            self.steps.append({"step": name, "seconds": round(time.perf_counter() - began, 4), "peak_mib": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024})
