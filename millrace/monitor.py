"""Peak memory and CPU of a task, sampled in a thread."""

from __future__ import annotations

import resource
import threading
import time
from pathlib import Path

_LIMITS = ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes")


def memory_limit_mb() -> float | None:
    """The control group's memory limit, if it has one."""
    for path in _LIMITS:
        try:
            text = Path(path).read_text().strip()
        except OSError:
            continue
        if text.isdigit() and int(text) < 1 << 50:
            return int(text) / 1e6
    return None


def resident_mb() -> float:
    try:
        return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6
    except OSError:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3


class Monitor:
    """``start()`` ... ``stop()`` -> what the time between took. Advisory: a process may run several tasks."""

    def __init__(self, interval: float = 1.0) -> None:
        self.interval = interval
        self._end = threading.Event()

    def start(self) -> Monitor:
        self._began, self._cpu = time.monotonic(), time.process_time()
        self._peak = resident_mb()
        self._thread = threading.Thread(target=self._sample, daemon=True)
        self._thread.start()
        return self

    def _sample(self) -> None:
        while not self._end.wait(self.interval):
            self._peak = max(self._peak, resident_mb())

    def stop(self) -> dict:
        self._end.set()
        self._thread.join()
        return {"peak_mem_mb": max(self._peak, resident_mb()), "limit_mb": memory_limit_mb(), "wall_seconds": time.monotonic() - self._began, "cpu_seconds": time.process_time() - self._cpu}
