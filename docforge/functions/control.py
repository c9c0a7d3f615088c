"""Rate limiting, retry and path checks for code that calls out of a task."""

from __future__ import annotations

import os
import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

T = TypeVar("T")


class RateLimiter:
    """Token bucket: starts full, refills continuously; a task's share is qps over the number of tasks."""

    def __init__(self, qps: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if qps <= 0:
            raise ValueError("qps must be positive")
        self.capacity, self.interval = float(qps), 1.0 / qps
        self._held, self._at = float(qps), clock()
        self._clock, self._sleep, self._lock = clock, sleep, threading.Lock()

    def _refill(self) -> None:
        now = self._clock()
        self._held = min(self.capacity, self._held + (now - self._at) / self.interval)
        self._at = now

    def acquire(self, permits: int = 1) -> None:
        """Take permits, waiting out the deficit."""
        if permits <= 0:
            raise ValueError("permits must be positive")
        with self._lock:
            self._refill()
            self._held -= permits
            wait = max(0.0, -self._held * self.interval)
        if wait:
            self._sleep(wait)

    def try_acquire(self, permits: int = 1, timeout: float = 0.0) -> bool:
        """Take permits if their wait is within the timeout; otherwise take none."""
        if permits <= 0:
            raise ValueError("permits must be positive")
        with self._lock:
            self._refill()
            wait = max(0.0, (permits - self._held) * self.interval)
            if wait > timeout:
                return False
            self._held -= permits
        if wait:
            self._sleep(wait)
        return True


@dataclass
class Retry:
    """Retry with exponential (or, with multiplier 1, fixed) backoff and jitter."""

    attempts: int = 3
    initial: float = 1.0
    multiplier: float = 2.0
    most: float = 30.0
    jitter: bool = True
    only: tuple[type[BaseException], ...] = ()
    sleep: Callable[[float], None] = time.sleep
    rng: random.Random = field(default_factory=random.Random)

    def delay(self, attempt: int) -> float:
        base = min(self.initial * self.multiplier ** (attempt - 1), self.most)
        return base * (0.5 + self.rng.random()) if self.jitter else base

    def run(self, work: Callable[[], T]) -> T:
        for attempt in range(1, self.attempts + 1):
            try:
                return work()
            except Exception as error:
                if attempt == self.attempts or (self.only and not isinstance(error, self.only)):
                    raise
                self.sleep(self.delay(attempt))
        raise ValueError("attempts must be positive")


def safe_path(path: str, base: str) -> str:
    """Absolute path inside a base folder; anything outside is refused."""
    root, full = os.path.realpath(base), os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([root, full]) != root:
        raise PermissionError(f"{path} is outside {base}")
    return full


def is_safe_path(path: str, base: str) -> bool:
    try:
        safe_path(path, base)
    except (PermissionError, ValueError):
        return False
    return True
