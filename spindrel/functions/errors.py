"""Categorised errors, and repetition of what may fail for a while."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
log = logging.getLogger("spindrel")


class EngineError(Exception):
    """An error with a category, and whether trying again may help."""

    def __init__(self, category: str, message: str, *, retry: bool = False):
        super().__init__(message)
        self.category, self.retry = category, retry


class Errors:
    """Counts of errors by category and message; warns once a kind has come more than ``many`` times."""

    def __init__(self, many: int = 5):
        self.many, self.counts = many, Counter()

    def add(self, error: Exception, category: str = "unknown") -> None:
        key = (getattr(error, "category", category), str(error))
        self.counts[key] += 1
        if self.counts[key] == self.many + 1:
            log.warning("%s came %d times: %s", key[0], self.counts[key], key[1])


def attempt(work: Callable[[], T], *, tries: int = 3, wait: float = 1.0, errors: Errors | None = None, fallback: Callable[[], T] | None = None) -> T:
    """The result of ``work``, tried again after ``wait`` times 1, 2, 4.. seconds; then ``fallback``, or the last error."""
    for i in range(tries):
        try:
            return work()
        except Exception as e:
            if errors:
                errors.add(e)
            if i == tries - 1 or getattr(e, "retry", True) is False:
                if fallback:
                    return fallback()
                raise
            time.sleep(wait * 2**i)
    raise ValueError("tries must be positive")
