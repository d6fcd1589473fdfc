"""Small driver-side helpers."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def timed(f: Callable[[], T]) -> tuple[T, float]:
    """What ``f`` returns and the seconds it took."""
    began = time.perf_counter()
    out = f()
    return out, time.perf_counter() - began


def retry(f: Callable[[], T], tries: int = 10, on_wrong: Callable[[Exception], None] = lambda e: None) -> T:
    """Call ``f`` until it raises nothing, ``tries`` times at most; the last error is raised."""
    for i in range(tries):
        try:
            return f()
        except Exception as e:
            on_wrong(e)
            if i == tries - 1:
                raise
    raise ValueError("tries must be positive")
