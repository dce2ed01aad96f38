"""Letting go of what a Python worker keeps between tasks once it has been idle, so that other stages get the memory."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable

AFTER_S = 6.0

_timer: threading.Timer | None = None


def busy() -> None:
    """A task begins: nothing is released meanwhile."""
    global _timer
    if _timer is not None:
        _timer.cancel()
        _timer = None


def idle(release: Callable[[], None], after: float = AFTER_S) -> None:
    """A task ends: call release unless another begins within `after` seconds, and give the freed memory back."""
    global _timer
    busy()

    def run() -> None:
        release()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    _timer = threading.Timer(after, run)
    _timer.daemon = True
    _timer.start()
