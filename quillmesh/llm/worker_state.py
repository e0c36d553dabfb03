"""What a Python worker keeps between tasks: the state of one operator at a time, so that memory doesn't add up over stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_held: dict = {}


def only(name, make: Callable):
    """The state `name`, made if it isn't held; that of any other operator is let go and its memory given back."""
    state = _held.get(name)
    if state is None:
        if _held:
            _held.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass
        state = _held[name] = make()
    return state
