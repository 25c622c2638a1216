"""One word memory at a time per Python worker: workers live through many stages, and their memory is bounded."""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def lease(name: str, clear: Callable[[], None]) -> None:
    """Called by an operator when its task begins: empties what other operators keep in this worker."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    _held[name] = clear
