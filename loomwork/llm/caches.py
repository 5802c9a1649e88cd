"""What a worker process keeps between batches, one operator's at a time.

Workers live on from stage to stage. An operator that begins to work lets go of what
another one has kept, so that their sizes do not add up.
"""

from __future__ import annotations

from collections.abc import Callable

_HOLDER: list = [None, None]


def use(name: str, release: Callable[[], None] | None = None) -> None:
    """``name`` works now; ``release`` gives up what it keeps."""
    if _HOLDER[0] != name:
        if _HOLDER[1]:
            _HOLDER[1]()
        _HOLDER[:] = [name, release]
