"""Names for columns that an operator adds for a while beside those of its caller."""

from __future__ import annotations

from collections.abc import Sequence


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """``wanted``, each followed by as many underscores as keep it apart from the names taken, case aside."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
