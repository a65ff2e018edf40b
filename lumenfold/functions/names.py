"""Names of columns that operators add for a while."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, each with underscores added until no column is called so (names do not tell upper from lower case)."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out
