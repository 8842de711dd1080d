"""Helper columns whose names clash with none of the user's."""

from __future__ import annotations


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``columns`` (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
