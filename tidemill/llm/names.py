"""Column names that operators add inside, kept apart from those of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until the input has no such column (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The input's columns but for these (case aside)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]
