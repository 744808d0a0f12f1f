"""Column names that do not clash with those of a user's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it new to ``docs`` (in small letters, too)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The top-level column of this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")
