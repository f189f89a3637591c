"""Intermediate tables, and names that clash."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame

from strideframe.session import cut


def without(rows: DataFrame, *outputs: str) -> DataFrame:
    """rows without columns named like an output column, whatever their case: the output takes their place."""
    taken = {c.lower() for c in outputs}
    return rows.select(*[f"`{c}`" for c in rows.columns if c.lower() not in taken])


def set_aside(rows: DataFrame, *internal: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(rows whose columns named like an internal one carry another name, the way back)."""
    taken, free = {c.lower() for c in internal}, {c.lower() for c in rows.columns}
    moved = {}
    for c in rows.columns:
        if c.lower() in taken:
            new = f"aside_{c}"
            while new.lower() in free | taken:
                new = f"_{new}"
            free.add(new.lower())
            moved[c] = new
    return rows.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({new: c for c, new in moved.items()})


def settle(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder, with the shuffle files of its making given up.

    Spark drops a shuffle's files when the driver's garbage collector finds that no
    plan needs them; a large job fills the disks before that happens by itself.
    """
    out = cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
