"""Columns of a caller that are named like an operator's own."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def own_names(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns begin with ``__``: such columns of its input stand under other names meanwhile."""

    @wraps(run)
    def wrapped(docs: DataFrame, *args, **kwargs) -> DataFrame:
        aside = {c: f"aside_{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not aside:
            return run(docs, *args, **kwargs)
        return run(docs.withColumnsRenamed(aside), *args, **kwargs).withColumnsRenamed({v: c for c, v in aside.items()})

    return wrapped
