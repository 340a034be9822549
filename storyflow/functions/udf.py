"""Arrow UDFs that are made when they are first used on a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy(mapped: Callable, kind: str) -> Callable[..., Column]:
    """Column function of an annotated Arrow function; a session is needed only to call it."""
    return lambda *columns: F.arrow_udf(mapped, kind)(*columns)
