"""Registry of named queries: a Spark plan and, where SQL can say it, the
DuckDB text of the same answer over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.fixture_sql import with_views


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def nine_digits(df: DataFrame, *means: str) -> DataFrame:
    """Round a query's mean columns for the comparison with the oracle: the order in which doubles
    are summed changes their last bits.  Operators return plain means."""
    return df.withColumns({m: F.round(m, 9) for m in means})


def register(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Decorator: register ``plan(spark, sf_dir)`` under ``name``.  ``recursive``
    marks an oracle that uses a recursive CTE (``WITH RECURSIVE``)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        text = with_views(sql, *views) if sql else None
        if text and recursive:
            text = "WITH RECURSIVE " + text[len("WITH "):]
        REGISTRY[name] = Entry(name, fn, text)
        return fn
    return deco
