"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the semantics are SQL-expressible, the DuckDB oracle SQL that must give the
same rows on the same tables."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass
class Query:
    name: str
    build: Callable
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column so both engines compare on the same digits."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def build(spark, sf_dir):
            return finish(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, fn.__doc__ or "")
        return build
    return deco


def r6(expr: str) -> str:
    return f"round({expr}, {DIGITS})"
