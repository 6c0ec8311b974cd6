"""Registered queries: each wires derived inputs (``tarmac.fixtures``) to the
library's operators and has, where SQL can express it, an independent DuckDB
statement that must give the same rows.

Doubles are rounded to 6 decimals on both sides; integers are cast alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.fixtures import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (oracle comparison rule)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), 6).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _rsel(cols: list[str], prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture(spark, sf_dir, name)
