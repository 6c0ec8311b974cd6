"""Schema contracts (P1, P2, P13, P19): metadata checks before any action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumnsError(ValueError):
    pass


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Raise when any required column is absent (checked on the schema, no job)."""
    miss = missing_columns(df, required)
    if miss:
        raise MissingColumnsError(f"missing columns: {miss}")
    return df


def schema_diff(df: DataFrame, expected: list[str]) -> DataFrame:
    """Both-way diff as rows ``(column, status)``: present / missing / extra.

    For present columns the non-null count is computed in the same single pass
    over the data (one aggregate, partial aggregation per task).
    """
    spark = df.sparkSession
    have = df.columns
    present = [c for c in expected if c in have]
    rows = ([(c, "present") for c in present]
            + [(c, "missing") for c in expected if c not in have]
            + [(c, "extra") for c in have if c not in expected])
    meta = spark.createDataFrame(rows, "column_name string, status string")
    if present:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in present])
        counts = counts.unpivot([], present, "column_name", "non_null")
        meta = meta.join(counts, "column_name", "left")
    else:
        meta = meta.withColumn("non_null", F.lit(None).cast("long"))
    return meta


def first_existing(df: DataFrame, candidates: dict[str, list[str]]) -> dict[str, str]:
    """For each metric label pick the first candidate column present."""
    out = {}
    for label, cands in candidates.items():
        for c in cands:
            if c in df.columns:
                out[label] = c
                break
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
