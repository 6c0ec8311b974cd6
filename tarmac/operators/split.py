"""Reproducible stratified train/val/test split (W10) and split utilities
(W7, W8, A8, A17).

Each row gets ``u`` in [0, 1) from the md5 of its business key; per label,
the exact 70 % / 85 % quantiles of ``u`` are the cut-offs. No global sort, no
random state: the same rows always land in the same split, on any cluster
size, and the per-label sizes are within one row of the ratios.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators.ranks import exact_quantiles

BUSINESS_KEY = ["year", "month", "carrier", "airport"]


def hash_unit(keys: list[str]) -> F.Column:
    """u = first 32 bits of md5(key1|key2|...) / 2^32."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stratified_split(df: DataFrame, label: str = S.TARGET_CLASSIFICATION,
                     keys: list[str] = BUSINESS_KEY, train: float = 0.70, val: float = 0.15,
                     split_col: str = "split") -> DataFrame:
    """Add ``split`` in {train, val, test} stratified on ``label``; rows
    without a label are a stratum of their own."""
    c1, c2 = train, train + val
    stratum = F.when(F.col(label).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    withu = df.withColumn("_u", hash_unit(keys)).withColumn("_stratum", stratum)
    cuts = exact_quantiles(withu, ["_stratum"], "_u", [c1, c2])
    # one row per label value: bounded by the number of classes
    cut = (cuts.groupBy("_stratum")
               .agg(F.max(F.when(F.col("prob") == c1, F.col("quantile"))).alias("_c1"),
                    F.max(F.when(F.col("prob") == c2, F.col("quantile"))).alias("_c2")))
    out = withu.join(F.broadcast(cut), "_stratum", "left")
    s = (F.when(F.col("_u") <= F.col("_c1"), F.lit("train"))
          .when(F.col("_u") <= F.col("_c2"), F.lit("val"))
          .otherwise(F.lit("test")))
    return out.withColumn(split_col, s).drop("_stratum", "_u", "_c1", "_c2")


def union_splits(parts: dict[str, DataFrame], split_col: str = "split") -> DataFrame:
    """Concatenate split tables with their tag."""
    out = None
    for name, df in parts.items():
        t = df.withColumn(split_col, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def missing_by_split(df: DataFrame, cols: list[str], split_col: str = "split") -> DataFrame:
    """Missing rate of ``cols`` per split."""
    return df.groupBy(split_col).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
