"""Cleaning, targets and derived rates.

All operators are narrow projections/filters: they fuse with the scan into
one whole-stage-codegen stage and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.functions import exprs as X
from tarmac.operators.contract import require_columns


def clean_flights(df: DataFrame, numeric_cols: list[str] | None = None) -> DataFrame:
    """Module variant of cleaning: year/month to int (null raises, like the
    pandas cast), ``arr_flights`` null->0 then clipped at 0, every other
    numeric null->0. Negative delays are kept."""
    require_columns(df, ["year", "month", "arr_flights"])
    numeric_cols = numeric_cols or [f.name for f in df.schema.fields
                                    if f.dataType.typeName() in ("double", "float", "integer", "long")
                                    and f.name not in ("year", "month")]
    out = {
        # raise_error keeps the contract of the pandas astype(int): a missing
        # year/month is an error, not a silent null.
        "year": F.when(F.col("year").isNull(), F.raise_error(F.lit("year is null"))
                       ).otherwise(F.col("year").cast("int")),
        "month": F.when(F.col("month").isNull(), F.raise_error(F.lit("month is null"))
                        ).otherwise(F.col("month").cast("int")),
        "arr_flights": F.greatest(F.coalesce(X.nan_to_null("arr_flights"), F.lit(0.0)), F.lit(0.0)),
    }
    for c in numeric_cols:
        if c != "arr_flights":
            out[c] = F.coalesce(X.nan_to_null(c), F.lit(0.0))
    return df.withColumns(out)


def mandatory_features(df: DataFrame, threshold: float = S.HIGH_DELAY_RATE_THRESHOLD) -> DataFrame:
    """delay_rate, avg_delay_per_flight (0 when arr_flights <= 0) and the
    strict ``delay_rate > threshold`` flag."""
    require_columns(df, ["arr_flights", "arr_del15", "arr_delay"])
    df = df.withColumns({
        "delay_rate": X.safe_ratio("arr_del15", "arr_flights"),
        "avg_delay_per_flight": X.safe_ratio("arr_delay", "arr_flights"),
    })
    return df.withColumn("high_delay_risk", X.flag_above("delay_rate", threshold))


def prepare_base(df: DataFrame, threshold: float = S.HIGH_DELAY_RATE_THRESHOLD) -> DataFrame:
    """Read-side pipeline of the module: contract, clean, targets."""
    require_columns(df, S.REQUIRED_COLUMNS)
    return mandatory_features(clean_flights(df.select(*S.REQUIRED_COLUMNS), S.NUMERIC_COLUMNS), threshold)


def clean_strict(df: DataFrame) -> DataFrame:
    """Notebook variant: keep ``arr_flights > 0`` and rows with all of
    year, month, carrier, airport present."""
    # explicit IS NOT NULL predicates (unlike dropna) are pushed to the scan
    cond = F.col("arr_flights") > 0
    for c in ("year", "month", "carrier", "airport"):
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def extended_rates(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """delay/avg/cancel/divert rates and five per-cause delays per flight.
    Input is expected to hold ``arr_flights > 0`` (``clean_strict``); missing
    numerators stay missing, as in pandas."""
    cols = {
        "delay_rate": X.plain_ratio("arr_del15", "arr_flights"),
        "avg_delay_per_flight": X.plain_ratio("arr_delay", "arr_flights"),
        "cancel_rate": X.plain_ratio("arr_cancelled", "arr_flights"),
        "divert_rate": X.plain_ratio("arr_diverted", "arr_flights"),
    }
    for c in S.CAUSES:
        cols[f"{c}_per_flight"] = X.plain_ratio(c, "arr_flights")
    df = df.withColumns(cols)
    if threshold is not None:
        df = df.withColumn("high_delay_risk", X.flag_above("delay_rate", threshold))
    return df


def risk_buckets(df: DataFrame, proba_col: str = "high_delay_risk_proba") -> DataFrame:
    """Label at p >= 0.5, HIGH/LOW, three-level risk and percent text."""
    return df.withColumns({
        "risk_label": X.risk_label(proba_col),
        "risk_text": X.risk_text(proba_col),
        "risk_level": X.risk_level(proba_col),
        "risk_percent": X.percent_text(proba_col),
    })


def feature_projection(df: DataFrame, feature_set: str = S.DEFAULT_FEATURES) -> DataFrame:
    """Project the model features in fixed order (P3/E6): the honest set
    unless another is named."""
    cols = S.FEATURE_SETS[feature_set]
    require_columns(df, cols)
    return df.select(*cols)
