"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac import schema as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """pandas treats NaN as missing; Spark has both. Normalise NaN to null."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def safe_ratio(num, den) -> Column:
    """num/den when den > 0, else 0.0 (never a bare division: ANSI raises)."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(0.0))


def plain_ratio(num, den) -> Column:
    """num/den with pandas semantics for a positive denominator and null
    otherwise (used after a ``den > 0`` filter, so null never appears there)."""
    return F.when(col(den) != 0, col(num) / col(den))


def flag_above(c, threshold: float) -> Column:
    """Strict ``c > threshold`` as 0/1 int."""
    return (col(c) > F.lit(float(threshold))).cast("int")


def risk_label(p, cut: float = S.LABEL_CUT) -> Column:
    return (col(p) >= F.lit(float(cut))).cast("int")


def risk_text(p, cut: float = S.LABEL_CUT) -> Column:
    return F.when(col(p) >= F.lit(float(cut)), F.lit("HIGH")).otherwise(F.lit("LOW"))


def risk_level(p, low: float = S.RISK_LOW_CUT, high: float = S.RISK_HIGH_CUT) -> Column:
    return (F.when(col(p) < F.lit(float(low)), F.lit("low"))
            .when(col(p) < F.lit(float(high)), F.lit("medium"))
            .otherwise(F.lit("high")))


def percent_text(p, decimals: int = 1) -> Column:
    """``f"{p*100:.1f}%"`` as text."""
    return F.concat(F.format_string(f"%.{decimals}f", col(p) * 100), F.lit("%"))

