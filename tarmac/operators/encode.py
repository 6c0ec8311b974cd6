"""Feature encoding, fit on train and applied anywhere.

* ``scaler_stage``: centring and scaling with the *population* std (the
  analysed pipeline's scaler); MLlib's ``StandardScaler`` uses the sample std
  and does not centre by default. Fitting is one aggregate pass; the stage is
  two numbers per column.
* one-hot: MLlib ``StringIndexer`` (alphabetical, ``keep``) + ``OneHotEncoder``
  (``dropLast``): the kept "unknown" slot is the dropped one, so unseen and
  null categories encode as all zeros; nothing else is dropped, and a vector
  has one slot per encoded name.
* imputers: exact medians (distributed, see ``ranks``) and most frequent
  values (ties -> smallest).

The saveable model encoder (these stages, fitted together with a model) is ``models.fit_encoder`` / ``models.fit_baseline_encoder``.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.ranks import exact_quantiles


def scaler_stage(train: DataFrame, num_cols: list[str], suffix: str = "__z") -> SQLTransformer:
    """Population-std scaler as a saveable stage (zero variance -> scale 1)."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(num_cols)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(num_cols)]).first()
    exprs = []
    for i, c in enumerate(num_cols):
        m = row[f"m{i}"] or 0.0
        s = row[f"s{i}"]
        s = s if s and s > 0 else 1.0
        exprs.append(f"(CAST(`{c}` AS DOUBLE) - ({m!r})) / ({s!r}) AS `{c}{suffix}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def one_hot_stages(cat_cols: list[str], suffix: str = "") -> list:
    """Indexer + encoder stages on ``{column}{suffix}``; categories sorted,
    unknown/null -> zeros. One multi-column indexer finds all category lists
    in one pass."""
    idx = StringIndexer(inputCols=[f"{c}{suffix}" for c in cat_cols], outputCols=[f"{c}__idx" for c in cat_cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat_cols],
                        outputCols=[f"{c}__ohe" for c in cat_cols], dropLast=True)
    return [idx, ohe]


def one_hot_labels(model: PipelineModel) -> list[list[str]]:
    """Category labels per column, in index order (bounded by categories)."""
    return [list(x) for s in model.stages if isinstance(s, StringIndexerModel) for x in s.labelsArray]


def one_hot_long(model: PipelineModel, df: DataFrame, cat_cols: list[str], keys: list[str]) -> DataFrame:
    """Active one-hot features per row in long form ``(keys..., feature)``
    with names ``cat__{column}_{category}``; unknown categories give no row.
    The category number is the active slot, so one pass names it; no vector
    is made dense."""
    indexed = df
    for s in model.stages:
        indexed = s.transform(indexed)
        if isinstance(s, StringIndexerModel):
            break
    names = [F.get(F.array(*[F.lit(f"cat__{c}_{v}") for v in values]), F.col(f"{c}__idx").cast("int"))
             for c, values in zip(cat_cols, one_hot_labels(model))]
    return indexed.select(*keys, F.explode(F.array_compact(F.array(*names))).alias("feature"))


# --------------------------------------------------------------- imputers
def median_fill_values(train: DataFrame, cols: list[str]) -> DataFrame:
    """Exact median per column, ``(column_name, value)``."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column_name", "v")
    q = exact_quantiles(long, ["column_name"], "v", [0.5])
    return q.select("column_name", F.col("quantile").alias("value"))


def mode_fill_values(train: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column, ties -> smallest."""
    long = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "v")
    counts = long.where(F.col("v").isNotNull()).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    # max_by over (count, reversed order): highest count, then smallest value
    return (counts.groupBy("column_name")
                  .agg(F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v"))).alias("value")))


def fill_values(train: DataFrame, num_cols: list[str], cat_cols: list[str]) -> dict:
    """Fitted fill value per column (one value a column reaches the driver)."""
    rows = median_fill_values(train, num_cols).collect() + mode_fill_values(train, cat_cols).collect()
    return {r["column_name"]: r["value"] for r in rows}


def fill_stage(fills: dict, num_cols: list[str], cat_cols: list[str], suffix: str = "__f") -> SQLTransformer:
    """Imputation as a saveable stage: ``{column}{suffix}`` with nulls filled."""
    def one(c, kind, literal):
        value = f"CAST(`{c}` AS {kind})"
        return f"coalesce({value}, {literal(fills[c])}) AS `{c}{suffix}`" if fills.get(c) is not None else f"{value} AS `{c}{suffix}`"
    exprs = [one(c, "DOUBLE", lambda v: repr(float(v))) for c in num_cols] + [one(c, "STRING", json.dumps) for c in cat_cols]
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")
