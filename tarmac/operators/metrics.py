"""Exact evaluation metrics as aggregates.

AUC is the Mann-Whitney statistic with half credit for ties, computed from
per-score counts and a distributed running sum (``ranks.prefix_sum``): no
global sort into one task, and the per-score pre-aggregation shrinks the data
before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.ranks import prefix_sum


def auc(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """One row ``auc``; 0.5 when only one class is present."""
    per = (df.where(F.col(score).isNotNull())
             .groupBy(F.col(score).cast("double").alias("_s"))
             .agg(F.sum(F.col(label).cast("long")).alias("_pos"),
                  F.sum((1 - F.col(label)).cast("long")).alias("_neg")))
    cum = prefix_sum(per, [], "_s", "_neg", "_neg_below")
    tot = cum.agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"),
                  F.sum(F.col("_pos") * (F.col("_neg_below") + 0.5 * F.col("_neg"))).alias("U"))
    return tot.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                             F.col("U") / (F.col("P").cast("double") * F.col("N"))).otherwise(F.lit(0.5)).alias("auc"))


def classification_metrics(df: DataFrame, label: str = "y", score: str = "p", cut: float = 0.5) -> DataFrame:
    """Accuracy, recall of class 1 and the confusion matrix at ``score >= cut``."""
    yhat = (F.col(score) >= F.lit(cut)).cast("int")
    y = F.col(label).cast("int")
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(((yhat == 1) & (y == 1)).cast("long")).alias("tp"),
        F.sum(((yhat == 1) & (y == 0)).cast("long")).alias("fp"),
        F.sum(((yhat == 0) & (y == 0)).cast("long")).alias("tn"),
        F.sum(((yhat == 0) & (y == 1)).cast("long")).alias("fn"))
    return agg.select(
        F.when(F.col("n") > 0, (F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
         .otherwise(F.lit(0.0)).alias("recall"),
        "tp", "fp", "tn", "fn")


def regression_metrics(df: DataFrame, label: str = "y_reg", pred: str = "yhat") -> DataFrame:
    """RMSE, MAE and R^2 = 1 - SSE/SST with SST = var_pop * n (one pass)."""
    e = F.col(pred) - F.col(label)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
                 F.var_pop(F.col(label)).alias("vp"))
    return agg.select(F.when(F.col("n") > 0, F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"), "mae",
                      F.when(F.col("vp") > 0, 1 - F.col("sse") / (F.col("vp") * F.col("n"))).alias("r2"))
