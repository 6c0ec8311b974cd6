"""Queries: stratified split, split tables, encoders, imputers, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.fixtures import materialised, oracle_with
from tarmac.operators import encode as EN
from tarmac.operators import models as MD
from tarmac.operators import metrics as M
from tarmac.operators import split as SP
from tarmac.operators import weather as W
from tarmac.plans.catalog import query, r6
from tarmac.plans.q_flights import flights_eda, flights_features
from tarmac.plans.q_weather import MONTHLY_SQL, _FW_SQL, flights_weather, monthly
from tarmac.session import scratch_path
from tarmac.sources import files as IO

KEYS = SP.BUSINESS_KEY
NUM20 = S.numeric_part(S.FEATURES_REFERENCE)

_U = ("CAST(CAST(('0x' || substr(md5(concat_ws('|', CAST(year AS STRING), CAST(month AS STRING), carrier, airport)), 1, 8)) AS BIGINT) AS DOUBLE)"
      " / CAST(4294967296 AS DOUBLE)")


def _split_sql(src: str) -> str:
    return f"""
, u AS (SELECT *, {_U} AS u FROM {src}),
cuts AS (SELECT high_delay_risk, quantile_cont(u, 0.70) AS c1, quantile_cont(u, 0.85) AS c2 FROM u GROUP BY 1),
s AS (SELECT u.* EXCLUDE (u), CASE WHEN u.u <= cuts.c1 THEN 'train' WHEN u.u <= cuts.c2 THEN 'val' ELSE 'test' END AS split
  FROM u JOIN cuts ON u.high_delay_risk = cuts.high_delay_risk)
"""


SPLIT_SQL = _split_sql("flights_features")


def split_features(spark, sf):
    """Split table of the cleaned monthly data (written once per session)."""
    return materialised(spark, f"split_features:{sf}", lambda: SP.stratified_split(flights_features(spark, sf)))


def split_weather(spark, sf):
    """Split table of the weather-enriched data (written once per session)."""
    return materialised(spark, f"split_weather:{sf}", lambda: SP.stratified_split(flights_weather(spark, sf)))


@query("stratified_split", oracle_with(["flights_features"], SPLIT_SQL + """
SELECT year, month, carrier, airport, high_delay_risk, split FROM s"""))
def q_stratified_split(spark, sf):
    return SP.stratified_split(flights_features(spark, sf)).select(*KEYS, "high_delay_risk", "split")


@query("split_sizes", oracle_with(["flights_features"], SPLIT_SQL + """
SELECT split, count(*) AS rows, CAST(24 AS BIGINT) AS columns FROM s GROUP BY split"""))
def q_split_sizes(spark, sf):
    from tarmac.operators.eda import split_sizes
    return split_sizes(split_features(spark, sf))


@query("write_splits", oracle_with(["flights_features"], SPLIT_SQL + """
SELECT year, month, carrier, airport, high_delay_risk, split FROM s"""))
def q_write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    IO.write_splits(split_features(spark, sf), path)
    return IO.read_table(spark, path).select(*KEYS, "high_delay_risk", "split")


@query("load_splits", oracle_with(["flights_features"], SPLIT_SQL + """
SELECT split, count(*) AS rows, round(avg(delay_rate), 6) AS mean_delay_rate FROM s GROUP BY split"""))
def q_load_splits(spark, sf):
    path = scratch_path(spark, "splits")
    IO.write_splits(split_features(spark, sf), path)
    parts = IO.load_splits(spark, path)
    tagged = SP.union_splits(parts)
    return r6(tagged.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                          F.avg("delay_rate").alias("mean_delay_rate")))


@query("union_splits", oracle_with(["flights_features"], SPLIT_SQL + """
SELECT year, month, carrier, airport, split FROM s WHERE split IN ('train', 'val')"""))
def q_union_splits(spark, sf):
    path = scratch_path(spark, "splits")
    IO.write_splits(split_features(spark, sf), path)
    parts = IO.load_splits(spark, path)
    return SP.union_splits({"train": parts["train"], "val": parts["val"]}).select(*KEYS, "split")


@query("weather_nan_by_split", oracle_with(["flights_features", "weather_daily"], MONTHLY_SQL + f"""
, fwn AS (SELECT f.*, {", ".join(f"m.{c}" for c in S.WEATHER_COLUMNS)}
  FROM flights_features f LEFT JOIN monthly m ON f.airport = m.airport AND f.year = m.year AND f.month = m.month)
{_split_sql("fwn")}
SELECT split, {", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in S.WEATHER_COLUMNS)}
FROM s GROUP BY split"""))
def q_weather_nan_by_split(spark, sf):
    w = monthly(spark, sf)
    joined = flights_features(spark, sf).join(w, W.KEY, "left")     # before the 0-fill
    return r6(SP.missing_by_split(SP.stratified_split(joined), S.WEATHER_COLUMNS))


_FWS_SQL = _FW_SQL + _split_sql("fw")


@query("standard_scale", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + f"""
, st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM20)} FROM s WHERE split = 'train')
SELECT year, month, carrier, airport, split,
  {", ".join(f"round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE {c} - m_{c} END, 6) AS {c}__z" for c in NUM20)}
FROM s, st"""))
def q_standard_scale(spark, sf):
    df = split_weather(spark, sf)
    model = EN.scaler_stage(df.where("split = 'train'"), NUM20, "__z")
    return r6(model.transform(df).select(*KEYS, "split", *[c + "__z" for c in NUM20]))


CATS = S.CATEGORICAL_COLUMNS


@query("one_hot", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + " UNION ALL ".join(
    f"SELECT year, month, carrier, airport, 'cat__{c}_' || CAST({c} AS STRING) AS feature FROM s "
    f"WHERE CAST({c} AS STRING) IN (SELECT DISTINCT CAST({c} AS STRING) FROM s WHERE split = 'train')"
    for c in CATS)))
def q_one_hot(spark, sf):
    df = split_weather(spark, sf)
    model = MD.fit_encoder(df.where("split = 'train'"), S.FEATURES_REFERENCE)
    return EN.one_hot_long(model, df, CATS, KEYS)


IMPUTE_NUM = ["arr_delay", "carrier_delay", "weather_delay", "avg_delay_per_flight", "weather_delay_per_flight"]
IMPUTE_CAT = ["carrier", "airport", "month"]


def _fill_sql(c):
    if c in IMPUTE_NUM:
        return f"round(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM flights_eda)), 6) AS {c}__f"
    return (f"coalesce(CAST({c} AS STRING), (SELECT v FROM (SELECT CAST({c} AS STRING) AS v, count(*) AS n FROM flights_eda "
            f"WHERE {c} IS NOT NULL GROUP BY 1) t ORDER BY n DESC, v ASC LIMIT 1)) AS {c}__f")


@query("impute", oracle_with(["flights_eda"], f"""
SELECT {", ".join(KEYS)}, {", ".join(_fill_sql(c) for c in IMPUTE_NUM + IMPUTE_CAT)} FROM flights_eda"""))
def q_impute(spark, sf):
    df = flights_eda(spark, sf)
    stage = EN.fill_stage(EN.fill_values(df, IMPUTE_NUM, IMPUTE_CAT), IMPUTE_NUM, IMPUTE_CAT)
    return r6(stage.transform(df).select(*KEYS, *[f"{c}__f" for c in IMPUTE_NUM + IMPUTE_CAT]))


# ---------------------------------------------------------------- metrics
def scored(spark, sf):
    f = flights_features(spark, sf)
    return f.select(F.col("high_delay_risk").alias("y"),
                    (F.col("arr_flights") / (F.col("arr_flights") + 10)).alias("p"),
                    F.col("avg_delay_per_flight").alias("y_reg"),
                    (10 * F.col("delay_rate")).alias("yhat"))


@query("metric_auc", oracle_with(["scored"], """
, r AS (SELECT y, CAST(rank() OVER (ORDER BY p) AS DOUBLE) AS rk, CAST(count(*) OVER (PARTITION BY p) AS DOUBLE) AS c FROM scored),
t AS (SELECT sum(CASE WHEN y = 1 THEN rk + (c - 1) / 2 ELSE 0 END) AS sr, CAST(sum(y) AS DOUBLE) AS np,
  CAST(sum(1 - y) AS DOUBLE) AS nn FROM r)
SELECT round(CASE WHEN np > 0 AND nn > 0 THEN (sr - np * (np + 1) / 2) / (np * nn) ELSE 0.5 END, 6) AS auc FROM t"""))
def q_metric_auc(spark, sf):
    return r6(M.auc(scored(spark, sf)))


@query("metric_classification", oracle_with(["scored"], """
, t AS (SELECT count(*) AS n,
  sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN p < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn
  FROM scored)
SELECT round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn FROM t"""))
def q_metric_classification(spark, sf):
    return r6(M.classification_metrics(scored(spark, sf)))


@query("metric_regression", oracle_with(["scored"], """
SELECT round(sqrt(avg((yhat - y_reg) * (yhat - y_reg))), 6) AS rmse, round(avg(abs(yhat - y_reg)), 6) AS mae,
  round(1 - sum((yhat - y_reg) * (yhat - y_reg)) / (var_pop(y_reg) * count(*)), 6) AS r2 FROM scored"""))
def q_metric_regression(spark, sf):
    return r6(M.regression_metrics(scored(spark, sf)))
