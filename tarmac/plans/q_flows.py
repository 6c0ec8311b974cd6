"""Queries: the end-to-end flows (data preparation, training, reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.fixtures import oracle_with
from tarmac.operators import models as MD
from tarmac.plans import flows as FL
from tarmac.plans.catalog import load, query, r6
from tarmac.plans.q_models import N_TRIALS, SPACE, bundle
from tarmac.plans.q_split import _FWS_SQL
from tarmac.session import scratch_path

_PREP_COLS = ["year", "month", "carrier", "airport", "split", "high_delay_risk", "delay_rate"] + S.WEATHER_COLUMNS


@query("prepare_datasets", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + f"""
SELECT year, month, carrier, airport, split, high_delay_risk, round(delay_rate, 6) AS delay_rate,
  {", ".join(f"round({c}, 6) AS {c}" for c in S.WEATHER_COLUMNS)} FROM s"""))
def q_prepare_datasets(spark, sf):
    out = scratch_path(spark, "prepared")
    df = FL.prepare_datasets(spark, load(spark, sf, "flights_raw"), load(spark, sf, "weather_daily"), out)
    return r6(df.select(*_PREP_COLS))


@query("train_and_log")
def q_train_and_log(spark, sf):
    """Search, final fit, test metrics, logged runs and saved models."""
    out = scratch_path(spark, "prepared")
    FL.prepare_datasets(spark, load(spark, sf, "flights_raw"), load(spark, sf, "weather_daily"), out)
    runs = FL.train_and_log(spark, f"{out}/splits", scratch_path(spark, "runs"), scratch_path(spark, "models"),
                            SPACE, N_TRIALS, parallelism=4)
    return runs.select("run_name", "status", F.explode("metrics").alias("metric", "value"))


@query("explain_report")
def q_explain_report(spark, sf):
    """Attribution report for the two final models on the training rows."""
    b = bundle(spark, sf)
    models = scratch_path(spark, "models")
    MD.save_model(b["clf"], f"{models}/gbt_classifier")
    MD.save_model(b["reg"], f"{models}/gbt_regressor")
    return FL.explain_report(spark, models, b["parts"]["train"], scratch_path(spark, "reports"))
