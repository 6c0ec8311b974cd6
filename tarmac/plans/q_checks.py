"""Invariants of the model queries, row by row, that SQL can decide.

What a fitted model predicts isn't SQL; which rows must come out, and what
must hold in each of them, is. Every query returns its rows with a 1 where the
invariant holds; the statement lists the same rows with 1s.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.fixtures import oracle_with
from tarmac.operators import models as MD
from tarmac.plans import q_models as Q
from tarmac.plans.catalog import query
from tarmac.plans.q_split import _FWS_SQL

KEYS = ["year", "month", "carrier", "airport"]
_V = f"\n, v AS ({Q._VALID_SQL})\n"


def flag(cond) -> F.Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def score_flags(scored: DataFrame) -> DataFrame:
    """Probability in [0, 1], label = (p >= 0.5), finite minutes."""
    p, y = F.col("high_delay_risk_proba"), F.col("avg_delay_per_flight")
    return scored.select("request_id", flag(p.between(0, 1)).alias("p_ok"),
                         flag(F.col("high_delay_risk_label") == (p >= S.LABEL_CUT).cast("int")).alias("label_ok"),
                         flag(~F.isnan(y) & (F.abs(y) < float("inf"))).alias("minutes_ok"))


@query("check_score_batch", oracle_with(["score_requests"], _V + """
SELECT request_id, 1 AS p_ok, 1 AS label_ok, 1 AS minutes_ok FROM v WHERE valid = 1"""))
def q_check_score_batch(spark, sf):
    return score_flags(Q.q_score_batch(spark, sf))


@query("check_score_batch_risk", oracle_with(["score_requests"], _V + """
SELECT request_id, arr_flights, arr_del15, 1 AS risk_ok FROM v WHERE valid = 1"""))
def q_check_score_batch_risk(spark, sf):
    out = Q.q_score_batch_risk(spark, sf)
    high = F.col("high_delay_probability") >= S.LABEL_CUT
    return out.select("request_id", F.col("arr_flights").cast("long").alias("arr_flights"), F.col("arr_del15").cast("long").alias("arr_del15"),
                      flag((F.col("risk_level") == "HIGH") == high).alias("risk_ok"))


@query("check_stream_score", oracle_with(["score_requests"], _V + """
SELECT request_id, 1 AS same FROM v WHERE valid = 1"""))
def q_check_stream_score(spark, sf):
    """The stream's rows are the batch's, value by value."""
    cols = ["high_delay_risk_proba", "high_delay_risk_label", "avg_delay_per_flight"]
    batch = Q.q_score_batch(spark, sf).select("request_id", F.struct(*cols).alias("batch"))
    stream = Q.q_stream_score(spark, sf).select("request_id", F.struct(*cols).alias("stream"))
    return batch.join(stream, "request_id", "full").select("request_id", flag(F.col("batch") == F.col("stream")).alias("same"))


@query("check_stream_history_scored", oracle_with(["score_requests"], _V + """
SELECT request_id, year, month, arr_flights, 1 AS label_ok FROM v JOIN (SELECT request_id AS rid, year, month FROM score_requests) r
  ON rid = request_id WHERE valid = 1"""))
def q_check_stream_history_scored(spark, sf):
    out = Q.q_stream_history_scored(spark, sf)
    ok = F.col("high_delay_risk_label") == (F.col("high_delay_risk_proba") >= S.LABEL_CUT).cast("int")
    return out.select("request_id", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "arr_flights",
                      flag(ok & F.col("timestamp").isNotNull()).alias("label_ok"))


def additive(rows: DataFrame, attr: DataFrame, base: float, margin) -> DataFrame:
    """Keys of ``rows`` and whether base + sum of attributions = margin."""
    sums = attr.groupBy("row_id").agg(F.sum("value").alias("total"))
    return rows.join(sums, "row_id", "left").select(
        *KEYS, flag(F.abs(F.lit(base) + F.coalesce("total", F.lit(0.0)) - margin) < 1e-6).alias("additive"))


_TRAIN = "SELECT year, month, carrier, airport, 1 AS additive FROM s WHERE split = 'train'"


@query("check_shap_values", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + _TRAIN))
def q_check_shap_values(spark, sf):
    attr, base = Q._shap(spark, sf, "classifier")
    b = Q.bundle(spark, sf)
    return additive(b["clf"].transform(b["parts"]["train"]), attr, base, vector_to_array("rawPrediction")[1] * 2.0)


@query("check_explain_one", oracle_with(["flights_features"], "SELECT 1 AS rows_explained, 1 AS additive"))
def q_check_explain_one(spark, sf):
    b = Q.bundle(spark, sf)
    out = Q.q_explain_one(spark, sf)
    total = out.groupBy("row_id").agg((F.sum("value") + F.first("base_value")).alias("m"))
    pred = b["reg"].transform(b["parts"]["train"]).select("row_id", "prediction")
    return total.join(pred, "row_id").agg(F.count(F.lit(1)).cast("int").alias("rows_explained"),
                                          F.min(flag(F.abs(F.col("m") - F.col("prediction")) < 1e-6)).alias("additive"))


@query("check_tree_gain", oracle_with(["flights_features"], "SELECT 1 AS splits_ok, 1 AS gain_ok, 1 AS names_ok"))
def q_check_tree_gain(spark, sf):
    """Split counts add up to the internal nodes of the trees."""
    model, nodes, names = Q._trees(spark, sf, "classifier")
    inner = sum((t.numNodes - 1) // 2 for t in model.stages[-1].trees)
    return Q.q_tree_gain(spark, sf).agg(flag(F.sum("n_splits") == inner).alias("splits_ok"), F.min(flag(F.col("total_gain") > -1e-6)).alias("gain_ok"),
                                        F.min(flag(F.col("feature_name").isNotNull())).alias("names_ok"))


@query("check_train_final", oracle_with(["flights_features"], """
SELECT * FROM (VALUES ('gbt_classifier_weather', 'FINISHED', 'test_accuracy', 1), ('gbt_classifier_weather', 'FINISHED', 'test_auc', 1),
  ('gbt_classifier_weather', 'FINISHED', 'test_recall', 1), ('gbt_regressor_weather', 'FINISHED', 'test_mae', 1),
  ('gbt_regressor_weather', 'FINISHED', 'test_r2', 1), ('gbt_regressor_weather', 'FINISHED', 'test_rmse', 1)) t(run_name, status, metric, finite)"""))
def q_check_train_final(spark, sf):
    v = F.col("value")
    return Q.q_train_final(spark, sf).select("run_name", "status", "metric", flag(~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"))


def _trials(name, metric, kind, low, high):
    @query(f"check_tune_{kind}", oracle_with(["flights_features"], f"SELECT CAST(i AS INT) AS trial, 1 AS metric_ok, 1 AS one_best FROM range({Q.N_TRIALS}) t(i)"))
    def q(spark, sf):
        out = getattr(Q, f"q_{name}")(spark, sf)
        best = out.agg(F.sum("is_best")).scalar()
        return out.select("trial", flag(F.col(metric).between(low, high)).alias("metric_ok"), flag(best == 1).alias("one_best"))
    return q


_trials("tune_classifier", "val_auc", "classifier", 0.5, 1.0)
_trials("tune_regressor", "val_rmse", "regressor", 0.0, 1e9)


def normal_equations(model, rows: DataFrame) -> DataFrame:
    """One row: whether the residuals of a least-squares fit sum to zero alone
    and against every feature (relative to the sizes involved)."""
    fit = model.transform(rows).select("label", "prediction", vector_to_array("features").alias("x"))
    r = F.col("label") - F.col("prediction")
    per = fit.select(r.alias("r"), F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x"))).alias("i", "v"))
    sums = per.groupBy("i").agg(F.abs(F.sum(F.col("r") * F.col("v"))).alias("dot"), F.sum(F.abs(F.col("r") * F.col("v"))).alias("size"))
    return sums.agg(F.min(flag(F.col("dot") <= 1e-6 * F.col("size") + 1e-9)).alias("orthogonal"))


@query("check_model_linreg", oracle_with(["flights_features"], "SELECT 1 AS orthogonal"))
def q_check_model_linreg(spark, sf):
    parts = Q._baseline_splits(spark, sf)
    enc = MD.fit_baseline_encoder(parts["train"], S.BASELINE_CATEGORICAL, S.BASELINE_NUMERIC_REG)
    tr = MD.with_label(enc.transform(parts["train"]), S.TARGET_REGRESSION)
    return normal_equations(MD.linreg().fit(tr), tr)


@query("check_model_logreg", oracle_with(["flights_features"], "SELECT 1 AS stationary"))
def q_check_model_logreg(spark, sf):
    """At the optimum the weighted residuals equal the penalty's pull on every
    coefficient, and sum to zero for the intercept."""
    parts = Q._baseline_splits(spark, sf)
    enc = MD.fit_baseline_encoder(parts["train"], S.BASELINE_CATEGORICAL, S.BASELINE_NUMERIC_CLF)
    tr = MD.balanced_weights(MD.with_label(enc.transform(parts["train"]), S.TARGET_CLASSIFICATION), "label")
    model = MD.logreg(float(tr.count())).fit(tr)
    p = model.transform(tr).select("label", "weight", vector_to_array("probability")[1].alias("p"), vector_to_array("features").alias("x"))
    r = F.col("weight") * (F.col("p") - F.col("label"))
    per = p.select(r.alias("r"), "weight", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x"))).alias("i", "v"))
    grad = per.groupBy("i").agg((F.sum(F.col("r") * F.col("v")) / F.sum("weight")).alias("g"))
    pull = spark.createDataFrame([(0, 0.0)] + [(i + 1, float(c) * model.getRegParam()) for i, c in enumerate(model.coefficients)], "i int, pull double")
    return grad.join(pull, "i").agg(F.min(flag(F.abs(F.col("g") + F.col("pull")) < 1e-3)).alias("stationary"))
