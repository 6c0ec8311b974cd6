"""Queries: models, tuning, scoring, attributions, run store, streams.

What a model predicts has no SQL oracle; ``q_checks`` states what must hold
in its rows. Models are trained on the weather-enriched split of the derived
monthly table; fitted models are kept per data directory for the
session so that the scoring/explain queries reuse them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.fixtures import oracle_with
from tarmac.operators import clean as C
from tarmac.operators import explain as H
from tarmac.operators import models as MD
from tarmac.operators import runs as R
from tarmac.operators import score as SC
from tarmac.operators.ensembles import Compiled
from tarmac.plans.catalog import load, query, r6
from tarmac.plans.q_split import _FWS_SQL, split_weather
from tarmac.session import scratch_path
from tarmac.sources import files as IO
from tarmac.streaming import scoring as ST

FEATURES = S.FEATURES_REFERENCE
# Budget of the registered queries: the search has its full number of trials
# and full bounds but for the number of trees (reference space: 200-800; see
# README for the measured time per tree). ``models.SearchSpace()`` and
# ``flows.train_and_log`` default to the full space.
FINAL_GBT = {"n_estimators": 40, "max_depth": 7, "learning_rate": 0.1, "subsample": 0.9,
             "colsample_bytree": 0.9, "min_child_weight": 1, "gamma": 0.0}
SPACE = MD.SearchSpace(ints={"n_estimators": (10, 40), "max_depth": (3, 10), "min_child_weight": (1, 10)})
N_TRIALS = 10

_BUNDLES: dict = {}


def _splits(spark, sf):
    df = split_weather(spark, sf).withColumn("row_id", F.xxhash64(*[F.col(k) for k in ["year", "month", "carrier", "airport"]]))
    return {s: df.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}


class _Bundle:
    """Per data directory, built lazily and kept for the session: split
    tables, the train-fitted encoder with cached encoded splits (for search
    and the baselines of the encoded space), and the two final models."""

    def __init__(self, spark, sf):
        import threading
        self.spark, self.sf, self._cache = spark, sf, {}
        self._locks: dict = {}
        self._guard = threading.Lock()

    def _get(self, key, build):
        import threading
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:                          # one builder per component, others wait
            if key not in self._cache:
                self._cache[key] = build()
        return self._cache[key]

    def models(self):
        """Both final models, fitted concurrently (independent Spark jobs)."""
        from concurrent.futures import ThreadPoolExecutor
        self["parts"]
        with ThreadPoolExecutor(max_workers=2) as ex:
            clf, reg = ex.map(lambda k: self[k], ["clf", "reg"])
        return clf, reg

    def __getitem__(self, key):
        spark, sf = self.spark, self.sf
        if key == "parts":
            return self._get(key, lambda: _splits(spark, sf))
        if key == "enc":
            return self._get(key, lambda: MD.fit_encoder(self["parts"]["train"], FEATURES))
        if key == "encoded":
            return self._get(key, lambda: {s: self["enc"].transform(d).persist() for s, d in self["parts"].items()})
        if key == "clf":
            return self._get(key, lambda: MD.train_final(self["parts"]["train"], self["parts"]["val"], FEATURES,
                                                         S.TARGET_CLASSIFICATION, "classifier", FINAL_GBT))
        if key == "reg":
            return self._get(key, lambda: MD.train_final(self["parts"]["train"], self["parts"]["val"], FEATURES,
                                                         S.TARGET_REGRESSION, "regressor", FINAL_GBT))
        if key in ("clf_sql", "reg_sql"):       # the fitted model as expressions
            kind = "classifier" if key == "clf_sql" else "regressor"
            return self._get(key, lambda: Compiled.of(self[key[:3]], FEATURES, kind))
        raise KeyError(key)


def bundle(spark, sf):
    k = (spark.sparkContext.applicationId, sf)
    if k not in _BUNDLES:
        _BUNDLES[k] = _Bundle(spark, sf)
    return _BUNDLES[k]


def _metrics_row(spark, name, metrics: dict):
    rows = [(name, k, float(v) if v is not None else None) for k, v in sorted(metrics.items())]
    return spark.createDataFrame(rows, "model string, metric string, value double")


# ---------------------------------------------------------------- features
@query("feature_projection", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + f"""
SELECT {", ".join(f"round({c}, 6) AS {c}" if c not in S.CATEGORICAL_COLUMNS else c for c in FEATURES)} FROM s"""))
def q_feature_projection(spark, sf):
    return r6(C.feature_projection(split_weather(spark, sf), "reference"))


_NAMES_SQL = " UNION ALL ".join(
    [f"SELECT 0 AS grp, {i} AS ci, 'num__{c}' AS feature, '' AS v" for i, c in enumerate(S.numeric_part(FEATURES))]
    + [f"SELECT DISTINCT 1 AS grp, {i} AS ci, 'cat__{c}_' || CAST({c} AS STRING) AS feature, CAST({c} AS STRING) AS v "
       f"FROM s WHERE split = 'train'" for i, c in enumerate(S.categorical_part(FEATURES))])


@query("feature_names", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + f"""
, names AS ({_NAMES_SQL})
SELECT CAST(row_number() OVER (ORDER BY grp, ci, v) - 1 AS INT) AS position, feature FROM names"""))
def q_feature_names(spark, sf):
    b = bundle(spark, sf)
    names = MD.encoded_names(b["enc"], FEATURES)
    return spark.createDataFrame(list(enumerate(names)), "position int, feature string")


# ---------------------------------------------------------------- models
def _baseline_splits(spark, sf):
    """Strict-cleaned data with extended rates and the target, split."""
    from tarmac.fixtures import materialised
    from tarmac.operators import split as SP
    from tarmac.plans.q_flights import flights_eda

    def build():
        df = flights_eda(spark, sf).withColumn(
            S.TARGET_CLASSIFICATION, (F.col("delay_rate") > S.HIGH_DELAY_RATE_THRESHOLD).cast("int"))
        return SP.stratified_split(df)
    df = materialised(spark, f"split_eda:{sf}", build)
    return {s: df.where(F.col("split") == s).drop("split") for s in ("train", "test")}


@query("model_logreg")
def q_model_logreg(spark, sf):
    """M1: balanced logistic regression on the baseline classifier features."""
    parts = _baseline_splits(spark, sf)
    enc = MD.fit_baseline_encoder(parts["train"], S.BASELINE_CATEGORICAL, S.BASELINE_NUMERIC_CLF)
    tr = MD.balanced_weights(MD.with_label(enc.transform(parts["train"]), S.TARGET_CLASSIFICATION), "label")
    m = MD.logreg(float(tr.count())).fit(tr)
    te = MD.with_label(enc.transform(parts["test"]), S.TARGET_CLASSIFICATION)
    return _metrics_row(spark, "logistic_regression", MD.evaluate(m, te, "classifier"))


@query("model_linreg")
def q_model_linreg(spark, sf):
    """M2: ordinary least squares on the baseline regressor features."""
    parts = _baseline_splits(spark, sf)
    enc = MD.fit_baseline_encoder(parts["train"], S.BASELINE_CATEGORICAL, S.BASELINE_NUMERIC_REG)
    tr = MD.with_label(enc.transform(parts["train"]), S.TARGET_REGRESSION)
    m = MD.linreg().fit(tr)
    te = MD.with_label(enc.transform(parts["test"]), S.TARGET_REGRESSION)
    return _metrics_row(spark, "linear_regression", MD.evaluate(m, te, "regressor"))


@query("model_gbt_classifier")
def q_model_gbt_classifier(spark, sf):
    b = bundle(spark, sf)
    te = b["parts"]["test"]
    return _metrics_row(spark, "gbt_classifier", MD.evaluate(b["clf"], MD.with_label(te, S.TARGET_CLASSIFICATION),
                                                             "classifier"))


@query("model_gbt_regressor")
def q_model_gbt_regressor(spark, sf):
    b = bundle(spark, sf)
    te = b["parts"]["test"]
    return _metrics_row(spark, "gbt_regressor", MD.evaluate(b["reg"], MD.with_label(te, S.TARGET_REGRESSION),
                                                            "regressor"))


def _tune(spark, sf, kind, target):
    b = bundle(spark, sf)

    def search():
        tr, va = (MD.with_label(b["encoded"][part], target) for part in ("train", "val"))
        return MD.tune(tr, va, kind, MD.sample_params(SPACE, N_TRIALS, MD.SEED), parallelism=4)
    res = b._get(f"search {kind}", search)      # once a session, like the models
    best = MD.best_trial(res, kind)
    df = MD.trials_frame(spark, res, kind)
    return df.withColumn("is_best", (F.col("trial") == best["trial"]).cast("int"))


@query("tune_classifier")
def q_tune_classifier(spark, sf):
    return _tune(spark, sf, "classifier", S.TARGET_CLASSIFICATION)


@query("tune_regressor")
def q_tune_regressor(spark, sf):
    return _tune(spark, sf, "regressor", S.TARGET_REGRESSION)


@query("train_final")
def q_train_final(spark, sf):
    """M7 for both models: final fit on train+val, test metrics, one logged
    run per model (closed even on failure) and the model saved."""
    b = bundle(spark, sf)
    b.models()
    runs_path = scratch_path(spark, "runs")
    for kind, target in (("classifier", S.TARGET_CLASSIFICATION), ("regressor", S.TARGET_REGRESSION)):
        model_path = scratch_path(spark, f"model_{kind}")
        te = MD.with_label(b["parts"]["test"], target)
        with R.logged_run(spark, runs_path, f"gbt_{kind}_weather", FINAL_GBT) as run:
            model = b["clf" if kind == "classifier" else "reg"]
            run.metrics = {f"test_{k}": v for k, v in MD.evaluate(model, te, kind).items()}
            MD.save_model(model, model_path)
            run.model_path = model_path
    return spark.read.parquet(runs_path).select(
        "run_name", "status", F.explode("metrics").alias("metric", "value"))


@query("model_roundtrip", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + """
SELECT count(*) AS rows, count(*) AS identical FROM s WHERE split = 'test'"""))
def q_model_roundtrip(spark, sf):
    b = bundle(spark, sf)
    path = scratch_path(spark, "model_reg")
    MD.save_model(b["reg"], path)
    loaded = MD.load_model(spark, path)
    te = b["parts"]["test"]
    a = b["reg"].transform(te).select("row_id", F.col("prediction").alias("p1"))
    c = loaded.transform(te).select("row_id", F.col("prediction").alias("p2"))
    return a.join(c, "row_id").agg(F.count(F.lit(1)).alias("rows"),
                                   F.sum((F.col("p1") == F.col("p2")).cast("long")).alias("identical"))


# ---------------------------------------------------------------- requests
_VALID_SQL = f"""
SELECT request_id,
  CASE WHEN year IS NULL OR year < 1980 OR year > 2100 OR month IS NULL OR month < 1 OR month > 12
    OR carrier IS NULL OR carrier_name IS NULL OR airport IS NULL OR airport_name IS NULL OR abs(arr_flights) >= 9223372036854775808.0
    THEN 0 ELSE 1 END AS valid,
  (CASE WHEN year IS NULL OR year < 1980 OR year > 2100 THEN 1 ELSE 0 END
   + CASE WHEN month IS NULL OR month < 1 OR month > 12 THEN 1 ELSE 0 END
   + CASE WHEN carrier IS NULL THEN 1 ELSE 0 END + CASE WHEN carrier_name IS NULL THEN 1 ELSE 0 END
   + CASE WHEN airport IS NULL THEN 1 ELSE 0 END + CASE WHEN airport_name IS NULL THEN 1 ELSE 0 END
   + CASE WHEN abs(arr_flights) >= 9223372036854775808.0 THEN 1 ELSE 0 END) AS n_errors,
  {", ".join(f"CAST(CASE WHEN {c} IS NULL OR {c} < 0 OR {c} >= 9223372036854775808.0 THEN 0 ELSE trunc({c}) END AS BIGINT) AS {c}" for c in S.COUNT_COLUMNS)},
  {", ".join(f"round(CASE WHEN {c} IS NULL OR {c} < 0 THEN 0.0 ELSE {c} END, 6) AS {c}" for c in S.DELAY_COLUMNS)},
  {", ".join(f"round(coalesce({c}, 0.0), 6) AS {c}" for c in S.WEATHER_COLUMNS)}
FROM score_requests"""


def _validated_out(df):
    return r6(df.select("request_id", F.col("valid").cast("int").alias("valid"),
                        F.size("errors").cast("int").alias("n_errors"),
                        *S.COUNT_COLUMNS, *S.DELAY_COLUMNS, *S.WEATHER_COLUMNS))


@query("validate_requests", oracle_with(["score_requests"], _VALID_SQL))
def q_validate_requests(spark, sf):
    return _validated_out(SC.validate_requests(load(spark, sf, "score_requests")))


@query("score_batch")
def q_score_batch(spark, sf):
    b = bundle(spark, sf)
    return SC.score_batch(load(spark, sf, "score_requests"), b["clf_sql"], b["reg_sql"])


@query("score_batch_risk")
def q_score_batch_risk(spark, sf):
    b = bundle(spark, sf)
    return SC.score_batch_risk(load(spark, sf, "score_requests"), b["clf_sql"], b["reg_sql"])


# ---------------------------------------------------------------- attributions
def _trees(spark, sf, kind):
    """The model, its node table and its feature names."""
    b = bundle(spark, sf)
    model = b["clf"] if kind == "classifier" else b["reg"]
    gpath = scratch_path(spark, f"gbt_{kind}")
    model.stages[-1].write().overwrite().save(gpath)
    names = spark.createDataFrame(list(enumerate(MD.encoded_names(model, FEATURES))), "feature_index int, feature string")
    return model, H.tree_nodes(spark, gpath), names


def _shap(spark, sf, kind="classifier", rows=None):
    """Attributions of the training rows, or of ``rows`` of them."""
    model, nodes, names = _trees(spark, sf, kind)
    rows = bundle(spark, sf)["parts"]["train"] if rows is None else rows
    attr, base = H.shap_values(model.transform(rows), nodes, "row_id", "features", 2.0 if kind == "classifier" else 1.0)
    return attr.join(F.broadcast(names), "feature_index"), base


@query("shap_values")
def q_shap_values(spark, sf):
    attr, base = _shap(spark, sf, "classifier")
    return attr.select("row_id", "feature", "value", F.lit(base).alias("base_value"))


@query("explain_one")
def q_explain_one(spark, sf):
    train = bundle(spark, sf)["parts"]["train"]
    attr, base = _shap(spark, sf, "regressor", train.join(H.pick_one(train.select("row_id")), "row_id"))
    return (attr.select("row_id", "feature", "value", F.lit(base).alias("base_value"))
                .orderBy(F.abs("value").desc(), "feature"))


@query("tree_gain")
def q_tree_gain(spark, sf):
    _, nodes, names = _trees(spark, sf, "classifier")
    names = names.select(F.col("feature_index").alias("feature"), F.col("feature").alias("feature_name"))
    return H.tree_gain(nodes, names)


@query("importance_mean_abs", oracle_with(["attributions"], """
SELECT feature, round(sum(abs(value)) / (SELECT count(DISTINCT row_id) FROM attributions), 6) AS importance
FROM attributions GROUP BY feature"""))
def q_importance_mean_abs(spark, sf):
    return r6(H.mean_abs_importance(load(spark, sf, "attributions")))


@query("importance_topk", oracle_with(["importance_a"], """
SELECT feature, round(importance, 6) AS importance FROM importance_a ORDER BY importance DESC, feature LIMIT 20"""))
def q_importance_topk(spark, sf):
    """W2 + S18: top-20 written as a CSV report and read back."""
    path = scratch_path(spark, "top20_csv")
    IO.write_csv(H.top_k(load(spark, sf, "importance_a"), 20), path)
    return r6(spark.read.schema("feature string, importance double").option("header", True).csv(path))


@query("shap_importance_top20")
def q_shap_importance_top20(spark, sf):
    """H1 -> A18 -> W2 on the trained classifier: mean |SHAP| per encoded
    feature over the training rows, 20 largest."""
    attr, _ = _shap(spark, sf, "classifier")
    return H.top_k(H.mean_abs_importance(attr, "row_id", "feature", "value", bundle(spark, sf)["parts"]["train"].count()), 20)


_CMP_SQL = """
, ta AS (SELECT * FROM importance_a ORDER BY importance DESC, feature LIMIT 20),
tb AS (SELECT * FROM importance_b ORDER BY importance DESC, feature LIMIT 20),
cmp AS (SELECT coalesce(ta.feature, tb.feature) AS feature, coalesce(ta.importance, 0.0) AS clf_importance,
  coalesce(tb.importance, 0.0) AS reg_importance FROM ta FULL OUTER JOIN tb ON ta.feature = tb.feature)
"""


def _cmp(spark, sf):
    return H.compare(H.top_k(load(spark, sf, "importance_a"), 20), H.top_k(load(spark, sf, "importance_b"), 20))


@query("importance_compare", oracle_with(["importance_a", "importance_b"], _CMP_SQL + """
SELECT feature, round(clf_importance, 6) AS clf_importance, round(reg_importance, 6) AS reg_importance FROM cmp"""))
def q_importance_compare(spark, sf):
    return r6(_cmp(spark, sf))


@query("importance_overview", oracle_with(["importance_a", "importance_b"], _CMP_SQL + """
SELECT (SELECT feature FROM cmp ORDER BY clf_importance DESC, feature DESC LIMIT 1) AS clf_top_feature,
  round(max(clf_importance), 6) AS clf_top_score,
  (SELECT feature FROM cmp ORDER BY reg_importance DESC, feature DESC LIMIT 1) AS reg_top_feature,
  round(max(reg_importance), 6) AS reg_top_score,
  count(CASE WHEN clf_importance > 0 AND reg_importance > 0 THEN 1 END) AS consensus_features
FROM cmp"""))
def q_importance_overview(spark, sf):
    return r6(H.overview(_cmp(spark, sf)))


# ---------------------------------------------------------------- run store
RUN_METRICS = ["test_auc", "test_rmse"]
RUN_PARAMS = ["model_type"]
RUN_TAGS = ["mlflow.runName", "stage", "task"]


def _runs_wide(spark, sf):
    fx = load(spark, sf, "runs_fx").withColumnRenamed("run_name", "mlflow.runName")
    root = scratch_path(spark, "mlruns")
    R.write_run_files(fx, root, RUN_METRICS, RUN_PARAMS, RUN_TAGS)
    return R.runs_wide(R.runs_long(spark, root), RUN_METRICS, RUN_PARAMS, RUN_TAGS)


@query("runs_from_files", oracle_with(["runs_fx"], """
SELECT run_id, round(test_auc, 6) AS "metrics.test_auc", round(test_rmse, 6) AS "metrics.test_rmse",
  model_type AS "params.model_type", run_name AS "tags.mlflow.runName", stage AS "tags.stage", task AS "tags.task"
FROM runs_fx"""))
def q_runs_from_files(spark, sf):
    return r6(_runs_wide(spark, sf))


_DISPLAY_SQL = """SELECT run_id, run_name, round(test_auc, 6) AS test_auc, round(test_rmse, 6) AS test_rmse, task,
  model_type FROM runs_fx WHERE stage = 'final'"""


@query("runs_display", oracle_with(["runs_fx"], _DISPLAY_SQL))
def q_runs_display(spark, sf):
    return r6(R.runs_display(_table_wide(spark, sf)))


@query("best_runs", oracle_with(["runs_fx"], """
, d AS (""" + _DISPLAY_SQL + """)
SELECT * FROM (SELECT 'classifier' AS model, * FROM d WHERE test_auc IS NOT NULL ORDER BY test_auc DESC, run_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'regressor' AS model, * FROM d WHERE test_rmse IS NOT NULL ORDER BY test_rmse, run_id LIMIT 1)"""))
def q_best_runs(spark, sf):
    d = R.runs_display(_table_wide(spark, sf))
    c = R.best_run(d, "test_auc", True).select(F.lit("classifier").alias("model"), *d.columns)
    r = R.best_run(d, "test_rmse", False).select(F.lit("regressor").alias("model"), *d.columns)
    return r6(c.unionByName(r))


@query("model_summary", oracle_with(["runs_fx"], """
, d AS (""" + _DISPLAY_SQL + """)
SELECT * FROM (SELECT 'classifier' AS model, 'classification (high_delay_risk)' AS task, run_id, run_name,
  'test_auc' AS metric, test_auc AS value FROM d WHERE test_auc IS NOT NULL ORDER BY test_auc DESC, run_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'regressor' AS model, 'regression (avg_delay_per_flight, lower is better)' AS task,
  run_id, run_name, 'test_rmse' AS metric, test_rmse AS value FROM d
  WHERE test_rmse IS NOT NULL ORDER BY test_rmse, run_id LIMIT 1)"""))
def q_model_summary(spark, sf):
    return r6(R.model_summary(R.runs_display(_table_wide(spark, sf))))


def _runs_table(spark, sf):
    """Every derived run appended as one row of the Parquet runs table."""
    path = scratch_path(spark, "runs_tbl")
    fx = load(spark, sf, "runs_fx")
    metrics = F.map_filter(F.create_map(F.lit("test_auc"), F.col("test_auc"), F.lit("test_rmse"), F.col("test_rmse")),
                           lambda k, v: v.isNotNull())
    rows = fx.select("run_id", "run_name", F.lit("FINISHED").alias("status"),
                     F.create_map(F.lit("model_type"), F.col("model_type")).alias("params"),
                     metrics.alias("metrics"),
                     F.create_map(F.lit("stage"), F.col("stage"), F.lit("task"), F.col("task")).alias("tags"),
                     F.lit(None).cast("string").alias("model_path"))
    rows.write.mode("append").parquet(path)
    return spark.read.schema(S.RUNS).parquet(path)


def _table_wide(spark, sf):
    return R.runs_table_wide(_runs_table(spark, sf), RUN_METRICS, RUN_PARAMS, RUN_TAGS)


@query("runs_append", oracle_with(["runs_fx"], """
SELECT run_id, run_name, 'FINISHED' AS status, round(test_auc, 6) AS test_auc, round(test_rmse, 6) AS test_rmse
FROM runs_fx"""))
def q_runs_append(spark, sf):
    back = _runs_table(spark, sf)
    return r6(back.select("run_id", "run_name", "status", F.col("metrics")["test_auc"].alias("test_auc"),
                          F.col("metrics")["test_rmse"].alias("test_rmse")))


@query("runs_events", oracle_with(["runs_fx"], """
SELECT run_id, run_name, CASE WHEN stage = 'final' THEN 'FINISHED' ELSE 'RUNNING' END AS status,
  round(test_auc, 6) AS test_auc, round(test_rmse, 6) AS test_rmse, model_type FROM runs_fx"""))
def q_runs_events(spark, sf):
    """S16 as events: each run starts, logs each metric twice (first a value
    that the second corrects); only final-stage runs end."""
    fx = load(spark, sf, "runs_fx")
    path = scratch_path(spark, "runs_events")
    text, none = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")

    def events(rows, second, kind, name=text, value=F.lit(None).cast("double"), said=text, params=none, tags=none):
        at = F.timestamp_seconds(F.lit(1_700_000_000 + second))
        (rows.select("run_id", at.alias("at"), F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), said.alias("text"),
                     params.alias("params"), tags.alias("tags")).write.mode("append").parquet(R.events_path(path)))

    events(fx, 0, "start", said=F.col("run_name"), params=F.create_map(F.lit("model_type"), F.col("model_type")))
    for m in ("test_auc", "test_rmse"):
        events(fx, 1, "metric", F.lit(m), F.col(m) + 1)
        events(fx, 2, "metric", F.lit(m), F.col(m))
    events(fx.where("stage = 'final'"), 3, "end", said=F.lit("FINISHED"), tags=F.create_map(F.lit("stage"), F.col("stage")))
    runs = R.runs_current(spark, path)
    return r6(runs.select("run_id", "run_name", "status", F.col("metrics")["test_auc"].alias("test_auc"),
                          F.col("metrics")["test_rmse"].alias("test_rmse"), F.col("params")["model_type"].alias("model_type")))


# ---------------------------------------------------------------- streams
def _land_requests(spark, sf):
    src = scratch_path(spark, "requests_landing")
    load(spark, sf, "score_requests").write.mode("overwrite").json(src)
    return src


@query("stream_score")
def q_stream_score(spark, sf):
    b = bundle(spark, sf)
    src = _land_requests(spark, sf)
    sink, ckpt = scratch_path(spark, "scored_sink"), scratch_path(spark, "scored_ckpt")
    ST.stream_score(spark, src, b["clf_sql"], b["reg_sql"], sink, ckpt)
    return spark.read.parquet(sink)


@query("stream_history", oracle_with(["score_requests"], f"""
, v AS ({_VALID_SQL})
SELECT request_id, CASE WHEN valid = 1 THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN valid = 1 THEN arr_flights END AS arr_flights, n_errors FROM v"""))
def q_stream_history(spark, sf):
    src = _land_requests(spark, sf)
    acc, rej, ckpt = (scratch_path(spark, "accepted"), scratch_path(spark, "rejected"),
                      scratch_path(spark, "accept_ckpt"))
    ST.stream_accept_reject(spark, src, acc, rej, ckpt)
    a = spark.read.parquet(acc).select("request_id", F.lit("accepted").alias("status"), "arr_flights",
                                       F.lit(0).alias("n_errors"))
    r = spark.read.parquet(rej).select("request_id", F.lit("rejected").alias("status"),
                                       F.lit(None).cast("long").alias("arr_flights"),
                                       F.size("errors").cast("int").alias("n_errors"))
    return a.unionByName(r)


@query("stream_resent", oracle_with(["score_requests"], f"""
, v AS ({_VALID_SQL})
SELECT request_id, CASE WHEN valid = 1 THEN 'accepted' ELSE 'rejected' END AS status FROM v"""))
def q_stream_resent(spark, sf):
    """T2 with every request sent twice, the second time to a restarted
    stream: each is stored once."""
    src = _land_requests(spark, sf)
    acc, rej, ckpt = (scratch_path(spark, "accepted"), scratch_path(spark, "rejected"), scratch_path(spark, "resent_ckpt"))
    for _ in range(2):
        ST.stream_accept_reject(spark, src, acc, rej, ckpt)
        load(spark, sf, "score_requests").write.mode("append").json(src)
    ST.stream_accept_reject(spark, src, acc, rej, ckpt)
    return (spark.read.parquet(acc).select("request_id", F.lit("accepted").alias("status"))
            .unionByName(spark.read.parquet(rej).select("request_id", F.lit("rejected").alias("status"))))


@query("stream_history_scored")
def q_stream_history_scored(spark, sf):
    """T2 with scoring: accepted requests become prediction-history rows."""
    b = bundle(spark, sf)
    src = _land_requests(spark, sf)
    acc, rej, ckpt = (scratch_path(spark, "history_sink"), scratch_path(spark, "rejected"),
                      scratch_path(spark, "history_ckpt"))
    ST.stream_accept_reject(spark, src, acc, rej, ckpt, b["clf_sql"], b["reg_sql"])
    return spark.read.parquet(acc).select(*S.HISTORY_COLUMNS, "request_id")
