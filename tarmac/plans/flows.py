"""End-to-end flows composed from the operators.

* ``prepare_datasets``: raw monthly table -> contract, cleaning, targets ->
  base table -> stratified split -> airport coordinates and monthly weather
  -> feature contract -> one split-partitioned table.
* ``train_and_log``: split table -> encode once -> seeded search per model
  (fixed validation split) -> final fit on train+val -> test metrics -> run
  rows appended (closed even on failure) -> models saved.
* ``explain_report``: saved models -> Tree SHAP on the training rows -> mean
  |SHAP| per feature -> top-k per model -> side-by-side table and overview
  -> CSV reports.

Every step is a Spark job over the whole input; the driver only holds
bounded model parameters and file paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import clean as C
from tarmac.operators import contract as K
from tarmac.operators import explain as H
from tarmac.operators import models as MD
from tarmac.operators import runs as R
from tarmac.operators import split as SP
from tarmac.operators import weather as W
from tarmac.sources import files as IO


def prepare_datasets(spark: SparkSession, flights_raw: DataFrame, daily_weather: DataFrame,
                     out_dir: str, threshold: float = S.HIGH_DELAY_RATE_THRESHOLD,
                     features: list[str] = S.FEATURES_REFERENCE) -> DataFrame:
    """Write ``{out_dir}/base`` and ``{out_dir}/splits`` (partitioned by
    split) and return the split table read back."""
    base = C.prepare_base(flights_raw, threshold)
    IO.write_table(base, f"{out_dir}/base")
    base = IO.read_table(spark, f"{out_dir}/base")          # lineage cut at the landed table
    split = SP.stratified_split(base)
    enriched = W.enrich(split, W.daily_to_monthly(daily_weather))
    K.require_columns(enriched, features + ["split"])         # feature contract before writing
    IO.write_splits(enriched, f"{out_dir}/splits")
    return IO.read_table(spark, f"{out_dir}/splits")


def train_and_log(spark: SparkSession, splits_path: str, runs_path: str, models_dir: str,
                  space: MD.SearchSpace, n_trials: int, parallelism: int = 2,
                  timeout_s: float | None = None, features: list[str] = S.FEATURES_REFERENCE) -> DataFrame:
    """Tune, fit and log both models; returns the runs table."""
    parts = IO.load_splits(spark, splits_path)
    K.require_columns(parts["train"], features + [S.TARGET_CLASSIFICATION, S.TARGET_REGRESSION])
    enc = MD.fit_encoder(parts["train"], features)
    encoded = {s: enc.transform(parts[s]).persist() for s in ("train", "val")}
    try:
        for kind, target in (("classifier", S.TARGET_CLASSIFICATION), ("regressor", S.TARGET_REGRESSION)):
            tr, va = MD.with_label(encoded["train"], target), MD.with_label(encoded["val"], target)
            trials = MD.sample_params(space, n_trials, MD.SEED)
            best = MD.best_trial(MD.tune(tr, va, kind, trials, parallelism, timeout_s), kind)
            path = f"{models_dir}/gbt_{kind}"
            with R.logged_run(spark, runs_path, f"gbt_{kind}_weather", best["params"]) as run:
                model = MD.train_final(parts["train"], parts["val"], features, target, kind, best["params"])
                run.metrics = {f"test_{k}": v for k, v in
                               MD.evaluate(model, MD.with_label(parts["test"], target), kind).items()}
                run.tags = {"stage": "final", "task": kind}
                MD.save_model(model, path)
                run.model_path = path
    finally:
        for d in encoded.values():
            d.unpersist()
    return spark.read.schema(S.RUNS).parquet(runs_path)


def explain_report(spark: SparkSession, models_dir: str, rows: DataFrame, out_dir: str,
                   features: list[str] = S.FEATURES_REFERENCE, k: int = 20,
                   id_col: str = "row_id") -> DataFrame:
    """Attribution reports for both saved models; returns the overview row."""
    tops = {}
    for kind, scale in (("classifier", 2.0), ("regressor", 1.0)):
        model = MD.load_model(spark, f"{models_dir}/gbt_{kind}")
        gpath = f"{out_dir}/trees_{kind}"
        model.stages[-1].write().overwrite().save(gpath)
        attr, _ = H.shap_values(model.transform(rows), H.tree_nodes(spark, gpath), id_col, "features", scale)
        names = spark.createDataFrame(list(enumerate(MD.encoded_names(model, features))),
                                      "feature_index int, feature string")
        imp = H.mean_abs_importance(attr.join(F.broadcast(names), "feature_index"), id_col, "feature", "value", rows.count())
        top = H.top_k(imp, k)
        IO.write_csv(top, f"{out_dir}/top{k}_{kind}")
        tops[kind] = spark.read.schema("feature string, importance double").option("header", True) \
            .csv(f"{out_dir}/top{k}_{kind}")
    cmp = H.compare(tops["classifier"], tops["regressor"])
    IO.write_csv(cmp, f"{out_dir}/cross_impact")
    ov = H.overview(cmp)
    IO.write_csv(ov, f"{out_dir}/overview")
    return ov
