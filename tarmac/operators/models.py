"""Models, seeded search and final training.

The encoder is an MLlib ``PipelineModel`` (population scaler as a
``SQLTransformer`` with the fitted means/stds, multi-column ``StringIndexer``,
``OneHotEncoder``, ``VectorAssembler``), so encoder and model are saved and
loaded together. For tuning the data are encoded once and cached; trials run
concurrently from a driver thread pool, each trial being ordinary Spark jobs.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import metrics as M
from tarmac.operators.encode import fill_stage, fill_values, one_hot_labels, one_hot_stages, scaler_stage

SEED = 42


# --------------------------------------------------------------- encoder
def encoder_stages(train: DataFrame, features: list[str]) -> list:
    num = S.numeric_part(features)
    cat = S.categorical_part(features)
    asm = VectorAssembler(inputCols=[f"{c}__z" for c in num] + [f"{c}__ohe" for c in cat],
                          outputCol="features", handleInvalid="keep")
    return [scaler_stage(train, num), *one_hot_stages(cat), asm]


def baseline_encoder_stages(train: DataFrame, cat_cols: list[str], num_cols: list[str]) -> list:
    """Baseline preprocessing (E4, E5 then E1, E2): most-frequent fill for
    categories, exact median fill for numerics, population scaling, one-hot
    keeping every seen category. Fill values and scaler statistics are
    fitted on ``train`` (one value per column reaches the driver)."""
    impute = fill_stage(fill_values(train, num_cols, cat_cols), num_cols, cat_cols)
    scale = scaler_stage(impute.transform(train), [f"{c}__f" for c in num_cols], "__z")
    asm = VectorAssembler(inputCols=[f"{c}__f__z" for c in num_cols] + [f"{c}__ohe" for c in cat_cols],
                          outputCol="features", handleInvalid="keep")
    return [impute, scale, *one_hot_stages(cat_cols, "__f"), asm]


def fit_baseline_encoder(train: DataFrame, cat_cols: list[str], num_cols: list[str]) -> PipelineModel:
    return Pipeline(stages=baseline_encoder_stages(train, cat_cols, num_cols)).fit(train)


def fit_encoder(train: DataFrame, features: list[str]) -> PipelineModel:
    return Pipeline(stages=encoder_stages(train, features)).fit(train)


def encoded_names(encoder: PipelineModel, features: list[str]) -> list[str]:
    """``num__x`` then ``cat__col_value`` in vector order."""
    num = S.numeric_part(features)
    cat = S.categorical_part(features)
    labels = one_hot_labels(encoder)
    return [f"num__{c}" for c in num] + [f"cat__{c}_{v}" for i, c in enumerate(cat) for v in labels[i]]


# --------------------------------------------------------------- models
def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (2 * n_class)`` per row (class counts: two numbers)."""
    cnt = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(cnt.values())
    w = F.lit(1.0)
    for k, v in cnt.items():
        w = F.when(F.col(label) == k, F.lit(n / (2.0 * v))).otherwise(w)
    return df.withColumn("weight", w)


def logreg(n_rows: float, C: float = 1.0, max_iter: int = 1000) -> LogisticRegression:
    """L2 logistic regression; sklearn's C on the summed loss is regParam
    1/(C*n) on Spark's averaged loss. Inputs are already scaled."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                              maxIter=max_iter, regParam=1.0 / (C * n_rows), elasticNetParam=0.0,
                              standardization=False)


def linreg() -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol="label", solver="normal", regParam=0.0)


# Reference hyper-parameter names -> MLlib GBT parameters (see README).
def gbt(kind: str, params: dict, label_variance: float | None = None) -> GBTClassifier | GBTRegressor:
    """``gamma`` is a loss reduction summed over a node's rows in units of the
    loss; MLlib's gain is a mean variance reduction. It is therefore taken per
    thousand rows and in units of the label's variance, so that the same draw
    asks the same share of variance of both models."""
    cls = GBTClassifier if kind == "classifier" else GBTRegressor
    kw = dict(featuresCol="features", labelCol="label", seed=SEED,
              maxIter=int(params.get("n_estimators", 20)),
              maxDepth=int(params.get("max_depth", 5)),
              stepSize=float(params.get("learning_rate", 0.1)),
              subsamplingRate=float(params.get("subsample", 1.0)),
              featureSubsetStrategy=str(float(params.get("colsample_bytree", 1.0))),
              minInstancesPerNode=int(params.get("min_child_weight", 1)),
              minInfoGain=float(params.get("gamma", 0.0)) * 1e-3 * (1.0 if label_variance is None else label_variance),
              # node ids cached per row (checkpointed every 10 trees into the
              # shared checkpoint folder) instead of re-descending every tree
              cacheNodeIds=True, checkpointInterval=10)
    if kind != "classifier":
        kw["lossType"] = "squared"
    return cls(**kw)


def with_label(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", F.col(target).cast("double"))


def prob1(df: DataFrame, col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def label_variance(df: DataFrame) -> float:
    return df.agg(F.var_pop("label")).first()[0] or 1.0


# --------------------------------------------------------------- search
@dataclass
class SearchSpace:
    """Bounds of the seeded random search (ints inclusive; log-uniform marked).
    Fixed values: names and bounds equal the analysed pipeline's."""
    ints: dict = field(default_factory=lambda: {"n_estimators": (200, 800), "max_depth": (3, 10),
                                                "min_child_weight": (1, 10)})
    floats: dict = field(default_factory=lambda: {"learning_rate": (0.01, 0.3, True), "subsample": (0.5, 1.0, False),
                                                  "colsample_bytree": (0.5, 1.0, False), "gamma": (0.0, 5.0, False),
                                                  "reg_lambda": (1e-3, 10.0, True), "reg_alpha": (1e-3, 10.0, True)})


def sample_params(space: SearchSpace, n_trials: int, seed: int = SEED) -> list[dict]:
    """Seeded draws (M5); reg_lambda/reg_alpha are drawn and logged but have
    no MLlib counterpart."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_trials):
        p = {k: int(rng.integers(lo, hi + 1)) for k, (lo, hi) in space.ints.items()}
        for k, (lo, hi, log) in space.floats.items():
            p[k] = float(math.exp(rng.uniform(math.log(lo), math.log(hi)))) if log else float(rng.uniform(lo, hi))
        out.append(p)
    return out


def evaluate(model, df: DataFrame, kind: str) -> dict:
    pred = model.transform(df)
    if kind == "classifier":
        sc = pred.select(F.col("label").cast("int").alias("y"), prob1(pred).alias("p"))
        a = M.auc(sc).first()["auc"]
        c = M.classification_metrics(sc).first()
        return {"auc": a, "accuracy": c["accuracy"], "recall": c["recall"]}
    sc = pred.select(F.col("label").alias("y_reg"), F.col("prediction").alias("yhat"))
    r = M.regression_metrics(sc).first()
    return {"rmse": r["rmse"], "mae": r["mae"], "r2": r["r2"]}


def tune(train_enc: DataFrame, val_enc: DataFrame, kind: str, trials: list[dict],
         parallelism: int = 2, timeout_s: float | None = None) -> list[dict]:
    """Fixed-validation search (M6): every trial fits on the cached encoded
    train set and is scored on the validation set (AUC max / RMSE min). With
    ``timeout_s`` no new trial starts after the deadline (running ones finish)."""
    import time
    deadline = time.monotonic() + timeout_s if timeout_s is not None else None
    variance = label_variance(train_enc)

    def run(i_p):
        i, p = i_p
        if deadline is not None and time.monotonic() > deadline:
            return None
        m = gbt(kind, p, variance).fit(train_enc)
        return {"trial": i, "params": p, **evaluate(m, val_enc, kind)}

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        res = [r for r in ex.map(run, enumerate(trials)) if r is not None]
    if not res:
        raise TimeoutError("no trial finished before the deadline")
    return res


def best_trial(results: list[dict], kind: str) -> dict:
    if kind == "classifier":
        return max(results, key=lambda r: (r["auc"], -r["trial"]))
    return min(results, key=lambda r: (r["rmse"], r["trial"]))


def trials_frame(spark, results: list[dict], kind: str) -> DataFrame:
    metric = "auc" if kind == "classifier" else "rmse"
    rows = [(r["trial"], json.dumps(r["params"], sort_keys=True), float(r[metric])) for r in results]
    return spark.createDataFrame(rows, f"trial int, params string, val_{metric} double")


def same_encoder(a: PipelineModel, b: PipelineModel) -> bool:
    """Whether two models' encoder stages are equal (statements of the SQL
    stages, category lists, column names)."""
    def of(m):
        return [(type(s).__name__, s.getStatement() if isinstance(s, SQLTransformer) else
                 [list(x) for x in s.labelsArray] if hasattr(s, "labelsArray") else s.getOrDefault(s.inputCols)) for s in m.stages[:-1]]
    return of(a) == of(b)


def train_final(train: DataFrame, val: DataFrame, features: list[str], target: str, kind: str,
                params: dict) -> PipelineModel:
    """M7: encoder + GBT fitted on train+val, as one saveable PipelineModel."""
    full = with_label(train.unionByName(val), target)
    stages = encoder_stages(full, features) + [gbt(kind, params, label_variance(full))]
    return Pipeline(stages=stages).fit(full)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark, path: str) -> PipelineModel:
    from tarmac.session import path_exists
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)
