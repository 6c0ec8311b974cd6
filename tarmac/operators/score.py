"""Request validation and batch scoring.

Scoring is one ``PipelineModel.transform`` over any number of rows; nothing is
scored row by row.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import schema as S
from tarmac.functions import exprs as X
from tarmac.operators.clean import mandatory_features
from tarmac.operators import models as MD
from tarmac.operators.ensembles import Compiled
from tarmac.operators.models import prob1

CORRUPT = "_corrupt"
STRINGS = ["carrier", "carrier_name", "airport", "airport_name"]


def validate_requests(req: DataFrame) -> DataFrame:
    """Typed request contract. Adds ``errors array<string>`` and ``valid``.

    year 1980..2100 and month 1..12 are required; the four names are
    required; counts: null or negative -> 0, else truncated to an integer;
    delays: null or negative -> 0.0; weather: absent -> 0.0. A count that no
    bigint holds, an infinite number and a record whose fields have the wrong
    type (``_corrupt``, filled by the readers) are errors of that request;
    the job goes on.
    """
    def rng(c, lo, hi):
        return (F.when(F.col(c).isNull(), F.lit(f"{c}: missing"))
                 .when((F.col(c) < lo) | (F.col(c) > hi), F.lit(f"{c}: out of range [{lo}, {hi}]")))
    checks = [rng("year", S.YEAR_MIN, S.YEAR_MAX), rng("month", S.MONTH_MIN, S.MONTH_MAX)]
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in STRINGS]
    numbers = S.COUNT_COLUMNS + S.DELAY_COLUMNS + [c for c in S.WEATHER_COLUMNS if c in req.columns]
    checks += [F.when(F.abs(X.nan_to_null(c)) >= (S.COUNT_LIMIT if c in S.COUNT_COLUMNS else float("inf")), F.lit(f"{c}: out of range"))
               for c in numbers]
    if CORRUPT in req.columns:
        checks.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("request: wrong type")))
    errors = F.filter(F.array(*checks), lambda e: e.isNotNull())
    out = {"errors": errors}
    for c in S.COUNT_COLUMNS:
        v = X.nan_to_null(c)
        out[c] = F.coalesce(F.when(v >= 0, v).try_cast("long"), F.lit(0)).cast("long")
    for c in S.DELAY_COLUMNS:
        v = X.nan_to_null(c)
        out[c] = F.when(v.isNull() | (v < 0), F.lit(0.0)).otherwise(v)
    for c in S.WEATHER_COLUMNS:
        out[c] = F.coalesce(X.nan_to_null(c), F.lit(0.0)) if c in req.columns else F.lit(0.0)
    df = req.withColumns(out)
    df = df.withColumns({"year": F.col("year").try_cast("int"), "month": F.col("month").try_cast("int")}) \
        if "year" in df.columns else df
    return df.withColumn("valid", F.size("errors") == 0).drop(CORRUPT)


def read_requests(reader, path: str) -> DataFrame:
    """Landed JSON requests, from ``spark.read`` or ``spark.readStream``. The
    text of a record with a wrong type is kept in ``_corrupt``."""
    schema = T.StructType([*S.SCORE_REQUEST.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def request_features(valid: DataFrame) -> DataFrame:
    """Recompute both rates from the validated counts (K1)."""
    df = valid.withColumns({c: F.col(c).cast("double") for c in S.COUNT_COLUMNS})
    return mandatory_features(df).drop("high_delay_risk")


def score(df: DataFrame, clf: PipelineModel | Compiled, reg: PipelineModel | Compiled, keep: list[str]) -> DataFrame:
    """Probability of high delay risk, label at 0.5, predicted minutes per
    flight. Compiled models (``ensembles.Compiled``) are expressions over the
    columns; fitted models that share one encoder encode each row once."""
    if isinstance(clf, Compiled):
        s = reg.score(clf.score(df, "high_delay_risk_proba"), "avg_delay_pred").select(*keep, "high_delay_risk_proba", "avg_delay_pred")
        return s.withColumn("high_delay_risk_label", X.risk_label("high_delay_risk_proba"))
    both = clf.transform(df).select(*df.columns, prob1(F.col("probability")).alias("high_delay_risk_proba"),
                                    *(["features"] if MD.same_encoder(clf, reg) else []))
    predicted = reg.stages[-1].transform(both) if MD.same_encoder(clf, reg) else reg.transform(both)
    s = predicted.select(*keep, "high_delay_risk_proba", F.col("prediction").alias("avg_delay_pred"))
    return s.withColumn("high_delay_risk_label", X.risk_label("high_delay_risk_proba"))


def score_batch(requests: DataFrame, clf: PipelineModel | Compiled, reg: PipelineModel | Compiled, id_col: str = "request_id") -> DataFrame:
    """K1: validated requests -> proba, label, predicted avg delay per flight."""
    feats = request_features(validate_requests(requests).where("valid"))
    return score(feats, clf, reg, [id_col]).select(
        id_col, "high_delay_risk_proba", "high_delay_risk_label",
        F.col("avg_delay_pred").alias("avg_delay_per_flight"))


def score_batch_risk(requests: DataFrame, clf: PipelineModel | Compiled, reg: PipelineModel | Compiled,
                     id_col: str = "request_id") -> DataFrame:
    """K2: keep the input fields, add probability, minutes and HIGH/LOW."""
    feats = request_features(validate_requests(requests).where("valid")).drop("errors", "valid")
    keep = feats.columns
    scored = score(feats, clf, reg, keep)
    return scored.select(*keep, F.col("high_delay_risk_proba").alias("high_delay_probability"),
                         F.col("avg_delay_pred").alias("avg_delay_minutes"),
                         X.risk_text("high_delay_risk_proba").alias("risk_level"))
