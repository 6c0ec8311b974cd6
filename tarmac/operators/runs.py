"""Run store as tables.

A run store directory holds ``<run>/params/<name>``, ``<run>/metrics/<name>``
(lines ``millis value step``) and ``<run>/tags/<name>`` text files. It is read
with one ``wholetext`` scan; the run, kind and name come from the file path,
and the wide table is a ``pivot`` with explicit values (no extra job to find
them). A store of many runs is packed: ``kind=<kind>/name=<name>/`` holds
Parquet files of ``(run_id, value)``, each record the text of one such file, so
that files don't grow with runs. Both are read, also from one root.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.session import glob_exists, path_exists

# <root>/<run>/<kind>/<name> (tracking-library layout) or, as written by
# Spark's partitioned text writer, <root>/run_id=<run>/kind=<kind>/name=<name>/part-*
PACKED = "run_id string, value string, kind string, name string"
NO_NAME = "__HIVE_DEFAULT_PARTITION__"      # folder of a run without an id, as Spark's writers name it
_PATH = r"/(?:run_id=)?([^/]+)/(?:kind=)?(params|metrics|tags)/(?:name=)?([^/]+?)(?:/part-[^/]*)?$"


def runs_long(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, kind, name, value)`` for every file under ``root``; for
    metrics the value is the last logged value."""
    # only the three kinds right below a run folder are listed: model folders
    # (models/<id>/params etc.) and artifacts are never opened
    layouts = [f"{root}/*/{{params,metrics,tags}}/*", f"{root}/run_id=*/kind=*/name=*/part-*"]
    found = [x for x in layouts if glob_exists(spark, x)]
    parts = spark.createDataFrame([], "run_id string, kind string, name string, text string")
    if found:
        raw = spark.read.option("wholetext", True).schema("value string").text(found)
        path = F.col("_metadata.file_path")
        parts = raw.select(F.regexp_extract(path, _PATH, 1).alias("run_id"), F.regexp_extract(path, _PATH, 2).alias("kind"),
                           F.regexp_extract(path, _PATH, 3).alias("name"), F.trim("value").alias("text")).where(F.col("kind") != "")
    if glob_exists(spark, f"{root}/kind=*"):
        packed = spark.read.schema(PACKED).option("basePath", root).parquet(f"{root}/kind=*")
        packed = packed.select("run_id", "kind", "name", F.trim("value").alias("text"))
        parts = parts.unionByName(packed) if found else packed
    last_line = F.element_at(F.split(F.col("text"), "\n"), -1)
    metric_val = F.element_at(F.split(last_line, " "), 2)
    return parts.select("run_id", "kind", "name",
                        F.when(F.col("kind") == "metrics", metric_val).otherwise(F.col("text")).alias("value"))


def runs_wide(long: DataFrame, metrics: list[str], params: list[str], tags: list[str]) -> DataFrame:
    """Wide runs table with ``metrics.x`` (double), ``params.x``, ``tags.x``."""
    key = F.concat(F.col("kind"), F.lit("."), F.col("name"))
    values = [f"metrics.{m}" for m in metrics] + [f"params.{p}" for p in params] + [f"tags.{t}" for t in tags]
    wide = long.withColumn("k", key).groupBy("run_id").pivot("k", values).agg(F.first("value"))
    return wide.withColumns({f"metrics.{m}": F.col(f"`metrics.{m}`").cast("double") for m in metrics})


def runs_table_wide(runs: DataFrame, metrics: list[str], params: list[str], tags: list[str]) -> DataFrame:
    """The Parquet runs table (S16 layout: maps of params, metrics, tags) in
    the same wide shape as the file store (``metrics.x``, ``params.x``,
    ``tags.x``); the run name is also exposed as ``tags.mlflow.runName``."""
    cols = [F.col("run_id")]
    cols += [F.col("metrics")[m].alias(f"metrics.{m}") for m in metrics]
    cols += [F.col("params")[p].alias(f"params.{p}") for p in params]
    cols += [(F.col("run_name") if t == "mlflow.runName" else F.col("tags")[t]).alias(f"tags.{t}") for t in tags]
    return runs.select(*cols)


def write_run_files(df: DataFrame, root: str, metric_cols: list[str], param_cols: list[str],
                    tag_cols: list[str], millis: int = 0) -> None:
    """Lay a runs table out as a packed run store: per value the text that its
    file would hold (metrics as ``millis value step`` lines; of a run that
    comes twice all lines), many runs to a file."""
    long_cols = ([("metrics", c) for c in metric_cols] + [("params", c) for c in param_cols]
                 + [("tags", c) for c in tag_cols])
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"),
                             F.col(f"`{n}`").cast("string").alias("v")) for k, n in long_cols])
    long = (df.select("run_id", F.explode(arr).alias("e"))
              .select("run_id", "e.kind", "e.name", "e.v").where(F.col("v").isNotNull()))
    line = F.when(F.col("kind") == "metrics", F.concat_ws(" ", F.lit(str(millis)), F.col("v"), F.lit("0"))) \
            .otherwise(F.col("v"))
    run = F.coalesce(F.nullif(F.col("run_id").cast("string"), F.lit("")), F.lit(NO_NAME)).alias("run_id")
    (long.select(run, "kind", "name", line.alias("value"))
         .groupBy("run_id", "kind", "name").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
         .write.mode("overwrite").partitionBy("kind", "name").parquet(root))


def runs_append(spark: SparkSession, path: str, run_name: str, params: dict, metrics: dict,
                tags: dict | None = None, model_path: str | None = None, status: str = "FINISHED",
                run_id: str | None = None) -> str:
    """Append one run row to a Parquet ``runs`` table."""
    rid = run_id or uuid.uuid4().hex
    row = [(rid, run_name, status, {k: str(v) for k, v in params.items()},
            {k: float(v) for k, v in metrics.items() if v is not None}, tags or {}, model_path)]
    spark.createDataFrame(row, S.RUNS).write.mode("append").parquet(path)
    return rid


RUN_EVENTS = ("run_id string, at timestamp, kind string, name string, value double, text string, "
              "params map<string,string>, tags map<string,string>")


def events_path(path: str) -> str:
    """Events of the runs table at ``path``; hidden from its readers."""
    return f"{path.rstrip('/')}/_events"


def append_events(spark: SparkSession, path: str, run_id: str, events: list[dict]) -> None:
    """Append events of one run in order: ``start`` (text: run name, params),
    ``metric`` (name, value), ``end`` (text: status, tags, name: model path)."""
    now = datetime.datetime.now(datetime.timezone.utc)
    rows = [(run_id, now + datetime.timedelta(microseconds=i), e["kind"], e.get("name"), e.get("value"), e.get("text"),
             e.get("params"), e.get("tags")) for i, e in enumerate(events)]
    spark.createDataFrame(rows, RUN_EVENTS).coalesce(1).write.mode("append").parquet(events_path(path))


def runs_from_events(events: DataFrame) -> DataFrame:
    """The run rows as a fold over events, in the order of ``schema.RUNS``.
    A run without an end event is RUNNING, with its parameters and the
    metrics logged so far; of a metric logged again the latest value counts.
    Two partial aggregates; no run's events meet in one task as rows."""
    last = (events.groupBy("run_id", "kind", "name")
            .agg(F.max_by("value", "at").alias("value"), F.max_by(F.struct("text", "params", "tags", "name"), "at").alias("last")))
    metric = F.col("kind") == "metric"
    pairs = F.collect_list(F.when(metric & F.col("value").isNotNull(), F.struct("name", "value")))

    def of(kind: str, field: str):
        return F.max_by(f"last.{field}", F.when(F.col("kind") == kind, F.lit(1)))

    return last.groupBy("run_id").agg(
        of("start", "text").alias("run_name"), F.coalesce(of("end", "text"), F.lit("RUNNING")).alias("status"),
        of("start", "params").alias("params"), F.map_from_entries(F.array_sort(pairs)).alias("metrics"),
        F.coalesce(of("end", "tags"), F.create_map().cast("map<string,string>")).alias("tags"), of("end", "name").alias("model_path"))


def runs_current(spark: SparkSession, path: str) -> DataFrame:
    """Every run that was started at ``path``, open ones included."""
    if not path_exists(spark, events_path(path)):
        return spark.createDataFrame([], S.RUNS)
    return runs_from_events(spark.read.schema(RUN_EVENTS).parquet(events_path(path)))


class logged_run:
    """Context manager. The start is appended as an event before the body
    runs, metrics given to ``log`` as they come, and the end with the run row
    when the body ends, also by an error (status FAILED). A driver lost in
    between leaves an open run in ``runs_current``."""

    def __init__(self, spark, path, run_name, params):
        self.spark, self.path, self.run_name, self.params = spark, path, run_name, params
        self.metrics, self.tags, self.model_path = {}, {}, None
        self.run_id = uuid.uuid4().hex

    def __enter__(self):
        append_events(self.spark, self.path, self.run_id, [
            {"kind": "start", "text": self.run_name, "params": {k: str(v) for k, v in self.params.items()}}])
        return self

    def log(self, **metrics) -> None:
        """Metrics on record from now on, whatever becomes of the driver."""
        self.metrics.update(metrics)
        append_events(self.spark, self.path, self.run_id, _metric_events(metrics))

    def __exit__(self, et, ev, tb):
        status = "FAILED" if et else "FINISHED"
        runs_append(self.spark, self.path, self.run_name, self.params, self.metrics, self.tags, self.model_path, status, self.run_id)
        append_events(self.spark, self.path, self.run_id, [
            *_metric_events(self.metrics), {"kind": "end", "text": status, "tags": self.tags, "name": self.model_path}])
        return False


def _metric_events(metrics: dict) -> list[dict]:
    return [{"kind": "metric", "name": k, "value": float(v)} for k, v in metrics.items() if v is not None]


def runs_display(runs: DataFrame, stage_col: str = "tags.stage") -> DataFrame:
    """Keep final-stage runs when the stage tag exists; keep existing
    optional columns; rename; order by run_id."""
    df = runs
    if stage_col in df.columns:
        df = df.where(F.col(f"`{stage_col}`") == "final")
    base = [("run_id", "run_id"), ("tags.mlflow.runName", "run_name"), ("metrics.test_auc", "test_auc"),
            ("metrics.test_rmse", "test_rmse"), ("tags.task", "task"), ("params.model_type", "model_type")]
    cols = [F.col(f"`{src}`").alias(dst) for src, dst in base if src in df.columns]
    return df.select(*cols).orderBy("run_id")


def best_run(runs: DataFrame, metric: str, maximize: bool) -> DataFrame:
    """The row with the best metric (neither null nor NaN), first run_id on
    ties. Raises when no run has the metric."""
    order = F.col(metric).desc() if maximize else F.col(metric).asc()
    best = runs.where(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(order, F.col("run_id")).limit(1).collect()
    if not best:
        raise ValueError(f"no run has the metric {metric}")
    return runs.sparkSession.createDataFrame(best, runs.schema)     # one row


def model_summary(runs: DataFrame) -> DataFrame:
    """Best classifier (max test_auc) and best regressor (min test_rmse)."""
    c = best_run(runs, "test_auc", True).select(
        F.lit("classifier").alias("model"), F.lit(f"classification ({S.TARGET_CLASSIFICATION})").alias("task"),
        "run_id", "run_name", F.lit("test_auc").alias("metric"), F.col("test_auc").alias("value"))
    r = best_run(runs, "test_rmse", False).select(
        F.lit("regressor").alias("model"), F.lit(f"regression ({S.TARGET_REGRESSION}, lower is better)").alias("task"),
        "run_id", "run_name", F.lit("test_rmse").alias("metric"), F.col("test_rmse").alias("value"))
    return c.unionByName(r)
