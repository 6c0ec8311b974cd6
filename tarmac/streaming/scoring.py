"""Structured Streaming: requests landing in a directory.

Both are append streams with a checkpoint, so a restarted query resumes
exactly where it stopped; ``availableNow`` processes what has landed and stops
(the batch-like trigger used for backfills and tests). Their only state are
the ids of the requests of the last ``RESEND``: a request sent again within
that time, in whatever file, is neither scored nor stored again.
"""

from __future__ import annotations

import threading

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import score as SC


RESEND = "1 day"       # within which a request id counts once


def unique_requests(requests: DataFrame, within: str = RESEND) -> DataFrame:
    """A stream's requests, each id once ``within`` the time of its arrival.

    The watermark runs on the micro-batch's own time, which a re-run batch
    takes from the offset log: no request is ever late, and state holds the
    ids of one period. Requests without an id all stay.
    """
    columns = requests.columns
    return (requests.withColumns({"_arrived": F.current_timestamp(),
                                  "_request": F.coalesce(F.col("request_id").cast("string"), F.concat(F.lit("-"), F.uuid()))})
            .withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_request"]).select(*columns))


def request_stream(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return SC.read_requests(r, source_dir)


def stream_score(spark: SparkSession, source_dir: str, clf: PipelineModel, reg: PipelineModel,
                 sink_dir: str, checkpoint_dir: str, within: str = RESEND) -> None:
    """Validate -> features -> both models -> append to a Parquet sink;
    a request sent again ``within`` that time is scored once."""
    scored = SC.score_batch(unique_requests(request_stream(spark, source_dir), within), clf, reg)
    q = (scored.writeStream.format("parquet").outputMode("append")
               .option("checkpointLocation", checkpoint_dir)
               .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()


def history_entries(valid: DataFrame, clf: PipelineModel, reg: PipelineModel) -> DataFrame:
    """Scored requests as prediction-history rows (UTC processing time)."""
    feats = SC.request_features(valid)
    scored = SC.score(feats, clf, reg, ["request_id", "year", "month", "carrier", "airport",
                                        "arr_flights", "arr_del15"])
    return scored.select(F.current_timestamp().alias("timestamp"), "year", "month", "carrier", "airport",
                         F.col("arr_flights").cast("long").alias("arr_flights"),
                         F.col("arr_del15").cast("long").alias("arr_del15"),
                         "high_delay_risk_proba", "high_delay_risk_label",
                         F.col("avg_delay_pred").alias("avg_delay_per_flight"), "request_id")


def stream_accept_reject(spark: SparkSession, source_dir: str, accepted_dir: str, rejected_dir: str,
                         checkpoint_dir: str, clf: PipelineModel | None = None,
                         reg: PipelineModel | None = None, within: str = RESEND) -> None:
    """Validated requests appended to the accepted sink, rejected ones
    (with their errors) to a second sink, each id once ``within`` that time; one micro-batch feeds both writes
    (persisted once, released after). With both models given, accepted
    requests are scored and written as prediction-history entries.

    ``foreachBatch`` is at-least-once: a micro-batch re-run after a failure
    gets the same epoch id. Each epoch is therefore written as its own
    ``stream=<id>/epoch=<id>`` partition with dynamic partition overwrite, so a
    re-run replaces its earlier output instead of duplicating it. The stream's
    id lives in its checkpoint: another checkpoint folder is another stream,
    whose epochs (from 0 again) never touch those already written.
    """
    validated = SC.validate_requests(unique_requests(request_stream(spark, source_dir), within))
    started, query = threading.Event(), []

    def stream_id() -> str:
        started.wait()      # the first batch may run before start() has returned
        return query[0].id

    def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
        (df.withColumn("stream", F.lit(stream_id())).withColumn("epoch", F.lit(epoch).cast("long"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("stream", "epoch").parquet(path))

    def write_both(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            ok = batch.where("valid").drop("errors", "valid")
            if clf is not None and reg is not None:
                ok = history_entries(ok, clf, reg)
            write_epoch(ok, accepted_dir, epoch)
            write_epoch(batch.where("NOT valid").select("request_id", "errors"), rejected_dir, epoch)
        finally:
            batch.unpersist()

    q = (validated.writeStream.foreachBatch(write_both)
                  .option("checkpointLocation", checkpoint_dir)
                  .trigger(availableNow=True).start())
    query.append(q)
    started.set()
    q.awaitTermination()
