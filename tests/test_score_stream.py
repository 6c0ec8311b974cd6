from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import score as SC
from tarmac.session import scratch_path
from tarmac.streaming import scoring as ST


def _req(spark, rows):
    base = {c: 1.0 for c in S.NUMERIC_COLUMNS + S.WEATHER_COLUMNS}
    out = []
    for i, (y, m, carrier, flights, delay) in enumerate(rows):
        d = dict(base, arr_flights=flights, arr_delay=delay)
        out.append((i, y, m, carrier, "n", "A1", "m", *[d[c] for c in S.NUMERIC_COLUMNS + S.WEATHER_COLUMNS]))
    return spark.createDataFrame(out, S.SCORE_REQUEST)


def test_validation_rules(spark):
    df = _req(spark, [(2020, 1, "C", 10.7, -3.0), (1979, 1, "C", 1.0, 1.0), (2020, 13, None, None, None),
                      (2100, 12, "C", -2.0, 5.0)])
    out = SC.validate_requests(df).orderBy("request_id").collect()
    assert out[0]["valid"] and out[0]["arr_flights"] == 10 and out[0]["arr_delay"] == 0.0
    assert not out[1]["valid"] and out[1]["errors"] == ["year: out of range [1980, 2100]"]
    assert len(out[2]["errors"]) == 2 and out[2]["arr_flights"] == 0
    assert out[3]["valid"] and out[3]["arr_flights"] == 0


def test_stream_equals_batch(spark):
    df = _req(spark, [(2020, 1, "C", 10.0, 3.0), (1900, 1, "C", 1.0, 1.0), (2021, 5, None, 2.0, 2.0)])
    src = scratch_path(spark, "t_src")
    df.write.json(src)
    acc, rej, ck = scratch_path(spark, "t_acc"), scratch_path(spark, "t_rej"), scratch_path(spark, "t_ck")
    ST.stream_accept_reject(spark, src, acc, rej, ck)
    got_acc = sorted(r["request_id"] for r in spark.read.parquet(acc).collect())
    got_rej = sorted(r["request_id"] for r in spark.read.parquet(rej).collect())
    batch = SC.validate_requests(df)
    assert got_acc == sorted(r["request_id"] for r in batch.where("valid").collect())
    assert got_rej == sorted(r["request_id"] for r in batch.where("NOT valid").collect())
    # a restart with the same checkpoint processes nothing twice
    ST.stream_accept_reject(spark, src, acc, rej, ck)
    assert spark.read.parquet(acc).count() == len(got_acc)


def test_a_second_checkpoint_appends(spark):
    acc, rej = scratch_path(spark, "t_acc"), scratch_path(spark, "t_rej")
    for part in range(2):
        src = scratch_path(spark, "t_src")
        rows = _req(spark, [(2020, 1, "C", 1.0, 1.0)] * 3).selectExpr(f"request_id + {part * 3} AS request_id", "* EXCEPT (request_id)")
        rows.write.json(src)
        ST.stream_accept_reject(spark, src, acc, rej, scratch_path(spark, "t_ck"))
    assert sorted(r["request_id"] for r in spark.read.parquet(acc).collect()) == list(range(6))


def test_bad_numbers_and_types_reject_one_request(spark):
    df = _req(spark, [(99999999999, 1, "C", 1.0, 1.0), (2020, 1, "C", float("inf"), 1.0), (2020, 1, "C", 1e300, 1.0), (2020, 2, "C", 5.0, 1.0)])
    out = {r["request_id"]: r for r in SC.validate_requests(df).collect()}
    assert [out[i]["valid"] for i in range(4)] == [False, False, False, True]
    assert out[1]["errors"] == ["arr_flights: out of range"] and out[1]["arr_flights"] == 0
    src = scratch_path(spark, "t_src")
    text = [r[0] for r in df.where("request_id = 3").selectExpr("to_json(struct(*))").collect()]
    spark.createDataFrame([(t,) for t in text + [text[0].replace('"arr_flights":5.0', '"arr_flights":"abc"').replace('"request_id":3', '"request_id":4')]],
                          "value string").write.text(src)
    got = {r["request_id"]: r for r in SC.validate_requests(SC.read_requests(spark.read, src)).collect()}
    assert got[3]["valid"] and got[4]["errors"] == ["request: wrong type"]


def test_epoch_rerun_is_idempotent(spark):
    """A re-executed micro-batch (same epoch id) replaces its output."""
    from pyspark.sql import functions as F
    path = scratch_path(spark, "t_epoch")
    df = spark.range(5)
    for _ in range(2):
        (df.withColumn("epoch", F.lit(3).cast("long")).write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path))
    (spark.range(2).withColumn("epoch", F.lit(4).cast("long")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path))
    assert spark.read.parquet(path).count() == 7


def _send(spark, src, ids):
    base = _req(spark, [(2020, 1, "C", 1.0, 1.0)] * len(ids)).drop("request_id").limit(1)
    (spark.createDataFrame([(i,) for i in ids], "request_id long").join(base).coalesce(1).write.mode("append").json(src))


def test_a_request_sent_again_is_stored_once(spark):
    src, acc, rej, ck = (scratch_path(spark, n) for n in ("t_src", "t_acc", "t_rej", "t_ck"))
    _send(spark, src, [1, 2, 2, None, None])
    ST.stream_accept_reject(spark, src, acc, rej, ck)
    _send(spark, src, [2, 3])                                   # the second run is a restart
    ST.stream_accept_reject(spark, src, acc, rej, ck)
    _send(spark, src, [1, 2, 3, 4])
    ST.stream_accept_reject(spark, src, acc, rej, ck)
    got = [r["request_id"] for r in spark.read.parquet(acc).collect()]
    assert sorted(i for i in got if i is not None) == [1, 2, 3, 4] and got.count(None) == 2


def test_ids_leave_the_state_with_the_watermark(spark):
    import time
    src, acc, rej, ck = (scratch_path(spark, n) for n in ("t_src", "t_acc", "t_rej", "t_ck"))
    for ids in ([1], [2], [1]):
        _send(spark, src, ids)
        ST.stream_accept_reject(spark, src, acc, rej, ck, within="1 second")
        time.sleep(3)
    assert sorted(r["request_id"] for r in spark.read.parquet(acc).collect()) == [1, 1, 2]
