import pytest
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import airports as AP
from tarmac.operators import runs as R
from tarmac.operators import weather as W
from tarmac.session import scratch_path
from tarmac.sources import files as IO


def _flights(spark):
    vals = [1.0] * len(S.NUMERIC_COLUMNS)
    return spark.createDataFrame([(2020, 1, "C", "Carrier", "A1", "Air", *vals)], S.FLIGHTS_RAW)


def test_read_flights_csv_contract(spark):
    path = scratch_path(spark, "t_csv")
    IO.write_csv(_flights(spark).withColumn("extra", F.lit("x")), path)
    df = IO.read_flights_csv(spark, path)
    assert df.columns == S.REQUIRED_COLUMNS and df.count() == 1
    bad = scratch_path(spark, "t_csv_bad")
    IO.write_csv(_flights(spark).drop("arr_delay"), bad)
    with pytest.raises(ValueError, match="arr_delay"):
        IO.read_flights_csv(spark, bad)
    with pytest.raises(FileNotFoundError):
        IO.read_flights_csv(spark, scratch_path(spark, "absent"))


def test_na_tokens_read_as_null(spark):
    path = scratch_path(spark, "t_air")
    rows = [("K1", "NA", "", "US-A", "US", "", "L1", 1.0, 2.0)]
    IO.write_csv(spark.createDataFrame(rows, S.AIRPORTS_RAW), path)
    r = IO.read_airports_csv(spark, path).first()
    assert r["name"] is None and r["municipality"] is None and r["iata_code"] is None


def test_history_lifecycle(spark):
    path = scratch_path(spark, "t_hist")
    assert IO.history_load(spark, path).count() == 0           # absent -> empty
    h = spark.createDataFrame([], S.HISTORY)
    IO.history_append(h, path)
    IO.history_clear(spark, path)
    assert IO.history_load(spark, path).count() == 0


def _entries(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.timestamp_seconds("id").alias("timestamp"), F.lit(2020).alias("year"), F.lit(1).alias("month"), F.lit("C").alias("carrier"),
        F.lit("A").alias("airport"), F.col("id").alias("arr_flights"), F.lit(None).cast("long").alias("arr_del15"),
        F.lit(0.5).alias("high_delay_risk_proba"), F.lit(1).alias("high_delay_risk_label"), F.lit(1.0).alias("avg_delay_per_flight"))


def test_history_compaction(spark):
    path = scratch_path(spark, "t_hist")
    IO.history_append(_entries(spark, 200).repartition(40), path)
    before = IO.history_load(spark, path)                      # a reader that listed the files before
    rows = sorted(r["arr_flights"] for r in before.collect())
    small = len(IO.history_files(spark, path))
    assert small == 40 and IO.history_compact(spark, path) == 40
    assert len(IO.history_files(spark, path)) == 1 and sorted(r["arr_flights"] for r in before.collect()) == rows
    IO.history_append(_entries(spark, 50, 200).repartition(5), path)
    now = sorted(r["arr_flights"] for r in IO.history_load(spark, path).collect())
    assert now == list(range(250))
    assert IO.history_compact(spark, path) == 6 and IO.history_compact(spark, path) == 0
    assert IO.history_vacuum(spark, path) == 40 + 5 + 1 + 1 and IO.history_vacuum(spark, path) == 0
    assert sorted(r["arr_flights"] for r in IO.history_load(spark, path).collect()) == now
    IO.history_clear(spark, path)
    assert IO.history_load(spark, path).count() == 0
    IO.history_append(_entries(spark, 3), path)
    assert IO.history_load(spark, path).count() == 3


def test_a_lost_or_second_compaction_changes_nothing(spark):
    from tarmac.session import publish_text_file
    path = scratch_path(spark, "t_hist")
    IO.history_append(_entries(spark, 20).repartition(4), path)
    IO.history_load(spark, path).write.parquet(f"{path}/_compacted/lost")      # written, never published
    assert IO.history_load(spark, path).count() == 20
    IO.history_compact(spark, path)
    with pytest.raises(Exception, match="already exist|AlreadyExists"):
        publish_text_file(spark, f"{path}/_manifest/{1:012d}.json", "{}")      # the slower of two
    assert IO.history_load(spark, path).count() == 20
    IO.history_vacuum(spark, path)
    assert IO.history_load(spark, path).count() == 20


def test_pack():
    bins = IO.pack([("a", 6), ("b", 5), ("c", 4), ("d", 4), ("e", 1), ("f", 10)], 10)
    assert sorted(map(sorted, bins)) == [["a", "c"], ["b", "d", "e"]]
    assert IO.pack([], 10) == [] and IO.pack([("a", 3)], 10) == []


def test_fallback(spark):
    a, b = scratch_path(spark, "t_a"), scratch_path(spark, "t_b")
    assert IO.read_with_fallback(spark, [a, b]) is None
    spark.range(3).write.parquet(b)
    assert IO.read_with_fallback(spark, [a, b]).count() == 3


def test_run_store_roundtrip_and_best(spark):
    fx = spark.createDataFrame(
        [("r1", "clf", "final", 0.9, None), ("r2", "clf", "final", 0.9, None), ("r3", "reg", "final", None, 2.0),
         ("r4", "clf", "tuning", 0.99, None)],
        "run_id string, `mlflow.runName` string, stage string, test_auc double, test_rmse double")
    root = scratch_path(spark, "t_runs")
    R.write_run_files(fx, root, ["test_auc", "test_rmse"], [], ["mlflow.runName", "stage"])
    wide = R.runs_wide(R.runs_long(spark, root), ["test_auc", "test_rmse"], [], ["mlflow.runName", "stage"])
    d = R.runs_display(wide)
    assert [r["run_id"] for r in d.collect()] == ["r1", "r2", "r3"]       # stage filter + order
    best = {r["model"]: r["run_id"] for r in R.model_summary(d).collect()}
    assert best == {"classifier": "r1", "regressor": "r3"}                 # tie -> first run_id


def test_run_store_files_do_not_grow_with_runs(spark):
    """A packed store has one folder per value name, whatever the number of
    runs, and is read beside run folders of the same root."""
    n = 300
    fx = spark.range(n).selectExpr("concat('r', id) AS run_id", "id / 8 AS test_auc", "IF(id % 2 = 0, 'final', NULL) AS stage")
    root = scratch_path(spark, "t_runs")
    R.write_run_files(fx, root, ["test_auc"], [], ["stage"])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).count()
    assert files < n / 10
    spark.createDataFrame([("0 0.25 0",)], "value string").coalesce(1).write.text(f"{root}/run_id=old/kind=metrics/name=test_auc")
    got = {r["run_id"]: (r["metrics.test_auc"], r["tags.stage"]) for r in R.runs_wide(R.runs_long(spark, root), ["test_auc"], [], ["stage"]).collect()}
    assert got == {f"r{i}": (i / 8, None if i % 2 else "final") for i in range(n)} | {"old": (0.25, None)}


def test_logged_run_closes_on_failure(spark):
    path = scratch_path(spark, "t_runs_tbl")
    with pytest.raises(RuntimeError):
        with R.logged_run(spark, path, "x", {"a": 1}):
            raise RuntimeError("boom")
    assert spark.read.parquet(path).first()["status"] == "FAILED"


def test_a_lost_driver_leaves_an_open_run(spark):
    path = scratch_path(spark, "t_runs_tbl")
    assert R.runs_current(spark, path).count() == 0
    lost = R.logged_run(spark, path, "lost", {"depth": 3})
    lost.__enter__()
    lost.log(auc=0.5)
    lost.log(auc=0.7)                                       # and the driver is gone
    with R.logged_run(spark, path, "whole", {"depth": 4}) as run:
        run.metrics["rmse"] = 2.0
        run.model_path = "m"
    with pytest.raises(RuntimeError):
        with R.logged_run(spark, path, "failed", {}):
            raise RuntimeError("boom")
    got = {r["run_name"]: r for r in R.runs_current(spark, path).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"lost": "RUNNING", "whole": "FINISHED", "failed": "FAILED"}
    assert got["lost"]["params"] == {"depth": "3"} and got["lost"]["metrics"] == {"auc": 0.7} and got["lost"]["model_path"] is None
    closed = {r["run_id"]: r.asDict() for r in spark.read.parquet(path).collect()}      # events are hidden from the table
    assert len(closed) == 2
    for r in got.values():
        if r["status"] != "RUNNING":
            assert r.asDict() == closed[r["run_id"]]
    assert R.runs_current(spark, path).columns == S.RUNS.names


def test_fetch_plan_skips_landed_and_uncoded(spark):
    flights = spark.createDataFrame([("A1", 2020), ("A1", 2021), ("A2", 2020), ("ZZ", 2020)], "airport string, year int")
    raw = spark.createDataFrame([(1, "K1", "n", "c", "r", "US", "A1", "L1", 10.0, 20.0),
                                 (2, "K2", "n", "c", "r", "US", "A2", "L2", 11.0, -21.5)],
                                "ordinal long, ident string, name string, municipality string, iso_region string, "
                                "iso_country string, iata_code string, local_code string, latitude_deg double, longitude_deg double")
    landed = spark.createDataFrame([("A1", 2020)], "airport string, year int")
    plan = {(r["airport"], r["year"]): r["url"] for r in W.fetch_plan(flights, AP.airports_dim(raw), landed).collect()}
    assert set(plan) == {("A1", 2021), ("A2", 2020)}
    assert plan[("A2", 2020)].endswith("latitude=11.0&longitude=-21.5&start_date=2020-01-01&end_date=2020-12-31"
                                       "&daily=temperature_2m_mean,precipitation_sum,windspeed_10m_max&timezone=UTC")


def test_fallback_unreadable_is_none(spark):
    p = scratch_path(spark, "t_bad")
    spark.createDataFrame([("x",)], "v string").write.text(p)
    assert IO.read_with_fallback(spark, [p]) is None      # text files are not Parquet


def test_prepare_flow_checks_contract(spark):
    from tarmac.operators.contract import MissingColumnsError
    from tarmac.plans import flows
    raw = _flights(spark).drop("nas_delay")
    daily = spark.createDataFrame([], "airport string, year int, time string, temperature_2m_mean double, "
                                      "precipitation_sum double, windspeed_10m_max double")
    with pytest.raises(MissingColumnsError, match="nas_delay"):
        flows.prepare_datasets(spark, raw, daily, scratch_path(spark, "t_prep"))


def _text(spark, path, lines):
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("append").text(path)


def test_csv_files_with_swapped_columns_are_an_error(spark):
    path = scratch_path(spark, "t_coords")
    _text(spark, path, ["airport,lat,lon", "A1,1.0,2.0"])
    assert [tuple(r) for r in IO.read_coordinates_csv(spark, path).collect()] == [("A1", 1.0, 2.0)]
    _text(spark, path, ["airport,lon,lat", "A2,2.0,1.0"])
    with pytest.raises(Exception, match="header|conform"):
        IO.read_coordinates_csv(spark, path).collect()


def test_keep_first_is_file_order_over_several_files(spark, tmp_path):
    head = "ident,name,municipality,iso_region,iso_country,iata_code,local_code,latitude_deg,longitude_deg"
    one = "{0},{1},c,US-X,US,AAA,AAA,1.0,2.0"
    (tmp_path / "a.csv").write_text("\n".join([head, one.format("first", "a")]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([head, *[one.format(f"later{i}", "b" * 50) for i in range(500)]]) + "\n")
    got = AP.airports_dim(IO.read_airports_csv(spark, f"file://{tmp_path}")).collect()
    assert [(r["faa_code"], r["ident"]) for r in got] == [("AAA", "first")]


def test_run_store_reads_run_folders_only(spark, tmp_path):
    for name, text in {"r1/metrics/test_auc": "0 0.9 0", "r1/params/model_type": "gbt", "r1/tags/stage": "final",
                       "r1/artifacts/model/data.txt": "x", "models/m-1/metrics/test_auc": "0 0.99 0",
                       "models/m-1/params/model_type": "other"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    wide = R.runs_wide(R.runs_long(spark, f"file://{tmp_path}"), ["test_auc"], ["model_type"], ["stage"]).collect()
    assert [(r["run_id"], r["metrics.test_auc"]) for r in wide] == [("r1", 0.9)]


def test_history_of_an_unreachable_store_is_an_error(spark):
    assert IO.history_load(spark, scratch_path(spark, "none")).count() == 0
    with pytest.raises(Exception, match="No FileSystem|UnsupportedFileSystem|nosuch"):
        IO.history_load(spark, "nosuch://store/history")


def test_no_run_with_the_metric_raises(spark):
    runs = spark.createDataFrame([("r1", None, 0.5), ("r2", float("nan"), 0.4)], "run_id string, test_auc double, test_rmse double")
    with pytest.raises(ValueError, match="test_auc"):
        R.best_run(runs, "test_auc", True)
    assert R.best_run(runs, "test_rmse", False).first()["run_id"] == "r2"
