from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import clean as C
from tarmac.operators.contract import MissingColumnsError, require_columns, schema_diff


def _raw(spark, rows):
    return spark.createDataFrame(rows, S.FLIGHTS_RAW)


def _row(year=2020, month=1, flights=100.0, del15=25.0, delay=300.0, weather=None):
    vals = {c: 1.0 for c in S.NUMERIC_COLUMNS}
    vals.update(arr_flights=flights, arr_del15=del15, arr_delay=delay, weather_delay=weather)
    return (year, month, "C0", "Carrier", "A0", "Airport", *[vals[c] for c in S.NUMERIC_COLUMNS])


def test_clean_and_targets_edge_cases(spark):
    rows = [_row(flights=0.0), _row(flights=None), _row(flights=-5.0), _row(flights=100.0, del15=25.0),
            _row(flights=100.0, del15=26.0, delay=None), _row(flights=float("nan"))]
    out = C.prepare_base(_raw(spark, rows)).collect()
    af = [r["arr_flights"] for r in out]
    assert af == [0.0, 0.0, 0.0, 100.0, 100.0, 0.0]
    # zero flights -> both rates 0
    assert out[0]["delay_rate"] == 0.0 and out[0]["avg_delay_per_flight"] == 0.0
    # exactly at the threshold -> 0 (strict)
    assert out[3]["delay_rate"] == 0.25 and out[3]["high_delay_risk"] == 0
    assert out[4]["high_delay_risk"] == 1
    # null delay -> 0, null weather delay -> 0, negative delays kept
    assert out[4]["arr_delay"] == 0.0 and out[0]["weather_delay"] == 0.0


def test_negative_delay_not_clipped(spark):
    out = C.prepare_base(_raw(spark, [_row(delay=-30.0)])).first()
    assert out["arr_delay"] == -30.0 and out["avg_delay_per_flight"] == -0.3


def test_strict_and_extended(spark):
    rows = [_row(flights=0.0), _row(flights=10.0, weather=None), _row(year=None)]
    df = spark.createDataFrame(rows, S.FLIGHTS_RAW)
    out = C.extended_rates(C.clean_strict(df)).collect()
    assert len(out) == 1
    assert out[0]["weather_delay_per_flight"] is None and out[0]["cancel_rate"] == 0.1


def test_contract(spark):
    df = _raw(spark, [_row()]).drop("arr_delay")
    try:
        require_columns(df, S.REQUIRED_COLUMNS)
        raise AssertionError("expected failure")
    except MissingColumnsError as e:
        assert "arr_delay" in str(e)
    d = {r["column_name"]: r["status"] for r in schema_diff(df.withColumn("x", F.lit(1)), S.REQUIRED_COLUMNS).collect()}
    assert d["arr_delay"] == "missing" and d["x"] == "extra" and d["year"] == "present"


def test_risk_buckets(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.7,), (0.2999,)], "high_delay_risk_proba double")
    out = C.risk_buckets(df).collect()
    assert [r["risk_level"] for r in out] == ["medium", "medium", "high", "low"]
    assert [r["risk_label"] for r in out] == [0, 1, 1, 0]
    assert out[1]["risk_percent"] == "50.0%"


def test_null_year_raises(spark):
    import pytest
    df = _raw(spark, [_row(year=None)])
    with pytest.raises(Exception, match="year is null"):
        C.prepare_base(df).collect()
