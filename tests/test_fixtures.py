"""Documented properties of the derived inputs at sf0.01 (FIXTURES.md)."""
from pyspark.sql import functions as F

from tests.conftest import SF001
from tarmac.fixtures import fixture
from tarmac.operators import clean as C
from tarmac.operators import split as SP


def test_flights_raw_counts(spark):
    raw = fixture(spark, SF001, "flights_raw")
    r = raw.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("arr_flights") == 0).cast("int")).alias("zero"),
                F.sum(F.col("weather_delay").isNull().cast("int")).alias("null_wd")).first()
    assert (r["n"], r["zero"], r["null_wd"]) == (10218, 732, 9194)
    pos = C.prepare_base(raw).agg(F.avg("high_delay_risk")).first()[0]
    assert abs(pos - 0.275) < 0.001


def test_split_counts_match_documented(spark):
    df = SP.stratified_split(C.prepare_base(fixture(spark, SF001, "flights_raw")))
    got = {(r["high_delay_risk"], r["split"]): r["n"]
           for r in df.groupBy("high_delay_risk", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, "train"): 5188, (0, "val"): 1112, (0, "test"): 1112,
                   (1, "train"): 1964, (1, "val"): 421, (1, "test"): 421}


def test_other_fixture_sizes(spark):
    assert fixture(spark, SF001, "airports_raw").count() == 30
    wd = fixture(spark, SF001, "weather_daily")
    assert wd.count() == 15000                                   # every order kept
    assert wd.where("airport = 'A22'").count() == 0              # A22 has no weather
    assert fixture(spark, SF001, "runs_fx").count() == 150
