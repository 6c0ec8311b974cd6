from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import airports as AP
from tarmac.operators import weather as W
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("ordinal", T.LongType())] + S.AIRPORTS_RAW.fields)


def _airports(spark):
    rows = [
        (1, "K1", "One", "Town", "US-A", "US", "AAA", "L1", 10.0, 20.0),
        (2, "K2", "Dup", None, "US-B", "US", "AAA", "L2", 11.0, 21.0),     # duplicate code: dropped (keep first)
        (3, "K3", "NoIata", "City", None, "US", None, "bbb", 12.0, 22.0),  # local code used
        (4, "K4", "Canada", "X", "CA-1", "CA", "CCC", "L4", 13.0, 23.0),  # other country
        (5, "K5", "NoCoord", "Y", "US-C", "US", "DDD", "L5", None, 24.0),  # dropped
        (6, "K6", " ", "Z", "US-D", "US", "EEE", "L6", 14.0, 25.0),        # blank name: no label
    ]
    return spark.createDataFrame(rows, RAW)


def test_airports_dim_keep_first(spark):
    d = {r["faa_code"]: r for r in AP.airports_dim(_airports(spark)).collect()}
    assert set(d) == {"AAA", "bbb", "EEE"}
    assert d["AAA"]["ident"] == "K1"


def test_labels_last_wins(spark):
    dim = AP.airports_dim(_airports(spark))
    lab = {r["code"]: r["label"] for r in AP.airport_labels(dim).collect()}
    assert lab["AAA"] == "Town: One (US-A)"
    assert lab["BBB"] == "City: NoIata"       # trimmed + upper-cased, region missing
    assert "EEE" not in lab and "K6" not in lab


def test_lookup_unmatched(spark):
    dim = AP.airports_dim(_airports(spark))
    codes = spark.createDataFrame([("AAA",), ("ZZZ",)], "airport string")
    out = {r["airport"]: (r["lat"], r["lon"]) for r in AP.airport_lookup(codes, dim).collect()}
    assert out == {"AAA": (10.0, 20.0), "ZZZ": (None, None)}


def test_daily_monthly_cache(spark):
    daily = spark.createDataFrame([
        ("A1", 2020, "2020-01-01", 1.0, 2.0, 3.0), ("A1", 2020, "2020-01-02", None, 4.0, 5.0),
        ("A1", 2020, "n/a", 100.0, 100.0, 100.0), ("A1", 2020, "2020-02-01", 7.0, 0.0, 1.0)],
        "airport string, year int, time string, temperature_2m_mean double, precipitation_sum double, windspeed_10m_max double")
    m = {r["month"]: r for r in W.daily_to_monthly(daily).collect()}
    assert set(m) == {1, 2} and m[1]["temperature_2m_mean"] == 1.0 and m[1]["precipitation_sum"] == 3.0
    lines = W.monthly_to_cache_lines(W.daily_to_monthly(daily)).unionByName(
        spark.createDataFrame([('{"A9_2001_3": "broken"}',)], "value string"))
    c = {(r["airport"], r["month"]): r for r in W.cache_to_monthly(lines).collect()}
    assert c[("A9", 3)]["temperature_2m_mean"] == 0.0 and c[("A1", 1)]["windspeed_10m_max"] == 4.0


def test_upsert_newest_wins(spark):
    old = spark.createDataFrame([("A", 2020, 1, 1.0), ("A", 2020, 2, 2.0)], "airport string, year int, month int, v double")
    new = spark.createDataFrame([("A", 2020, 2, 9.0)], "airport string, year int, month int, v double")
    got = {r["month"]: r["v"] for r in W.upsert_latest(old, new).collect()}
    assert got == {1: 1.0, 2: 9.0}


def test_dim_without_ordinal_uses_file_order(spark):
    raw = _airports(spark).orderBy("ordinal").drop("ordinal").coalesce(1)
    d = {r["faa_code"]: r["ident"] for r in AP.airports_dim(raw).collect()}
    assert d["AAA"] == "K1"
