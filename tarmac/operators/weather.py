"""Weather: daily archive -> monthly means -> enrichment (S4-S6, S19, A1, A4,
A5, J2, J3, P12, P13, P20, P22, W6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators.airports import airport_coords
from tarmac.operators.contract import first_existing

KEY = ["airport", "year", "month"]


def archive_to_daily(archive: DataFrame) -> DataFrame:
    """One archive document per (airport, year) with parallel arrays under
    ``daily`` -> one row per day (``inline(arrays_zip(...))``)."""
    d = F.col("daily")
    zipped = F.arrays_zip(d["time"].alias("time"),
                          *[d[c].alias(c) for c in S.WEATHER_COLUMNS])
    return archive.select("airport", "year", F.inline(zipped))


def daily_to_monthly(daily: DataFrame) -> DataFrame:
    """Mean of every weather variable per (airport, year, month); the month
    comes from the parsed date, unparseable dates drop out, nulls ignored.
    (Sums and maxima are averaged too: mean of daily sums / daily maxima.)"""
    date = F.try_to_timestamp(F.col("time")).cast("date")
    return (daily.withColumn("month", F.month(date))
                 .where(F.col("month").isNotNull())
                 .groupBy(*KEY)
                 .agg(*[F.avg(c).alias(c) for c in S.WEATHER_COLUMNS]))


_CACHE_KEY = r"^(.*)_(\d+)_(\d+)$"


def cache_to_monthly(lines: DataFrame) -> DataFrame:
    """JSON cache lines (each a map ``"{airport}_{year}_{month}" -> entry``)
    -> one row per key. A malformed (non-object) entry yields its key with
    zeros; missing values are 0."""
    m = F.from_json(F.col("value"), "map<string,string>")
    kv = lines.select(F.explode(m).alias("key", "raw"))
    entry = F.from_json(F.col("raw"), S.WEATHER_CACHE_VALUE)
    return kv.select(
        F.regexp_extract("key", _CACHE_KEY, 1).alias("airport"),
        F.regexp_extract("key", _CACHE_KEY, 2).cast("int").alias("year"),
        F.regexp_extract("key", _CACHE_KEY, 3).cast("int").alias("month"),
        *[F.coalesce(entry[c], F.lit(0.0)).alias(c) for c in S.WEATHER_COLUMNS])


def monthly_to_cache_lines(monthly: DataFrame, group: str = "airport") -> DataFrame:
    """Monthly rows -> JSON cache lines, one map per ``group`` value."""
    key = F.concat_ws("_", F.col("airport"), F.col("year").cast("string"), F.col("month").cast("string"))
    val = F.struct(F.col("month").cast("double").alias("month"), *[F.col(c) for c in S.WEATHER_COLUMNS])
    return (monthly.groupBy(group)
                   .agg(F.map_from_entries(F.collect_list(F.struct(key, val))).alias("m"))
                   .select(F.to_json("m").alias("value")))


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Union with priority, newest wins per key (``max_by`` partial aggregate)."""
    vals = [c for c in old.columns if c not in key]
    both = (old.select(*key, *vals).withColumn("_prio", F.lit(0))
               .unionByName(new.select(*key, *vals).withColumn("_prio", F.lit(1))))
    win = both.groupBy(*key).agg(F.max_by(F.struct(*vals), F.col("_prio")).alias("v"))
    return win.select(*key, *[F.col(f"v.{c}").alias(c) for c in vals])


def fetch_plan(flights: DataFrame, dim: DataFrame, landed: DataFrame | None = None,
               daily_vars: list[str] = S.WEATHER_COLUMNS) -> DataFrame:
    """Distinct (airport, lat, lon, year) still to fetch, with the archive URL.

    One request per airport-year, not per month; combinations already landed
    are removed by an anti join; rows without coordinates cannot be fetched.
    """
    coords = airport_coords(dim)
    combos = (flights.select("airport", "year").distinct()
                     .join(coords, F.col("airport") == F.col("faa_code"), "left")
                     .select("airport", "lat", "lon", "year")
                     .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    if landed is not None:
        combos = combos.join(landed.select("airport", "year").distinct(), ["airport", "year"], "left_anti")
    url = F.format_string(S.WEATHER_URL_FORMAT, F.lit(S.WEATHER_ARCHIVE_URL), F.col("lat").cast("string"),
                          F.col("lon").cast("string"), F.col("year"), F.col("year"), F.lit(",".join(daily_vars)))
    return combos.withColumn("url", url)


def enrich(flights: DataFrame, monthly: DataFrame) -> DataFrame:
    """Left join on the composite (airport, year, month) key (unique on the
    right); missing weather -> 0. Helper columns of other layouts are dropped
    if present; string columns are not filled."""
    w = monthly.select(*KEY, *S.WEATHER_COLUMNS)
    out = flights.drop(*[c for c in S.WEATHER_COLUMNS if c in flights.columns]).join(w, KEY, "left")
    out = out.na.fill(0.0, subset=S.WEATHER_COLUMNS)
    return out.drop("faa_code", "lat", "lon", "key", "temp_mean", "temp_min", "temp_max",
                    "precip_sum", "windspeed_max")


METRIC_CANDIDATES = {
    "temperature": ["temperature_2m_mean", "temp_mean"],
    "precipitation": ["precipitation_sum", "precip_sum"],
    "wind": ["windspeed_10m_max", "windspeed_max"],
}


def weather_map(weather: DataFrame, dim: DataFrame | None = None, metric: str = "temperature",
                year: int | None = None) -> DataFrame:
    """Mean weather metric per (airport, lat, lon) for one year (default:
    the latest year, a scalar subquery), rows without coordinates dropped."""
    chosen = first_existing(weather, METRIC_CANDIDATES)
    if metric not in chosen:
        raise ValueError("no known weather column")
    mcol = chosen[metric]
    df = weather
    if ("lat" not in df.columns or "lon" not in df.columns) and dim is not None:
        df = df.join(airport_coords(dim).withColumnRenamed("faa_code", "airport"),
                     "airport", "left")
    if "lat" not in df.columns or "lon" not in df.columns:
        raise ValueError("lat/lon missing even after the airport join")
    y = F.lit(year) if year is not None else df.select(F.max("year")).scalar()
    return (df.where(F.col("year") == y)
              .select("airport", "lat", "lon", mcol)
              .dropna(subset=["lat", "lon"])
              .groupBy("airport", "lat", "lon").agg(F.avg(mcol).alias(mcol)))


def weather_kpis(points: DataFrame, metric_col: str) -> DataFrame:
    """min / mean / max over the per-airport means."""
    return points.agg(F.min(metric_col).alias("kpi_min"), F.avg(metric_col).alias("kpi_mean"),
                      F.max(metric_col).alias("kpi_max"))
