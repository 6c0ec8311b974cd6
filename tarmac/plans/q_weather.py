"""Queries: airport dimension, weather roll-up and enrichment, file I/O."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import schema as S
from tarmac.fixtures import oracle_with
from tarmac.operators import airports as AP
from tarmac.operators import weather as W
from tarmac.plans.catalog import _rsel, load, query, r6
from tarmac.plans.q_flights import flights_features
from tarmac.session import scratch_path
from tarmac.sources import files as IO

AIRPORTS_RAW_ORD = T.StructType([T.StructField("ordinal", T.LongType())] + S.AIRPORTS_RAW.fields)

DIM_SQL = """
, dim AS (SELECT ordinal, ident, name, municipality, iso_region, iata_code, local_code, latitude_deg,
    longitude_deg, faa_code FROM (
  SELECT *, coalesce(iata_code, local_code) AS faa_code,
    row_number() OVER (PARTITION BY coalesce(iata_code, local_code) ORDER BY ordinal) AS rn
  FROM airports_raw WHERE iso_country = 'US' AND coalesce(iata_code, local_code) IS NOT NULL
    AND latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL) t WHERE rn = 1)
"""

MONTHLY_SQL = f"""
, monthly AS (SELECT airport, year, CAST(month(try_cast(time AS DATE)) AS INT) AS month,
  {", ".join(f"avg({c}) AS {c}" for c in S.WEATHER_COLUMNS)}
  FROM weather_daily WHERE try_cast(time AS DATE) IS NOT NULL GROUP BY 1, 2, 3)
"""


def dim(spark, sf):
    return AP.airports_dim(load(spark, sf, "airports_raw"))


def monthly(spark, sf):
    return W.daily_to_monthly(load(spark, sf, "weather_daily"))


def flights_weather(spark, sf):
    return W.enrich(flights_features(spark, sf), monthly(spark, sf))


# ---------------------------------------------------------------- airports
@query("airports_dim", oracle_with(["airports_raw"], DIM_SQL + "SELECT * FROM dim"))
def q_airports_dim(spark, sf):
    return dim(spark, sf)


@query("read_airports_csv", oracle_with(["airports_raw"], "SELECT * FROM airports_raw"))
def q_read_airports_csv(spark, sf):
    path = scratch_path(spark, "airports_csv")
    IO.write_csv(load(spark, sf, "airports_raw"), path)
    return IO.read_airports_csv(spark, path, AIRPORTS_RAW_ORD)


@query("read_coordinates_csv", oracle_with(["airports_raw"], DIM_SQL + """
SELECT faa_code AS airport, latitude_deg AS lat, longitude_deg AS lon FROM dim"""))
def q_read_coordinates_csv(spark, sf):
    """S3: the static coordinates file, written from the dimension."""
    path = scratch_path(spark, "coordinates_csv")
    IO.write_csv(AP.airport_coords(dim(spark, sf)).withColumnRenamed("faa_code", "airport"), path)
    return IO.read_coordinates_csv(spark, path)


@query("airport_lookup", oracle_with(["flights_raw", "airports_raw"], DIM_SQL + """
SELECT c.airport, d.latitude_deg AS lat, d.longitude_deg AS lon
FROM (SELECT DISTINCT airport FROM flights_raw) c LEFT JOIN dim d ON c.airport = d.faa_code"""))
def q_airport_lookup(spark, sf):
    codes = load(spark, sf, "flights_raw").select("airport").distinct()
    return AP.airport_lookup(codes, dim(spark, sf))


@query("flights_with_coords", oracle_with(["flights_features", "airports_raw"], DIM_SQL + """
SELECT f.year, f.month, f.carrier, f.airport, round(f.delay_rate, 6) AS delay_rate,
  d.latitude_deg AS lat, d.longitude_deg AS lon
FROM flights_features f LEFT JOIN dim d ON f.airport = d.faa_code"""))
def q_flights_with_coords(spark, sf):
    f = flights_features(spark, sf).select("year", "month", "carrier", "airport", "delay_rate")
    return r6(AP.flights_with_coords(f, dim(spark, sf)))


@query("airport_points", oracle_with(["airports_raw"], DIM_SQL + """
SELECT latitude_deg AS latitude, longitude_deg AS longitude FROM dim
WHERE latitude_deg IS NOT NULL AND longitude_deg IS NOT NULL"""))
def q_airport_points(spark, sf):
    return AP.airport_points(dim(spark, sf))


_LABEL_SQL = """CASE WHEN iso_region IS NOT NULL THEN lab1 || ' (' || iso_region || ')' ELSE lab1 END"""


@query("airport_labels", oracle_with(["airports_raw"], DIM_SQL + f"""
, named AS (SELECT *, CASE WHEN municipality IS NOT NULL THEN municipality || ': ' || name ELSE name END AS lab1
  FROM dim WHERE name IS NOT NULL AND trim(name) <> ''),
lab AS (SELECT ordinal, {_LABEL_SQL} AS label, iata_code, faa_code, ident FROM named),
l AS (SELECT ordinal, label, 0 AS code_rank, upper(trim(iata_code)) AS code FROM lab
  UNION ALL SELECT ordinal, label, 1, upper(trim(faa_code)) FROM lab
  UNION ALL SELECT ordinal, label, 2, upper(trim(ident)) FROM lab)
SELECT code, arg_max(label, ordinal * 10 + code_rank) AS label FROM l
WHERE code IS NOT NULL AND code <> '' GROUP BY code"""))
def q_airport_labels(spark, sf):
    return AP.airport_labels(dim(spark, sf))


_PRESET_SQL_C = " UNION ALL ".join(f"SELECT '{c}' AS code, '{n}' AS name" for c, n in AP.CARRIER_PRESETS)
_PRESET_SQL_A = " UNION ALL ".join(f"SELECT '{c}' AS code, '{n}' AS name" for c, n in AP.AIRPORT_PRESETS)


def _name_dims(spark, sf):
    from tarmac.fixtures import table
    carriers = (table(spark, sf, "region")
                .select(F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("code"),
                        F.col("r_name").alias("name"))
                .unionByName(spark.createDataFrame(AP.CARRIER_PRESETS, "code string, name string")))
    airports = (table(spark, sf, "nation")
                .select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("code"),
                        F.col("n_name").alias("name"))
                .unionByName(spark.createDataFrame(AP.AIRPORT_PRESETS, "code string, name string")))
    return carriers, airports


@query("preset_names", oracle_with(["prediction_history"], f"""
, cd AS (SELECT concat('C', CAST(r_regionkey AS STRING)) AS code, r_name AS name FROM region UNION ALL {_PRESET_SQL_C}),
ad AS (SELECT concat('A', CAST(n_nationkey AS STRING)) AS code, n_name AS name FROM nation UNION ALL {_PRESET_SQL_A})
SELECT h."timestamp", h.carrier, h.airport, cd.name AS carrier_display, ad.name AS airport_display
FROM prediction_history h LEFT JOIN cd ON h.carrier = cd.code LEFT JOIN ad ON h.airport = ad.code"""))
def q_preset_names(spark, sf):
    c, a = _name_dims(spark, sf)
    h = load(spark, sf, "prediction_history").select("timestamp", "carrier", "airport")
    return AP.preset_names(h, c, a)


# ---------------------------------------------------------------- weather
ARCHIVE_CHUNK = 1024


def _archive_lines(daily):
    """Fixture packing: weather_daily rows -> archive documents per
    (airport, year) with parallel daily arrays. A document holds at most
    ``ARCHIVE_CHUNK`` observations (chunks of the observation id), so no
    group grows with the data."""
    rows = F.sort_array(F.collect_list(F.struct("time", *S.WEATHER_COLUMNS)))
    daily = daily.withColumn("chunk", F.floor(F.col("obs_id") / ARCHIVE_CHUNK))

    def field(name):
        return F.transform("r", lambda x: x.getField(name)).alias(name)

    return (daily.groupBy("airport", "year", "chunk").agg(rows.alias("r"))
                 .select("airport", "year",
                         F.struct(field("time"), *[field(c) for c in S.WEATHER_COLUMNS]).alias("daily")))


@query("weather_json_to_daily", oracle_with(["weather_daily"], f"""
SELECT airport, year, time, {", ".join(S.WEATHER_COLUMNS)} FROM weather_daily"""))
def q_weather_json_to_daily(spark, sf):
    path = scratch_path(spark, "weather_archive")
    _archive_lines(load(spark, sf, "weather_daily")).write.mode("overwrite").json(path)
    return W.archive_to_daily(IO.read_weather_archive(spark, path))


@query("weather_monthly", oracle_with(["weather_daily"], MONTHLY_SQL + f"""
SELECT airport, year, month, {_rsel(S.WEATHER_COLUMNS)} FROM monthly"""))
def q_weather_monthly(spark, sf):
    return r6(monthly(spark, sf))


@query("weather_cache_explode", oracle_with(["weather_daily"], MONTHLY_SQL + f"""
SELECT airport, year, month, {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in S.WEATHER_COLUMNS)} FROM monthly
UNION ALL SELECT 'A99', 1999, 1, 0.0, 0.0, 0.0"""))
def q_weather_cache_explode(spark, sf):
    path = scratch_path(spark, "weather_cache")
    lines = W.monthly_to_cache_lines(monthly(spark, sf))
    malformed = spark.createDataFrame([('{"A99_1999_1": "unavailable"}',)], "value string")
    lines.unionByName(malformed).write.mode("overwrite").text(path)
    return r6(W.cache_to_monthly(IO.read_weather_cache_lines(spark, path)))


def _refetch(daily):
    """Fixture: the latest year fetched again, now holding daily maxima."""
    latest = daily.select(F.max("year")).scalar()
    return (daily.where(F.col("year") == latest)
                 .withColumn("month", F.month(F.try_to_timestamp("time").cast("date")))
                 .where(F.col("month").isNotNull())
                 .groupBy(*W.KEY).agg(*[F.max(c).alias(c) for c in S.WEATHER_COLUMNS]))


@query("weather_cache_upsert", oracle_with(["weather_daily"], MONTHLY_SQL + f"""
, ly AS (SELECT max(year) AS y FROM weather_daily),
newer AS (SELECT airport, year, CAST(month(try_cast(time AS DATE)) AS INT) AS month,
  {", ".join(f"max({c}) AS {c}" for c in S.WEATHER_COLUMNS)}
  FROM weather_daily WHERE year = (SELECT y FROM ly) AND try_cast(time AS DATE) IS NOT NULL GROUP BY 1, 2, 3)
SELECT airport, year, month, {_rsel(S.WEATHER_COLUMNS)} FROM monthly m
WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.airport = m.airport AND n.year = m.year AND n.month = m.month)
UNION ALL SELECT airport, year, month, {_rsel(S.WEATHER_COLUMNS)} FROM newer"""))
def q_weather_cache_upsert(spark, sf):
    path = scratch_path(spark, "weather_cache_tbl")
    daily = load(spark, sf, "weather_daily")
    IO.write_table(monthly(spark, sf), path, ["year"])
    new = _refetch(daily)
    old = IO.read_table(spark, path)
    touched = new.select("year").distinct()
    # only the touched year partitions are rewritten; lineage to the files
    # being replaced is cut by a reliable checkpoint first
    merged = W.upsert_latest(old.join(touched, "year", "left_semi"), new).checkpoint(eager=True)
    IO.write_table(merged, path, ["year"], dynamic=True)
    return r6(IO.read_table(spark, path).select("airport", "year", "month", *S.WEATHER_COLUMNS))


@query("weather_fetch_plan", oracle_with(["flights_raw", "airports_raw", "weather_daily"], DIM_SQL + """
, combos AS (SELECT DISTINCT f.airport, d.latitude_deg AS lat, d.longitude_deg AS lon, f.year
  FROM (SELECT DISTINCT airport, year FROM flights_raw) f LEFT JOIN dim d ON f.airport = d.faa_code)
SELECT airport, lat, lon, year,
  'https://archive-api.open-meteo.com/v1/archive?latitude=' || CAST(lat AS STRING) || '&longitude=' || CAST(lon AS STRING)
  || '&start_date=' || CAST(year AS STRING) || '-01-01&end_date=' || CAST(year AS STRING)
  || '-12-31&daily=temperature_2m_mean,precipitation_sum,windspeed_10m_max&timezone=UTC' AS url
FROM combos c WHERE lat IS NOT NULL AND lon IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM weather_daily w WHERE w.airport = c.airport AND w.year = c.year)"""))
def q_weather_fetch_plan(spark, sf):
    return W.fetch_plan(load(spark, sf, "flights_raw"), dim(spark, sf), load(spark, sf, "weather_daily"))


_FW_COLS = S.REQUIRED_COLUMNS + ["delay_rate", "avg_delay_per_flight", "high_delay_risk"] + S.WEATHER_COLUMNS
_FW_SQL = MONTHLY_SQL + f"""
, fw AS (SELECT f.*, {", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in S.WEATHER_COLUMNS)}
  FROM flights_features f LEFT JOIN monthly m ON f.airport = m.airport AND f.year = m.year AND f.month = m.month)
"""


@query("weather_enrich", oracle_with(["flights_features", "weather_daily"], _FW_SQL + f"""
SELECT {", ".join(S.REQUIRED_COLUMNS)}, {_rsel(["delay_rate", "avg_delay_per_flight"])}, high_delay_risk,
  {_rsel(S.WEATHER_COLUMNS)} FROM fw"""))
def q_weather_enrich(spark, sf):
    return r6(flights_weather(spark, sf).select(*_FW_COLS))


_MAP_SQL = _FW_SQL + DIM_SQL + """
, pts AS (SELECT fw.airport, d.latitude_deg AS lat, d.longitude_deg AS lon, avg(fw.temperature_2m_mean) AS temperature_2m_mean
  FROM fw LEFT JOIN dim d ON fw.airport = d.faa_code
  WHERE fw.year = (SELECT max(year) FROM fw) AND d.latitude_deg IS NOT NULL AND d.longitude_deg IS NOT NULL
  GROUP BY 1, 2, 3)
"""


@query("weather_map", oracle_with(["flights_features", "weather_daily", "airports_raw"], _MAP_SQL + """
SELECT airport, lat, lon, round(temperature_2m_mean, 6) AS temperature_2m_mean FROM pts"""))
def q_weather_map(spark, sf):
    return r6(W.weather_map(flights_weather(spark, sf), dim(spark, sf), "temperature"))


@query("weather_kpis", oracle_with(["flights_features", "weather_daily", "airports_raw"], _MAP_SQL + """
SELECT round(min(temperature_2m_mean), 6) AS kpi_min, round(avg(temperature_2m_mean), 6) AS kpi_mean,
  round(max(temperature_2m_mean), 6) AS kpi_max FROM pts"""))
def q_weather_kpis(spark, sf):
    pts = W.weather_map(flights_weather(spark, sf), dim(spark, sf), "temperature")
    return r6(W.weather_kpis(pts, "temperature_2m_mean"))


# ---------------------------------------------------------------- files
@query("read_flights_csv", oracle_with(["flights_raw"], "SELECT * FROM flights_raw"))
def q_read_flights_csv(spark, sf):
    path = scratch_path(spark, "flights_csv")
    IO.write_csv(load(spark, sf, "flights_raw"), path)
    return IO.read_flights_csv(spark, path)


_FEAT_SQL = f"""SELECT {", ".join(S.REQUIRED_COLUMNS)}, {_rsel(["delay_rate", "avg_delay_per_flight"])},
  high_delay_risk FROM flights_features"""


@query("write_base", oracle_with(["flights_features"], _FEAT_SQL))
def q_write_base(spark, sf):
    path = scratch_path(spark, "base")
    IO.write_table(flights_features(spark, sf), path)
    return r6(IO.read_table(spark, path))


@query("read_with_fallback", oracle_with(["flights_features"], _FEAT_SQL))
def q_read_with_fallback(spark, sf):
    primary = scratch_path(spark, "flight_weather_absent")
    fallback = scratch_path(spark, "train_weather")
    IO.write_table(flights_features(spark, sf), fallback)
    return r6(IO.read_with_fallback(spark, [primary, fallback]))


_HIST_SQL = """SELECT "timestamp", year, month, carrier, airport, arr_flights, arr_del15,
  round(high_delay_risk_proba, 6) AS high_delay_risk_proba, high_delay_risk_label,
  round(avg_delay_per_flight, 6) AS avg_delay_per_flight FROM prediction_history"""


@query("history_append", oracle_with(["prediction_history"], _HIST_SQL))
def q_history_append(spark, sf):
    path = scratch_path(spark, "history")
    h = load(spark, sf, "prediction_history")
    start = IO.history_load(spark, path)           # absent -> empty
    IO.history_append(start, path)
    IO.history_append(h.where("high_delay_risk_label = 0"), path)
    IO.history_append(h.where("high_delay_risk_label = 1"), path)
    return r6(IO.history_load(spark, path))


@query("history_compact", oracle_with(["prediction_history"], _HIST_SQL))
def q_history_compact(spark, sf):
    """Appends in small files, compacted and vacuumed twice, with an append
    in between: the rows stay as they are."""
    path = scratch_path(spark, "history")
    h = load(spark, sf, "prediction_history")
    for part in range(4):
        IO.history_append(h.where(F.col("month") % 4 == part).repartition(6), path)
        if part % 2:
            IO.history_compact(spark, path)
    IO.history_vacuum(spark, path)
    IO.history_append(h.where("month IS NULL"), path)
    return r6(IO.history_load(spark, path))


@query("history_export", oracle_with(["prediction_history"], _HIST_SQL))
def q_history_export(spark, sf):
    path, out = scratch_path(spark, "history"), scratch_path(spark, "history_csv")
    IO.history_append(load(spark, sf, "prediction_history"), path)
    IO.history_export(spark, path, out)
    return r6(IO.history_read_export(spark, out))


@query("history_clear", oracle_with(["prediction_history"],
                                    "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM prediction_history"))
def q_history_clear(spark, sf):
    path = scratch_path(spark, "history")
    IO.history_append(load(spark, sf, "prediction_history"), path)
    before = IO.history_load(spark, path).count()
    IO.history_clear(spark, path)
    after = IO.history_load(spark, path).select(F.count(F.lit(1)).alias("rows_after"))
    return after.select(F.lit(before).cast("long").alias("rows_before"), "rows_after")
