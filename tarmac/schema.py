"""Column contracts and explicit schemas (no schema inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names and thresholds that must equal the analysed
# pipeline's for identical results.
# ---------------------------------------------------------------------------
REQUIRED_COLUMNS = [
    "year", "month", "carrier", "carrier_name", "airport", "airport_name",
    "arr_flights", "arr_del15", "carrier_ct", "weather_ct", "nas_ct",
    "security_ct", "late_aircraft_ct", "arr_cancelled", "arr_diverted",
    "arr_delay", "carrier_delay", "weather_delay", "nas_delay",
    "security_delay", "late_aircraft_delay",
]
NUMERIC_COLUMNS = [
    "arr_flights", "arr_del15", "carrier_ct", "weather_ct", "nas_ct",
    "security_ct", "late_aircraft_ct", "arr_cancelled", "arr_diverted",
    "arr_delay", "carrier_delay", "weather_delay", "nas_delay",
    "security_delay", "late_aircraft_delay",
]
WEATHER_COLUMNS = ["temperature_2m_mean", "precipitation_sum", "windspeed_10m_max"]
RATE_COLUMNS = ["delay_rate", "avg_delay_per_flight"]
CATEGORICAL_COLUMNS = ["carrier", "carrier_name", "airport", "airport_name", "year", "month"]
CAUSES = ["carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"]
COUNT_COLUMNS = ["arr_flights", "arr_del15", "carrier_ct", "weather_ct", "nas_ct",
                 "security_ct", "late_aircraft_ct", "arr_cancelled", "arr_diverted"]
DELAY_COLUMNS = ["arr_delay", "carrier_delay", "weather_delay", "nas_delay",
                 "security_delay", "late_aircraft_delay"]
HIGH_DELAY_RATE_THRESHOLD = 0.25
TARGET_CLASSIFICATION = "high_delay_risk"
TARGET_REGRESSION = "avg_delay_per_flight"
AIRPORT_KEEP_COLUMNS = ["ident", "name", "municipality", "iso_region", "iata_code",
                        "local_code", "latitude_deg", "longitude_deg"]
HISTORY_COLUMNS = ["timestamp", "year", "month", "carrier", "airport", "arr_flights",
                   "arr_del15", "high_delay_risk_proba", "high_delay_risk_label",
                   "avg_delay_per_flight"]
# Request bounds of the scoring contract.
YEAR_MIN, YEAR_MAX = 1980, 2100
MONTH_MIN, MONTH_MAX = 1, 12
COUNT_LIMIT = float(2 ** 63)   # counts from here on are no bigint
# Risk levels: label at p >= 0.5; three levels cut at 0.3 and 0.7.
LABEL_CUT = 0.5
RISK_LOW_CUT, RISK_HIGH_CUT = 0.3, 0.7
# Weather archive request.
WEATHER_ARCHIVE_URL = "https://archive-api.open-meteo.com/v1/archive"
# (base URL, latitude, longitude, year, year, daily variable list)
WEATHER_URL_FORMAT = "%s?latitude=%s&longitude=%s&start_date=%d-01-01&end_date=%d-12-31&daily=%s&timezone=UTC"
# Baseline models (strict-cleaned data with extended rates).
BASELINE_CATEGORICAL = ["carrier", "carrier_name", "airport", "airport_name"]
BASELINE_NUMERIC_CLF = ["year", "month", "arr_flights", "delay_rate", "avg_delay_per_flight",
                        "cancel_rate", "divert_rate", "carrier_delay_per_flight",
                        "weather_delay_per_flight", "nas_delay_per_flight",
                        "security_delay_per_flight", "late_aircraft_delay_per_flight"]
BASELINE_NUMERIC_REG = ["year", "month", "arr_flights", "delay_rate", "cancel_rate", "divert_rate",
                        "carrier_delay_per_flight", "weather_delay_per_flight",
                        "nas_delay_per_flight", "security_delay_per_flight",
                        "late_aircraft_delay_per_flight"]
# ---------------------------------------------------------------------------

# Production feature set (26 columns, leaks the targets, kept for parity by
# name) and two honest ones: without the two target-defining rates, and only
# with what is known before a month is flown. ``delay_rate`` is ``arr_del15 /
# arr_flights`` and ``avg_delay_per_flight`` is ``arr_delay / arr_flights``;
# the causes' counts and minutes add up to those, so all of them tell.
FEATURES_REFERENCE = NUMERIC_COLUMNS + WEATHER_COLUMNS + RATE_COLUMNS + CATEGORICAL_COLUMNS
FEATURES_NO_RATES = NUMERIC_COLUMNS + WEATHER_COLUMNS + CATEGORICAL_COLUMNS
FEATURES_NO_LEAK = ["arr_flights", "arr_cancelled", "arr_diverted"] + WEATHER_COLUMNS + CATEGORICAL_COLUMNS
FEATURE_SETS = {"reference": FEATURES_REFERENCE, "no_rates": FEATURES_NO_RATES, "no_leak": FEATURES_NO_LEAK}
DEFAULT_FEATURES = "no_leak"


def numeric_part(features: list[str]) -> list[str]:
    return [c for c in features if c not in CATEGORICAL_COLUMNS]


def categorical_part(features: list[str]) -> list[str]:
    return [c for c in features if c in CATEGORICAL_COLUMNS]


FLIGHTS_RAW = T.StructType(
    [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ["carrier", "carrier_name", "airport", "airport_name"]]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_COLUMNS]
)

AIRPORTS_RAW = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ["ident", "name", "municipality", "iso_region", "iso_country", "iata_code", "local_code"]]
    + [T.StructField("latitude_deg", T.DoubleType()), T.StructField("longitude_deg", T.DoubleType())]
)

COORDINATES = T.StructType([T.StructField("airport", T.StringType()), T.StructField("lat", T.DoubleType()),
                            T.StructField("lon", T.DoubleType())])

WEATHER_ARCHIVE = T.StructType([
    T.StructField("airport", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m_mean", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
        T.StructField("windspeed_10m_max", T.ArrayType(T.DoubleType())),
    ])),
])

WEATHER_CACHE_VALUE = T.StructType(
    [T.StructField("month", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_COLUMNS]
)

HISTORY = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("carrier", T.StringType()),
    T.StructField("airport", T.StringType()),
    T.StructField("arr_flights", T.LongType()),
    T.StructField("arr_del15", T.LongType()),
    T.StructField("high_delay_risk_proba", T.DoubleType()),
    T.StructField("high_delay_risk_label", T.IntegerType()),
    T.StructField("avg_delay_per_flight", T.DoubleType()),
])

SCORE_REQUEST = T.StructType(
    [T.StructField("request_id", T.LongType()),
     T.StructField("year", T.LongType()), T.StructField("month", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ["carrier", "carrier_name", "airport", "airport_name"]]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_COLUMNS + WEATHER_COLUMNS]
)

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("model_path", T.StringType()),
])
