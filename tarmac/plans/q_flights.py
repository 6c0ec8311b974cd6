"""Queries over the monthly arrivals table: cleaning, targets, EDA."""

from __future__ import annotations

from tarmac import schema as S
from tarmac.fixtures import oracle_with
from tarmac.operators import clean as C
from tarmac.operators import contract as K
from tarmac.operators import eda as A
from tarmac.plans.catalog import _rsel, load, query, r6

EDA_NUMERIC = (["year", "month"] + S.NUMERIC_COLUMNS
               + ["delay_rate", "avg_delay_per_flight", "cancel_rate", "divert_rate"]
               + [f"{c}_per_flight" for c in S.CAUSES])
CAUSE_RATES = [f"{c}_per_flight" for c in S.CAUSES]
HIST_COLS = ["delay_rate", "avg_delay_per_flight"]


def flights_features(spark, sf):
    return C.prepare_base(load(spark, sf, "flights_raw"))


def flights_eda(spark, sf):
    return C.extended_rates(C.clean_strict(load(spark, sf, "flights_raw")))


# ---------------------------------------------------------------- cleaning
@query("clean_flights", oracle_with(["flights_raw"], f"""
SELECT year, month, carrier, carrier_name, airport, airport_name,
  greatest(coalesce(arr_flights, 0), 0) AS arr_flights,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in S.NUMERIC_COLUMNS[1:])}
FROM flights_raw"""))
def q_clean_flights(spark, sf):
    return C.clean_flights(load(spark, sf, "flights_raw"), S.NUMERIC_COLUMNS)


@query("mandatory_features", oracle_with(["flights_features"], f"""
SELECT {", ".join(c for c in S.REQUIRED_COLUMNS)},
  round(delay_rate, 6) AS delay_rate, round(avg_delay_per_flight, 6) AS avg_delay_per_flight,
  high_delay_risk
FROM flights_features"""))
def q_mandatory_features(spark, sf):
    return r6(flights_features(spark, sf))


@query("clean_strict", oracle_with(["flights_raw"], """
SELECT * FROM flights_raw
WHERE arr_flights > 0 AND year IS NOT NULL AND month IS NOT NULL
  AND carrier IS NOT NULL AND airport IS NOT NULL"""))
def q_clean_strict(spark, sf):
    return C.clean_strict(load(spark, sf, "flights_raw"))


@query("extended_rates", oracle_with(["flights_eda"], f"""
SELECT year, month, carrier, airport, {_rsel(EDA_NUMERIC[17:])} FROM flights_eda"""))
def q_extended_rates(spark, sf):
    return r6(flights_eda(spark, sf).select("year", "month", "carrier", "airport", *EDA_NUMERIC[17:]))


@query("schema_contract", oracle_with(["flights_features"], " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, 'present' AS status, count({c}) AS non_null FROM flights_features"
     for c in S.REQUIRED_COLUMNS]
    + [f"SELECT '{c}' AS column_name, 'missing' AS status, CAST(NULL AS BIGINT) AS non_null" for c in S.WEATHER_COLUMNS]
    + [f"SELECT '{c}' AS column_name, 'extra' AS status, CAST(NULL AS BIGINT) AS non_null"
       for c in ["delay_rate", "avg_delay_per_flight", "high_delay_risk"]])))
def q_schema_contract(spark, sf):
    return K.schema_diff(flights_features(spark, sf), S.REQUIRED_COLUMNS + S.WEATHER_COLUMNS)


# ---------------------------------------------------------------- EDA
@query("eda_rate_by_month", oracle_with(["flights_eda"], """
SELECT month, round(avg(delay_rate), 6) AS mean_delay_rate FROM flights_eda GROUP BY month"""))
def q_eda_rate_by_month(spark, sf):
    return r6(A.mean_by(flights_eda(spark, sf), "month"))


@query("eda_rate_by_carrier", oracle_with(["flights_eda"], """
SELECT carrier, round(avg(delay_rate), 6) AS mean_delay_rate FROM flights_eda GROUP BY carrier"""))
def q_eda_rate_by_carrier(spark, sf):
    return r6(A.mean_by(flights_eda(spark, sf), "carrier", descending=True))


@query("target_distribution", oracle_with(["flights_features"], """
SELECT high_delay_risk, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM flights_features), 6) AS ratio
FROM flights_features GROUP BY high_delay_risk"""))
def q_target_distribution(spark, sf):
    return r6(A.target_distribution(flights_features(spark, sf)))


def _miss_sql(c, t):
    cond = f"{c} IS NULL" + (f" OR isnan({c})" if t == "double" else "")
    return f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM flights_raw"


_RAW_TYPES = [(f.name, f.dataType.simpleString()) for f in S.FLIGHTS_RAW.fields]


@query("missing_rates", oracle_with(["flights_raw"], " UNION ALL ".join(_miss_sql(c, t) for c, t in _RAW_TYPES)))
def q_missing_rates(spark, sf):
    return r6(A.missing_rates(load(spark, sf, "flights_raw")))


@query("column_info", oracle_with(["flights_raw"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null FROM flights_raw" for c, t in _RAW_TYPES)))
def q_column_info(spark, sf):
    return A.column_info(load(spark, sf, "flights_raw"))


def _describe_sql(c):
    v = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, count({v}) AS count, round(avg({v}), 6) AS mean, "
            f"round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min, "
            f"round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50, "
            f"round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS max FROM flights_eda")


@query("describe_numeric", oracle_with(["flights_eda"], " UNION ALL ".join(_describe_sql(c) for c in EDA_NUMERIC)))
def q_describe_numeric(spark, sf):
    return r6(A.describe_numeric(flights_eda(spark, sf), EDA_NUMERIC))


def _long_sql(cols, src):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {src} WHERE {c} IS NOT NULL AND NOT isnan({c})"
        for c in cols)


@query("histogram_50", oracle_with(["flights_eda"], f"""
, lf AS ({_long_sql(HIST_COLS, 'flights_eda')}),
rng AS (SELECT column_name,
   CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
   CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
   FROM lf GROUP BY column_name),
rw AS (SELECT column_name, lo, hi, (hi - lo) / 50 AS width FROM rng),
binned AS (SELECT lf.column_name, CAST(least(floor((value - lo) / width), 49) AS INT) AS bin, count(*) AS cnt
   FROM lf JOIN rw ON lf.column_name = rw.column_name GROUP BY 1, 2),
grid AS (SELECT column_name, CAST(b AS INT) AS bin, lo + b * width AS bin_lo,
   CASE WHEN b = 49 THEN hi ELSE lo + (b + 1) * width END AS bin_hi
   FROM rw, range(50) t(b))
SELECT g.column_name, g.bin, round(g.bin_lo, 6) AS bin_lo, round(g.bin_hi, 6) AS bin_hi,
  CAST(coalesce(b.cnt, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN binned b ON g.column_name = b.column_name AND g.bin = b.bin""".replace("\n, lf", ", lf", 1)))
def q_histogram_50(spark, sf):
    return r6(A.histogram(flights_eda(spark, sf), HIST_COLS, 50))


@query("density_curve", oracle_with(["flights_eda"], f"""
, lf AS ({_long_sql(HIST_COLS, 'flights_eda')}),
st AS (SELECT column_name, count(value) AS n, stddev_samp(value) AS sd, min(value) AS vmin, max(value) AS vmax
   FROM lf GROUP BY column_name),
grid AS (SELECT column_name, CAST(i AS INT) AS i, vmin + (vmax - vmin) * i / 199 AS x,
   sd * pow(n, -0.2) AS bw, n FROM st, range(200) t(i)),
b AS (SELECT lf.column_name, value, vmin, (vmax - vmin) / 8192 AS bin FROM lf JOIN st ON lf.column_name = st.column_name),
d AS (SELECT column_name, CASE WHEN bin > 0 THEN vmin + (least(floor((value - vmin) / CASE WHEN bin > 0 THEN bin ELSE 1 END), 8191) + 0.5) * bin
      ELSE vmin END AS value, count(*) AS w FROM b GROUP BY 1, 2)
SELECT g.column_name, g.i, round(g.x, 6) AS x,
  round(sum(d.w * exp(-0.5 * ((g.x - d.value) / g.bw) * ((g.x - d.value) / g.bw))) / (g.n * g.bw * sqrt(2 * pi())), 6) AS density
FROM grid g JOIN d ON g.column_name = d.column_name
GROUP BY g.column_name, g.i, g.x, g.bw, g.n"""))
def q_density_curve(spark, sf):
    return r6(A.density_curve(flights_eda(spark, sf), HIST_COLS, 200, exact=False))


@query("boxplot_causes", oracle_with(["flights_eda"], f"""
, lf AS ({_long_sql(CAUSE_RATES, 'flights_eda')}),
q AS (SELECT column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
   quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY column_name),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.column_name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN value >= lo_f AND value <= hi_f THEN value END), 6) AS whisker_lo,
  round(max(CASE WHEN value >= lo_f AND value <= hi_f THEN value END), 6) AS whisker_hi,
  count(CASE WHEN NOT (value >= lo_f AND value <= hi_f) THEN value END) AS n_outliers
FROM lf JOIN f ON lf.column_name = f.column_name
GROUP BY f.column_name, q1, median, q3"""))
def q_boxplot_causes(spark, sf):
    return r6(A.boxplot_stats(flights_eda(spark, sf), CAUSE_RATES))


@query("nonconstant_columns", oracle_with(["flights_eda"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(coalesce(var_samp(CAST({c} AS DOUBLE)) > 0, false) AS INT) AS keep FROM flights_eda"
    for c in EDA_NUMERIC)))
def q_nonconstant_columns(spark, sf):
    return A.nonconstant_columns(flights_eda(spark, sf), EDA_NUMERIC)


_VARS = ", ".join(f"var_samp(CAST({c} AS DOUBLE)) AS v_{c}" for c in EDA_NUMERIC)


def _corr_pairs_sql():
    parts = []
    for i, a in enumerate(EDA_NUMERIC):
        for b in EDA_NUMERIC[:i]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr, "
                         f"'{a}' AS ka, '{b}' AS kb FROM flights_eda")
    return (f", v AS (SELECT {_VARS} FROM flights_eda),\n"
            f"vl AS (UNPIVOT v ON COLUMNS(*) INTO NAME k VALUE var),\n"
            f"p AS ({' UNION ALL '.join(parts)})\n"
            "SELECT a, b, corr FROM p WHERE 'v_' || ka IN (SELECT k FROM vl WHERE var > 0) "
            "AND 'v_' || kb IN (SELECT k FROM vl WHERE var > 0)")


@query("corr_pairs", oracle_with(["flights_eda"], _corr_pairs_sql()))
def q_corr_pairs(spark, sf):
    df = flights_eda(spark, sf)
    return r6(A.corr_pairs(df, A.nonconstant_names(df, EDA_NUMERIC)))


@query("corr_target", oracle_with(["flights_eda"], f"""
, v AS (SELECT {_VARS} FROM flights_eda),
vl AS (UNPIVOT v ON COLUMNS(*) INTO NAME k VALUE var),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(abs(corr(CAST({c} AS DOUBLE), avg_delay_per_flight)), 6) AS abs_corr FROM flights_eda" for c in EDA_NUMERIC)})
SELECT column_name, abs_corr FROM c WHERE 'v_' || column_name IN (SELECT k FROM vl WHERE var > 0)"""))
def q_corr_target(spark, sf):
    df = flights_eda(spark, sf)
    return r6(A.corr_target(df, A.nonconstant_names(df, EDA_NUMERIC), "avg_delay_per_flight"))


@query("risk_buckets", oracle_with(["prediction_history"], """
SELECT "timestamp", airport, round(high_delay_risk_proba, 6) AS high_delay_risk_proba,
  CAST(CASE WHEN high_delay_risk_proba >= 0.5 THEN 1 ELSE 0 END AS INT) AS risk_label,
  CASE WHEN high_delay_risk_proba >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_text,
  CASE WHEN high_delay_risk_proba < 0.3 THEN 'low' WHEN high_delay_risk_proba < 0.7 THEN 'medium' ELSE 'high' END AS risk_level,
  printf('%.1f', high_delay_risk_proba * 100) || '%' AS risk_percent
FROM prediction_history"""))
def q_risk_buckets(spark, sf):
    h = load(spark, sf, "prediction_history").select("timestamp", "airport", "high_delay_risk_proba")
    return r6(C.risk_buckets(h))


@query("preview_rows", oracle_with(["flights_features"], f"""
SELECT {", ".join(S.REQUIRED_COLUMNS)}, round(delay_rate, 6) AS delay_rate,
  round(avg_delay_per_flight, 6) AS avg_delay_per_flight, high_delay_risk
FROM flights_features ORDER BY year, month, carrier, airport LIMIT 200"""))
def q_preview_rows(spark, sf):
    df = flights_features(spark, sf)
    return r6(df.orderBy("year", "month", "carrier", "airport").limit(200))
