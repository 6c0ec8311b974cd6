"""Queries: regularised boosting checked by value, compiled scoring, honest
feature sets.

The boosted queries have statements that train: every level of every tree is
a chain of aggregates in plain SQL, so the predicted values themselves are
compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.fixtures import oracle_with
from tarmac.operators import boosting as B
from tarmac.operators import clean as C
from tarmac.operators import score as SC
from tarmac.plans import q_models as Q
from tarmac.plans.catalog import load, query, r6
from tarmac.plans.q_split import _FWS_SQL, split_weather

KEYS = ["year", "month", "carrier", "airport"]
NUMERIC = S.numeric_part(S.FEATURES_NO_LEAK)
CATEGORICAL = ["carrier", "airport", "month"]
PARAMS = B.Params(n_estimators=3, max_depth=3, learning_rate=0.3, min_child_weight=2.0, gamma=0.1, reg_lambda=1.0, reg_alpha=0.5)
N_BINS = 16


def _boost_sql(label: str, kind: str, p: B.Params) -> str:
    nn = len(NUMERIC)
    g, h = ("1 / (1 + exp(-f)) - y", "1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f)))") if kind == "classifier" else ("f - y", "1.0")
    start = "ln(avg(y) / (1 - avg(y)))" if kind == "classifier" else "avg(y)"
    soft = f"(sign({{0}}) * greatest(abs({{0}}) - {p.reg_alpha}, 0))"

    def part(gg, hh):
        return f"pow({soft.format(gg)}, 2) / ({hh} + {p.reg_lambda})"

    ctes = [f"""r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {", ".join(KEYS)}) AS rid, {", ".join(KEYS)}, split, CAST({label} AS DOUBLE) AS y,
  [{", ".join(f"CAST({c} AS DOUBLE)" for c in NUMERIC)}] AS xs, [{", ".join(f"CAST({c} AS VARCHAR)" for c in CATEGORICAL)}] AS vs
  FROM s WHERE split IN ('train', 'test'))""",
            f"xl AS MATERIALIZED (SELECT rid, split, unnest(range({nn})) AS c, unnest(xs) AS x FROM r)",
            f"vl AS (SELECT rid, split, {nn} + unnest(range({len(CATEGORICAL)})) AS c, unnest(vs) AS v FROM r)",
            f"""qcut AS MATERIALIZED (SELECT DISTINCT c, cut FROM (SELECT c, unnest(quantile_cont(x, [{", ".join(str(i / N_BINS) for i in range(1, N_BINS))}])) AS cut, max(x) AS top
  FROM xl WHERE split = 'train' GROUP BY c) WHERE cut < top)""",
            "cats AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS b FROM (SELECT DISTINCT c, v FROM vl WHERE split = 'train' AND v IS NOT NULL))",
            f"""cell AS MATERIALIZED (SELECT rid, split, xl.c, count(cut) AS b FROM xl LEFT JOIN qcut ON qcut.c = xl.c AND cut < x GROUP BY rid, split, xl.c
  UNION ALL SELECT rid, split, vl.c, b FROM vl JOIN cats ON cats.c = vl.c AND cats.v = vl.v)""",
            "last AS (SELECT c, count(*) AS b FROM qcut GROUP BY c)",
            f"f0 AS MATERIALIZED (SELECT rid, split, y, (SELECT {start} FROM r WHERE split = 'train') AS f FROM r)"]
    for t in range(p.n_estimators):
        ctes.append(f"n{t}_0 AS MATERIALIZED (SELECT rid, split, {g} AS g, {h} AS h, 0 AS node FROM f{t})")
        for d in range(p.max_depth):
            a, k = f"n{t}_{d}", f"{t}_{d}"
            ctes += [f"""h{k} AS (SELECT node, c, b, sum(g) AS g, sum(h) AS h FROM {a} JOIN cell USING (rid) WHERE {a}.split = 'train' AND node >= {2 ** d - 1} GROUP BY node, c, b)""",
                     f"t{k} AS (SELECT node, sum(g) AS tg, sum(h) AS th FROM {a} WHERE split = 'train' GROUP BY node)",
                     f"""l{k} AS (SELECT node, h.c, h.b, CASE WHEN h.c < {nn} THEN sum(g) OVER w ELSE g END AS lg, CASE WHEN h.c < {nn} THEN sum(h) OVER w ELSE h END AS lh
  FROM h{k} h LEFT JOIN last ON last.c = h.c WHERE h.c >= {nn} OR true WINDOW w AS (PARTITION BY node, h.c ORDER BY h.b))""",
                     f"""b{k} AS MATERIALIZED (SELECT node, c, b FROM (
  SELECT node, l.c, l.b, round(0.5 * ({part("lg", "lh")} + {part("(tg - lg)", "(th - lh)")} - {part("tg", "th")}) - {p.gamma}, {B.DIGITS}) AS gain
  FROM l{k} l JOIN t{k} USING (node) LEFT JOIN last ON last.c = l.c
  WHERE lh >= {p.min_child_weight} AND th - lh >= {p.min_child_weight} AND (l.c >= {nn} OR l.b < coalesce(last.b, 0)))
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, c, b) = 1)""",
                     f"""n{t}_{d + 1} AS MATERIALIZED (SELECT a.rid, a.split, g, h,
  CASE WHEN s.node IS NULL THEN a.node WHEN coalesce(CASE WHEN s.c < {nn} THEN cell.b <= s.b ELSE cell.b = s.b END, false) THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END AS node
  FROM {a} a LEFT JOIN b{k} s ON s.node = a.node LEFT JOIN cell ON cell.rid = a.rid AND cell.c = s.c)"""]
        end = f"n{t}_{p.max_depth}"
        ctes += [f"w{t} AS (SELECT node, -{soft.format('sum(g)')} / (sum(h) + {p.reg_lambda}) * {p.learning_rate} AS w FROM {end} WHERE split = 'train' GROUP BY node)",
                 f"f{t + 1} AS MATERIALIZED (SELECT rid, f{t}.split, y, f + w AS f FROM f{t} JOIN {end} USING (rid) JOIN w{t} USING (node))"]
    out = "1 / (1 + exp(-f))" if kind == "classifier" else "f"
    return ",\n" + ",\n".join(ctes) + f"\nSELECT {', '.join(KEYS)}, round({out}, 6) AS predicted FROM r JOIN f{p.n_estimators} USING (rid) WHERE r.split = 'test'"


def _boosted(spark, sf, label, kind):
    df = split_weather(spark, sf)
    model = B.fit(df.where("split = 'train'"), NUMERIC, CATEGORICAL, label, kind, PARAMS, N_BINS)
    return r6(model.score(df.where("split = 'test'"), "predicted").select(*KEYS, "predicted"))


@query("boosted_classifier", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + _boost_sql(S.TARGET_CLASSIFICATION, "classifier", PARAMS)))
def q_boosted_classifier(spark, sf):
    return _boosted(spark, sf, S.TARGET_CLASSIFICATION, "classifier")


@query("boosted_regressor", oracle_with(["flights_features", "weather_daily"], _FWS_SQL + _boost_sql(S.TARGET_REGRESSION, "regressor", PARAMS)))
def q_boosted_regressor(spark, sf):
    return _boosted(spark, sf, S.TARGET_REGRESSION, "regressor")


def _projection_sql(columns):
    return _FWS_SQL + f"""
SELECT {", ".join(f"round({c}, 6) AS {c}" if c not in S.CATEGORICAL_COLUMNS else c for c in columns)} FROM s"""


@query("feature_projection_no_leak", oracle_with(["flights_features", "weather_daily"], _projection_sql(S.FEATURES_NO_LEAK)))
def q_feature_projection_no_leak(spark, sf):
    return r6(C.feature_projection(split_weather(spark, sf)))


@query("feature_projection_no_rates", oracle_with(["flights_features", "weather_daily"], _projection_sql(S.FEATURES_NO_RATES)))
def q_feature_projection_no_rates(spark, sf):
    return r6(C.feature_projection(split_weather(spark, sf), "no_rates"))


@query("check_score_values", oracle_with(["score_requests"], f"\n, v AS ({Q._VALID_SQL})\n" + """
SELECT request_id, 1 AS same_probability, 1 AS same_minutes FROM v WHERE valid = 1"""))
def q_check_score_values(spark, sf):
    """The compiled scores against the fitted pipelines' own transforms."""
    b = Q.bundle(spark, sf)
    requests = load(spark, sf, "score_requests")
    fitted = SC.score_batch(requests, b["clf"], b["reg"]).select(
        "request_id", F.col("high_delay_risk_proba").alias("p"), F.col("avg_delay_per_flight").alias("y"))
    both = Q.q_score_batch(spark, sf).join(fitted, "request_id", "full")

    def same(a, c):
        return F.coalesce((F.abs(F.col(a) - F.col(c)) <= 1e-9 * (1 + F.abs(F.col(c)))).cast("int"), F.lit(0))
    return both.select("request_id", same("high_delay_risk_proba", "p").alias("same_probability"), same("avg_delay_per_flight", "y").alias("same_minutes"))
