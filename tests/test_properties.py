"""Property tests (hypothesis): operators against plain-Python models."""
import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarmac import schema as S
from tarmac.operators import score as SC
from tarmac.operators.ranks import exact_quantiles

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

num = st.one_of(st.none(), st.floats(min_value=-50, max_value=500, allow_nan=False, width=32))
row = st.tuples(st.one_of(st.none(), st.integers(1970, 2110)), st.one_of(st.none(), st.integers(-1, 14)),
                st.one_of(st.none(), st.sampled_from(["C1", "C2"])), num, num, num)


def _model(year, month, carrier, flights, delay, temp):
    errors = 0
    errors += year is None or not (1980 <= year <= 2100)
    errors += month is None or not (1 <= month <= 12)
    errors += carrier is None
    f = 0 if flights is None or flights < 0 else int(flights)
    d = 0.0 if delay is None or delay < 0 else delay
    t = 0.0 if temp is None else temp
    return errors, f, d, t


@SETTINGS
@given(st.lists(row, min_size=1, max_size=40))
def test_validation_matches_model(spark, rows):
    base = {c: 1.0 for c in S.NUMERIC_COLUMNS + S.WEATHER_COLUMNS}
    data = []
    for i, (y, m, c, f, d, t) in enumerate(rows):
        v = dict(base, arr_flights=f, arr_delay=d, temperature_2m_mean=t)
        data.append((i, y, m, c, "n", "A", "m", *[v[k] for k in S.NUMERIC_COLUMNS + S.WEATHER_COLUMNS]))
    out = {r["request_id"]: r for r in SC.validate_requests(spark.createDataFrame(data, S.SCORE_REQUEST)).collect()}
    for i, r in enumerate(rows):
        errors, f, d, t = _model(*r)
        o = out[i]
        assert len(o["errors"]) == errors and o["valid"] == (errors == 0)
        assert o["arr_flights"] == f and math.isclose(o["arr_delay"], d) and math.isclose(o["temperature_2m_mean"], t)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-5, 5)), min_size=1, max_size=200),
       st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=4))
def test_quantiles_match_numpy(spark, pairs, probs):
    df = spark.createDataFrame([(k, float(v)) for k, v in pairs], "k string, v double")
    got = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", probs, n_slices=3).collect()}
    for key in {k for k, _ in pairs}:
        vals = [float(v) for k, v in pairs if k == key]
        for p in probs:
            assert math.isclose(got[(key, float(p))], float(np.quantile(vals, p)), abs_tol=1e-9)
