import numpy as np
from pyspark.sql import functions as F

from tarmac.operators.ranks import exact_quantiles, prefix_sum


def test_exact_quantiles_match_numpy_with_skew_and_ties(spark):
    rng = np.random.default_rng(1)
    hot = [("hot", float(v)) for v in rng.integers(0, 50, 3000)]      # one key holds most rows, many ties
    cold = [("cold", float(v)) for v in rng.normal(size=200)]
    one = [("one", 7.0)]
    df = spark.createDataFrame(hot + cold + one + [("hot", None)], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.7, 0.85, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for key, vals in (("hot", [v for _, v in hot]), ("cold", [v for _, v in cold]), ("one", [7.0])):
        for p in probs:
            assert abs(got[(key, p)] - np.quantile(vals, p)) < 1e-9, (key, p)


def test_sort_key_keeps_order_and_value(spark):
    from tarmac.operators.ranks import from_sort_key, sort_key
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64)
    near = np.array([np.nextafter(2.0 ** e, side) for e in (-1022, -1021, -3, 0, 1, 52, 1023) for side in (0.0, 2.0 ** e, np.inf)])
    some = np.array([0.0, -0.0, 1.0, -1.0, 5e-324, 2.2e-308, 1.7976931348623157e308, np.inf, -np.inf, 0.1, 3.0])
    vals = np.concatenate([bits[~np.isnan(bits)], near, -near, some])
    df = spark.createDataFrame([(float(v),) for v in [*vals, np.nan]], "v double")
    out = df.select("v", sort_key(F.col("v")).alias("k"), from_sort_key(sort_key(F.col("v"))).alias("back")).collect()
    for r in out:
        assert r["back"] == r["v"] or (np.isnan(r["v"]) and np.isnan(r["back"])), r
        if not np.isnan(r["v"]):
            raw = int(np.abs(np.float64(r["v"])).view(np.int64))
            assert r["k"] == (-raw if r["v"] < 0 else raw), r
    assert max(out, key=lambda r: r["k"])["v"] != max(vals)      # NaN is above infinity


def test_quantiles_of_close_values_need_every_round(spark):
    """Values that differ in their last bits only, and an empty table."""
    vals = [float(1.0 + i * 2.0 ** -52) for i in range(500)] + [-1e-310 * i for i in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.01, 0.37, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], "v", probs).collect()}
    low, high = (np.quantile(vals, probs, method=m) for m in ("lower", "higher"))
    assert all(low[i] <= got[p] <= high[i] for i, p in enumerate(probs))
    assert all(got[p] == np.quantile(vals, p) for p in probs if low[probs.index(p)] == high[probs.index(p)])
    assert exact_quantiles(df.where("v > 5"), [], "v", probs).count() == 0


def test_no_value_is_shuffled(spark):
    """What meets the first exchange is counts of cells, not values."""
    df = spark.range(0, 200000).select((F.rand(3) + F.col("id")).alias("v"))
    from tarmac.operators import ranks
    counts = df.select(ranks.sort_key(F.col("v")).alias("k")).groupBy(F.shiftright("k", 48).alias("c")).count()
    assert counts.count() < 300
    q = ranks.exact_quantiles(df, [], "v", [0.5]).first()["quantile"]
    assert abs(q - df.selectExpr("percentile(v, 0.5) AS p").first()["p"]) < 1e-9


def test_prefix_sum(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("o"), (F.col("id") % 3).alias("w"), (F.col("id") % 2).alias("k"))
    out = prefix_sum(df, ["k"], "o", "w", "cb", n_slices=5).collect()
    for r in out:
        expect = sum(i % 3 for i in range(r["o"]) if i % 2 == r["k"])
        assert r["cb"] == expect


def test_approx_quantiles_close(spark):
    from tarmac.operators.eda import quantiles
    df = spark.range(0, 20001).select(F.lit("c").alias("k"), F.col("id").cast("double").alias("v"))
    ex = {r["prob"]: r["quantile"] for r in quantiles(df, ["k"], "v", [0.25, 0.5], exact=True).collect()}
    ap = {r["prob"]: r["quantile"] for r in quantiles(df, ["k"], "v", [0.25, 0.5], exact=False).collect()}
    assert ex == {0.25: 5000.0, 0.5: 10000.0}
    assert all(abs(ap[p] - ex[p]) <= 2 for p in ex)


def test_binned_density_close_to_exact(spark):
    import numpy as np
    from tarmac.operators.eda import density_curve
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=3000)], "x double")
    ex = {r["i"]: r["density"] for r in density_curve(df, ["x"], 50).collect()}
    ap = {r["i"]: r["density"] for r in density_curve(df, ["x"], 50, exact=False, bins=4096).collect()}
    assert max(abs(ex[i] - ap[i]) for i in ex) < 1e-3
    # exact path equals a direct numpy evaluation
    v = np.array([r["x"] for r in df.collect()])
    bw = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 50)
    ref = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / bw) ** 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
    assert max(abs(ex[i] - ref[i]) for i in range(50)) < 1e-9


def test_more_than_two_thousand_keys(spark):
    df = spark.range(0, 9000).select((F.col("id") % 3000).alias("k"), F.col("id").cast("double").alias("v"))
    got = {r["k"]: r["quantile"] for r in exact_quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {k: float(k + 3000) for k in range(3000)}


def test_slices_cover_a_hot_key(spark):
    from tarmac.operators.ranks import _sliced
    df = spark.range(0, 4000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    ends = _sliced(df, ["k"], "v", 8).groupBy("_slice").agg(F.min("v"), F.max("v"), F.count("v")).orderBy("_slice").collect()
    assert len(ends) >= 6 and all(a[2] < b[1] for a, b in zip(ends, ends[1:])) and max(r[3] for r in ends) < 2000


def test_global_quantiles_no_cartesian(spark):
    from tarmac.operators.ranks import exact_quantiles
    df = spark.range(0, 1001).select(F.col("id").cast("double").alias("v"))
    q = exact_quantiles(df, [], "v", [0.1, 0.5])
    assert {r["prob"]: r["quantile"] for r in q.collect()} == {0.1: 100.0, 0.5: 500.0}
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
