import itertools

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tarmac.operators import explain as H
from tarmac.session import scratch_path


def _data(spark, n=400, p=4, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 2]) > 0).astype(float)
    yr = X[:, 0] * 2 + np.sin(X[:, 1]) + X[:, 2] * X[:, 3]
    rows = [(i, Vectors.dense(X[i].tolist()), float(y[i]), float(yr[i])) for i in range(n)]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("features", VectorUDT()),
                           T.StructField("label", T.DoubleType()), T.StructField("target", T.DoubleType())])
    return spark.createDataFrame(rows, schema), X


def _check_additivity(spark, model, df, scale):
    path = scratch_path(spark, "gbt_test")
    model.write().overwrite().save(path)
    nodes = H.tree_nodes(spark, path)
    attr, base = H.shap_values(df, nodes, "row_id", "features", scale)
    sums = {r["row_id"]: r["s"] for r in attr.groupBy("row_id").agg(F.sum("value").alias("s")).collect()}
    pred = model.transform(df)
    m = pred.select("row_id", H.margin(pred, scale).alias("m")).collect()
    for r in m:
        assert abs(base + sums.get(r["row_id"], 0.0) - r["m"]) < 1e-6
    return nodes


def test_shap_additivity_regressor(spark):
    df, _ = _data(spark)
    model = GBTRegressor(labelCol="target", maxIter=6, maxDepth=4, seed=1).fit(df)
    _check_additivity(spark, model, df, 1.0)


def test_shap_additivity_classifier_log_odds(spark):
    df, _ = _data(spark)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1, subsamplingRate=0.8).fit(df)
    nodes = _check_additivity(spark, model, df, 2.0)
    assert H.tree_gain(nodes).count() > 0


def test_shap_matches_exact_shapley_on_one_tree():
    """Path-dependent Tree SHAP equals the exact Shapley values of the
    cover-weighted conditional expectation (brute force over subsets)."""
    # depth-2 tree on 3 features: node covers 100 -> (60: f1<=0.5 -> 20/40) , (40: f2<=1 -> 10/30)
    leaves = [(1.0, [(0, True, [0.0], -1, 0.6), (1, True, [0.5], -1, 20 / 60)]),
              (2.0, [(0, True, [0.0], -1, 0.6), (1, False, [0.5], -1, 40 / 60)]),
              (3.0, [(0, False, [0.0], -1, 0.4), (2, True, [1.0], -1, 10 / 40)]),
              (5.0, [(0, False, [0.0], -1, 0.4), (2, False, [1.0], -1, 30 / 40)])]
    trees = [(1.0, leaves)]
    x = np.array([[0.7, 0.2, 3.0]])

    def value(S):
        tot = 0.0
        for v, path in leaves:
            w = 1.0
            for f, is_left, thr, _, ratio in path:
                if f in S:
                    go_left = x[0, f] <= thr[0]
                    w *= 1.0 if go_left == is_left else 0.0
                else:
                    w *= ratio
            tot += w * v
        return tot

    import math
    p = 3
    exact = np.zeros(p)
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for k in range(p):
            for S in itertools.combinations(others, k):
                wgt = math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p)
                exact[i] += wgt * (value(set(S) | {i}) - value(set(S)))
    got = H.shap_matrix(x, trees)[0]
    assert np.allclose(got, exact, atol=1e-12)
    assert abs(H.expected_value(trees) + got.sum() - value({0, 1, 2})) < 1e-12


def test_rows_of_one_file_are_many_tasks(spark):
    df, _ = _data(spark, 200)
    model = GBTRegressor(labelCol="target", maxIter=2, maxDepth=3, seed=1).fit(df)
    path = scratch_path(spark, "gbt_test")
    model.write().overwrite().save(path)
    attr, _ = H.shap_values(df.coalesce(1), H.tree_nodes(spark, path))
    tasks = attr.select("row_id", F.spark_partition_id().alias("task")).distinct()
    assert tasks.select("row_id").distinct().count() > 100 and tasks.select("task").distinct().count() >= spark.sparkContext.defaultParallelism


def test_importance_tables(spark):
    attr = spark.createDataFrame([(1, "a", 1.0), (1, "b", -2.0), (2, "a", -3.0)], "row_id long, feature string, value double")
    imp = {r["feature"]: r["importance"] for r in H.mean_abs_importance(attr).collect()}
    assert imp == {"a": 2.0, "b": 1.0}
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "feature string, importance double")
    b = spark.createDataFrame([("y", 3.0), ("z", 1.0)], "feature string, importance double")
    cmp = H.compare(a, b).collect()
    assert [r["feature"] for r in cmp] == ["x", "y", "z"]
    ov = H.overview(H.compare(a, b)).first()
    assert ov["clf_top_feature"] == "x" and ov["reg_top_feature"] == "y" and ov["consensus_features"] == 1


def test_vectorised_equals_per_leaf(spark):
    df, X = _data(spark, n=300, p=5, seed=3)
    model = GBTRegressor(labelCol="target", maxIter=4, maxDepth=5, seed=2).fit(df)
    path = scratch_path(spark, "gbt_vec")
    model.write().overwrite().save(path)
    trees = H._compile(H.tree_nodes(spark, path).toPandas())
    slow = H.shap_matrix(X, trees)
    fast = H.shap_matrix_vectorised(X, H.compile_vectorised(trees), chunk=64)
    assert np.allclose(slow, fast, atol=1e-10)


def test_invariant_checks_can_fail(spark):
    """A deliberate break of each row invariant shows."""
    from tarmac.plans import q_checks as Q
    good = spark.createDataFrame([(1, 0.7, 1, 3.0)], "request_id long, high_delay_risk_proba double, high_delay_risk_label int, avg_delay_per_flight double")
    assert tuple(Q.score_flags(good).first()) == (1, 1, 1, 1)
    bad = good.selectExpr("request_id", "1.5D AS high_delay_risk_proba", "0 AS high_delay_risk_label", "double('NaN') AS avg_delay_per_flight")
    assert tuple(Q.score_flags(bad).first()) == (1, 0, 0, 0)
    rows = spark.createDataFrame([(2000, 1, "C", "A", 5, 2.0)], "year int, month int, carrier string, airport string, row_id long, m double")
    attr = spark.createDataFrame([(5, 0.5), (5, 0.5)], "row_id long, value double")
    assert Q.additive(rows, attr, 1.0, F.col("m")).first()["additive"] == 1
    assert Q.additive(rows, attr, 1.1, F.col("m")).first()["additive"] == 0


def test_least_squares_check_can_fail(spark):
    from pyspark.ml.regression import LinearRegression
    from tarmac.plans import q_checks as Q
    df, _ = _data(spark)
    df = df.withColumn("label", F.col("target"))
    exact = LinearRegression(solver="normal", regParam=0.0).fit(df)
    assert Q.normal_equations(exact, df).first()["orthogonal"] == 1
    shrunk = LinearRegression(solver="normal", regParam=0.5).fit(df)
    assert Q.normal_equations(shrunk, df).first()["orthogonal"] == 0


def test_quadrature_is_the_recursion_with_one_hot_slots():
    """Random trees over numeric and two-valued slots, repeated features on a
    path included."""
    rng = np.random.default_rng(3)

    def grow(depth):
        if depth == 0 or rng.random() < 0.15:
            return [(float(rng.normal()), [])]
        f = int(rng.integers(0, 6))
        thr, ncat = ([float(rng.integers(0, 2))], 2) if f >= 4 else ([float(rng.normal())], -1)
        ratio = float(rng.uniform(0.05, 0.95))
        return [(v, [(f, True, thr, ncat, ratio), *path]) for v, path in grow(depth - 1)] + \
               [(v, [(f, False, thr, ncat, 1 - ratio), *path]) for v, path in grow(depth - 1)]
    trees = [(float(rng.uniform(0.1, 1)), grow(d)) for d in (1, 2, 3, 5, 8, 9)]
    X = np.hstack([rng.normal(size=(60, 4)), rng.integers(0, 2, size=(60, 2)).astype(float)])
    fast = H.compile_vectorised(trees)
    assert fast is not None
    assert np.abs(H.shap_matrix(X, trees) - H.shap_matrix_vectorised(X, fast, chunk=25)).max() < 1e-9
    assert H.compile_vectorised([(1.0, [(1.0, [(0, True, [0.0, 2.0], 3, 0.5)]), (2.0, [(0, False, [0.0, 2.0], 3, 0.5)])])]) is None
