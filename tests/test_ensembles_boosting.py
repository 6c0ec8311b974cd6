"""Compiled ensembles and second-order boosting."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import boosting as B
from tarmac.operators import ensembles as EN
from tarmac.operators import models as MD

FEATURES = ["arr_flights", "arr_delay", "carrier", "month"]


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = None if i % 17 == 0 else float(rng.integers(0, 40))
        d = float("nan") if i % 29 == 0 else float(np.round(rng.normal(), 2))
        c = None if i % 23 == 0 else rng.choice(["AA", "O'K", "Zé"])
        m = int(rng.integers(1, 4))
        y = (a or 0) / 20 + (2.0 if c == "AA" else 0.0) + (0 if math.isnan(d) else d) + 0.1 * m
        out.append((i, a, d, None if c is None else str(c), m, float(y), int(y > 2)))
    return out


def table(spark, n=300, seed=0):
    return spark.createDataFrame(rows(n, seed), "row_id long, arr_flights double, arr_delay double, carrier string, month int, y double, risk int")


@pytest.mark.parametrize("kind,target", [("classifier", "risk"), ("regressor", "y")])
def test_compiled_model_is_the_transform(spark, kind, target):
    """Values of the projection, and of its text in another engine, are the
    fitted pipeline's, unknown categories, nulls and NaN included."""
    df = table(spark)
    train = df.where(~F.isnan("arr_delay") & F.col("arr_flights").isNotNull())
    model = MD.train_final(train.where("row_id < 200"), train.where("row_id >= 200"), FEATURES, target, kind,
                           {"n_estimators": 6, "max_depth": 4})
    other = table(spark, 200, 5).withColumn("carrier", F.when(F.col("row_id") % 7 == 0, "new").otherwise(F.col("carrier")))
    compiled = EN.Compiled.of(model, FEATURES, kind)
    got = {r.row_id: r.score for r in compiled.score(other, "score").collect()}
    out = model.transform(other)
    want = {r.row_id: r.v for r in out.select("row_id", (MD.prob1(out) if kind == "classifier" else F.col("prediction")).alias("v")).collect()}
    assert got == pytest.approx(want, rel=1e-12, abs=1e-12)
    pdf = other.toPandas()      # noqa: F841  (a table of the statement below)
    plain = duckdb.sql(compiled.sql("pdf", ["row_id"], "score")).fetchall()
    assert dict(plain) == pytest.approx(want, rel=1e-9, abs=1e-9)
    plan = compiled.score(other, "score")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan


def test_many_trees_stay_exact(spark):
    """Beyond one generated method the chunks are separate ones."""
    def tree(depth, i):
        if not depth:
            return EN.Node(value=i / 7)
        return EN.Node(condition=f"id % {depth + 2 + i % 5} < {1 + i % 3}", left=tree(depth - 1, i + 1), right=tree(depth - 1, i + 2))

    def walk(t, x):
        while t.condition is not None:
            a, b = t.condition[5:].split(" < ")
            t = t.left if x % int(a) < int(b) else t.right
        return t.value
    trees = [tree(6, i) for i in range(120)]
    assert max(sum(t.leaves for t in c) for c in EN.chunks(trees)) <= EN.CHUNK_LEAVES
    got = {r.id: r.m for r in spark.range(300).select("id", EN.margin_column(trees, 0.5).alias("m")).collect()}
    assert got == pytest.approx({x: 0.5 + sum(walk(t, x) for t in trees) for x in range(300)})


def test_only_the_last_tree_is_interpreted(spark):
    """What stands inside a higher-order function has no generated code."""
    def tree(i):
        return EN.Node(condition=f"id < {i}", left=EN.Node(value=1.0), right=EN.Node(condition=f"id > {2 * i}", left=EN.Node(value=2.0), right=EN.Node(value=i + 2.5)))
    trees = [tree(i) for i in range(1, 600)]
    df = spark.range(900).select(EN.margin_column(trees, 0.25).alias("m"), "id")
    text = df._jdf.queryExecution().optimizedPlan().expressions().head().sql()
    assert text.count("CASE WHEN") == 2 * len(trees)
    assert text[text.index("aggregate("):].count("CASE WHEN") == 2
    want = {x: 0.25 + sum(1.0 if x < i else 2.0 if x > 2 * i else i + 2.5 for i in range(1, 600)) for x in range(900)}
    assert {r.id: r.m for r in df.collect()} == pytest.approx(want)


# boosting

def brute(data, cuts, values, kind, p, label):
    """The same trees, row by row, from scratch."""
    cols = [*cuts, *values]

    def splits():
        for c in cuts:
            for v in cuts[c]:
                yield lambda r, c=c, v=v: r[c] is None or (not math.isnan(r[c]) and r[c] <= v)
        for c in values:
            for v in values[c]:
                yield lambda r, c=c, v=v: r[c] is not None and str(r[c]) == v

    def soft(g):
        return math.copysign(max(abs(g) - p.reg_alpha, 0.0), g)

    def part(g, h):
        return soft(g) ** 2 / (h + p.reg_lambda)

    mean = sum(r[label] for r in data) / len(data)
    f = [math.log(mean / (1 - mean)) if kind == "classifier" else mean] * len(data)
    for _ in range(p.n_estimators):
        if kind == "classifier":
            q = [1 / (1 + math.exp(-x)) for x in f]
            g, h = [a - r[label] for a, r in zip(q, data)], [a * (1 - a) for a in q]
        else:
            g, h = [a - r[label] for a, r in zip(f, data)], [1.0] * len(data)

        def grow(members, depth):
            tg, th = sum(g[i] for i in members), sum(h[i] for i in members)
            best = None
            if depth:
                for n, goes in enumerate(splits()):
                    left = [i for i in members if goes(data[i])]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if lh >= p.min_child_weight and th - lh >= p.min_child_weight:
                        gain = round(0.5 * (part(lg, lh) + part(tg - lg, th - lh) - part(tg, th)) - p.gamma, 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, left)
            if best is None:
                w = -soft(tg) / (th + p.reg_lambda) * p.learning_rate
                for i in members:
                    f[i] += w
                return
            inside = set(best[1])
            grow(best[1], depth - 1)
            grow([i for i in members if i not in inside], depth - 1)
        grow(list(range(len(data))), p.max_depth)
    assert cols
    return [1 / (1 + math.exp(-x)) for x in f] if kind == "classifier" else f


@pytest.mark.parametrize("kind,label", [("classifier", "risk"), ("regressor", "y")])
@pytest.mark.parametrize("params", [dict(), dict(reg_lambda=5.0, reg_alpha=2.0), dict(gamma=1.5, min_child_weight=6.0)])
def test_boosting_is_brute_force(spark, kind, label, params):
    df = table(spark, 200)
    p = B.Params(n_estimators=6, max_depth=3, learning_rate=0.3, **params)
    numeric, categorical = ["arr_flights", "arr_delay"], ["carrier", "month"]
    model = B.fit(df, numeric, categorical, label, kind, p, 8)
    bins = B.fit_bins(df, numeric, categorical, 8)
    data = [r.asDict() for r in df.orderBy("row_id").collect()]
    want = brute(data, bins.cuts, bins.values, kind, p, label)
    got = [r.s for r in model.score(df, "s").orderBy("row_id").collect()]
    assert got == pytest.approx(want, abs=1e-7)


def test_every_parameter_counts(spark):
    df = table(spark, 300)
    base = dict(n_estimators=3, max_depth=3, learning_rate=0.3)

    def scores(**kw):
        m = B.fit(df, ["arr_flights", "arr_delay"], ["carrier"], "y", "regressor", B.Params(**(base | kw)), 8)
        return [r.s for r in m.score(df, "s").orderBy("row_id").collect()]
    plain = scores()
    assert plain == scores()
    for kw in (dict(reg_lambda=30.0), dict(reg_alpha=20.0), dict(gamma=40.0), dict(min_child_weight=60.0), dict(subsample=0.5), dict(colsample_bytree=0.4)):
        assert scores(**kw) != plain, kw
    assert len(set(scores(gamma=1e9))) == 1
    drawn = MD.sample_params(MD.SearchSpace(), 1, 3)[0]
    assert B.from_search(drawn) == B.Params(**drawn)


def test_boosting_edges(spark):
    df = table(spark, 60)
    p = B.Params(n_estimators=2, max_depth=2)
    one = B.fit(df.withColumn("risk", F.lit(1)), ["arr_flights"], [], "risk", "classifier", p)
    assert all(r.s > 0.99 for r in one.score(df, "s").collect())
    flat = B.fit(df.withColumn("arr_flights", F.lit(None).cast("double")), ["arr_flights"], ["carrier"], "y", "regressor", p)
    assert all(math.isfinite(r.s) for r in flat.score(df, "s").collect())
    with pytest.raises(ValueError):
        B.fit(df.where("false"), ["arr_flights"], [], "y", "regressor", p)
    assert S.DEFAULT_FEATURES == "no_leak" and not set(S.FEATURES_NO_LEAK) & {"arr_del15", "arr_delay", "delay_rate", "avg_delay_per_flight"}
