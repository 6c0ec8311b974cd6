from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import encode as EN
from tarmac.operators import models as MD
from tarmac.operators import split as SP


def test_split_sizes_within_one_row(spark):
    df = spark.range(0, 3001).select(
        (F.col("id") % 7 + 2000).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        F.concat(F.lit("C"), (F.col("id") % 13).cast("string")).alias("carrier"),
        F.concat(F.lit("A"), F.col("id").cast("string")).alias("airport"),
        (F.col("id") % 4 == 0).cast("int").alias("high_delay_risk"))
    out = SP.stratified_split(df)
    counts = {(r["high_delay_risk"], r["split"]): r["n"] for r in out.groupBy("high_delay_risk", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for lab in (0, 1):
        n = sum(v for (l_, _), v in counts.items() if l_ == lab)
        assert abs(counts[(lab, "train")] - 0.70 * n) <= 1
        assert abs(counts[(lab, "val")] - 0.15 * n) <= 1.5
    # reproducible
    again = SP.stratified_split(df).select("airport", "split").exceptAll(out.select("airport", "split"))
    assert again.count() == 0


def test_rows_without_a_label_are_a_stratum(spark):
    df = spark.range(0, 1200).select(
        F.lit(2000).alias("year"), F.lit(1).alias("month"), F.lit("C").alias("carrier"), F.col("id").cast("string").alias("airport"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3 - 1).cast("int")).alias("high_delay_risk"))
    out = SP.stratified_split(df)
    assert out.columns == [*df.columns, "split"]
    for label in (None, 0, 1):
        n = {r["split"]: r["count"] for r in out.where(F.col("high_delay_risk").eqNullSafe(F.lit(label))).groupBy("split").count().collect()}
        assert abs(n["train"] - 280) <= 1 and abs(n["val"] - 60) <= 1.5 and sum(n.values()) == 400


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = EN.scaler_stage(df, ["a", "b"], "__z")
    out = m.transform(df).agg(F.avg("a__z").alias("m"), F.stddev_pop("a__z").alias("s"), F.max(F.abs("b__z")).alias("b")).first()
    assert abs(out["m"]) < 1e-12 and abs(out["s"] - 1) < 1e-12 and out["b"] == 0.0


def test_one_hot_unknown_and_null_are_zero(spark):
    tr = spark.createDataFrame([("x", 1), ("y", 2)], "c string, k int")
    te = spark.createDataFrame([("x", 1), ("z", 3), (None, 4)], "c string, k int")
    model = Pipeline(stages=EN.one_hot_stages(["c"])).fit(tr)
    long = {r["k"]: r["feature"] for r in EN.one_hot_long(model, te, ["c"], ["k"]).collect()}
    assert long == {1: "cat__c_x"}
    assert EN.one_hot_labels(model) == [["x", "y"]]
    assert {r[0].size for r in model.transform(te).select("c__ohe").collect()} == {2}


def test_imputers(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, "b"), (10.0, "a"), (None, None)], "v double, s string")
    med = EN.median_fill_values(df, ["v"]).first()["value"]
    assert med == 3.0
    mode = EN.mode_fill_values(df, ["s"]).first()["value"]
    assert mode == "a"          # tie 2-2 -> smallest
    filled = EN.fill_stage(EN.fill_values(df, ["v"], ["s"]), ["v"], ["s"]).transform(df).select("v__f", "s__f").collect()
    assert [tuple(r) for r in filled] == [(1.0, "b"), (3.0, "a"), (3.0, "b"), (10.0, "a"), (3.0, "a")]


def test_search_space_seeded():
    a = MD.sample_params(MD.SearchSpace(), 4, 7)
    b = MD.sample_params(MD.SearchSpace(), 4, 7)
    assert a == b and all(200 <= p["n_estimators"] <= 800 and 0.01 <= p["learning_rate"] <= 0.3 for p in a)
