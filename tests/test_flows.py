"""End-to-end flows at sf0.001 with a tiny search budget."""
from pyspark.sql import functions as F

from tests.conftest import SF0001
from tarmac import schema as S
from tarmac.fixtures import fixture
from tarmac.operators import models as MD
from tarmac.plans import flows
from tarmac.session import scratch_path


def test_prepare_train_explain(spark):
    out = scratch_path(spark, "t_flow")
    prepared = flows.prepare_datasets(spark, fixture(spark, SF0001, "flights_raw"),
                                      fixture(spark, SF0001, "weather_daily"), out)
    splits = {r["split"]: r["n"] for r in prepared.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(splits) == {"train", "val", "test"}
    assert set(S.FEATURES_REFERENCE) <= set(prepared.columns)

    tiny = MD.SearchSpace(ints={"n_estimators": (2, 3), "max_depth": (2, 3), "min_child_weight": (1, 2)})
    runs_path, models_dir = scratch_path(spark, "t_runs"), scratch_path(spark, "t_models")
    runs = flows.train_and_log(spark, f"{out}/splits", runs_path, models_dir, tiny, n_trials=2)
    rows = {r["run_name"]: r for r in runs.collect()}
    assert set(rows) == {"gbt_classifier_weather", "gbt_regressor_weather"}
    assert all(r["status"] == "FINISHED" and r["model_path"] for r in rows.values())
    assert 0.0 <= rows["gbt_classifier_weather"]["metrics"]["test_auc"] <= 1.0
    assert rows["gbt_regressor_weather"]["metrics"]["test_rmse"] >= 0.0

    train = prepared.where("split = 'train'").withColumn("row_id", F.monotonically_increasing_id())
    ov = flows.explain_report(spark, models_dir, train, scratch_path(spark, "t_reports")).first()
    assert ov["clf_top_feature"] is not None and ov["reg_top_feature"] is not None


def test_registered_flow_searches_ten_trials(spark, monkeypatch):
    """The reference's search has ten trials for each model."""
    from tarmac.plans import q_flows
    asked = []

    class Asked(Exception):
        pass

    def tune(tr, va, kind, trials, *rest):
        asked.append(len(trials))
        raise Asked

    monkeypatch.setattr(MD, "tune", tune)
    try:
        q_flows.q_train_and_log(spark, SF0001)
    except Asked:
        pass
    assert asked == [10]
