"""Plan properties: no cross joins, no row-at-a-time Python, pushdown."""
import pytest

from tests.conftest import SF0001
from tarmac.plans import registry

KEY_QUERIES = ["histogram_50", "density_curve", "target_distribution", "weather_map", "boxplot_causes",
               "describe_numeric", "stratified_split", "metric_auc", "corr_pairs", "airports_dim",
               "weather_enrich", "airport_labels", "importance_overview", "impute", "validate_requests"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", KEY_QUERIES)
def test_no_cross_join_no_row_udf(spark, name):
    plan = _plan(registry.queries()[name](spark, SF0001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_flagship_pushdown_and_pruning(spark):
    df = registry.queries()["eda_rate_by_carrier"](spark, SF0001)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(arr_flights,0.0)" in text and "IsNotNull(carrier)" in text
    read = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert "arr_delay" not in read and "carrier_name" not in read     # only referenced columns are read
