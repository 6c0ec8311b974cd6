"""What texts cost in memory: batches sent to Python, no sort of whole texts."""
import pytest

from tarmac.llm import common, linededup

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    if before is None:
        spark.conf.unset(KEY)
    else:
        spark.conf.set(KEY, before)


def test_line_dedup_sends_small_batches_and_sorts_no_text(spark, unset):
    text = "\n".join(f"line {i} of a text with some words" for i in range(8))
    docs = spark.createDataFrame([(i, f"{text}\nown end {i}") for i in range(5)], "doc_id long, text string")
    found = linededup.dedup_lines(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(KEY) == str(common.BATCH_ROWS)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin LeftOuter" not in plan.replace("], [", " ")
    assert {r["doc_id"]: r["deleted_lines"] for r in found.collect()} == {0: 0, 1: 8, 2: 8, 3: 8, 4: 8}


def test_a_named_batch_size_stays(spark, unset):
    spark.conf.set(KEY, "77")
    common.small_batches(spark)
    assert spark.conf.get(KEY) == "77"
