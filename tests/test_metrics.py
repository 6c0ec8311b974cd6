import random

from tarmac.operators import metrics as M


def _brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    if not pos or not neg:
        return 0.5
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_ties_against_brute_force(spark):
    random.seed(3)
    pairs = [(random.randint(0, 1), random.choice([0.1, 0.2, 0.5, 0.5, 0.9])) for _ in range(300)]
    df = spark.createDataFrame(pairs, "y int, p double")
    assert abs(M.auc(df).first()["auc"] - _brute_auc(pairs)) < 1e-12


def test_auc_single_class(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, p double")
    assert M.auc(df).first()["auc"] == 0.5


def test_classification_and_regression(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 2.0), (0, 0.49, 3.0, 3.0), (1, 0.2, 5.0, 4.0)],
                               "y int, p double, y_reg double, yhat double")
    c = M.classification_metrics(df).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (1, 0, 1, 1)
    assert abs(c["recall"] - 0.5) < 1e-12
    r = M.regression_metrics(df).first()
    assert abs(r["rmse"] - (2 / 3) ** 0.5) < 1e-12 and abs(r["mae"] - 2 / 3) < 1e-12
    assert abs(r["r2"] - (1 - 2 / 8)) < 1e-12
