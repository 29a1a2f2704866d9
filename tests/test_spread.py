"""Payments are dealt by rows, so that a task's hash tables do not grow with the input."""

from riskgrain import session
from riskgrain.operators import features, quality
from riskgrain.sources import rolemap

FOLDER = "/root/testdata/sf0.001"


def _results(spark):
    payments = rolemap.installments(spark, FOLDER)
    return quality.schedule_consistency(payments).collect(), sorted(features.installment_features(payments).collect(), key=repr)


def test_payments_are_dealt_by_rows_with_the_same_results(spark, monkeypatch):
    before = _results(spark)
    rows = rolemap.table(spark, FOLDER, "lineitem").count()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(session, "FEW_TASKS", 2)
    payments = rolemap.installments(spark, FOLDER)
    assert payments.rdd.getNumPartitions() >= rows // 100
    assert _results(spark) == before


def test_few_rows_keep_their_layout(spark):
    df = spark.range(10, numPartitions=3)
    assert session.spread(df, 10, "id") is df
