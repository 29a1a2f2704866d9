"""Fits that run side by side, and preprocessing shared between parts of the features."""

import threading

import pytest
from pyspark.sql import functions as F

from riskgrain.operators import models, prep
from riskgrain.schemas import FeatureRoles

ROLES = FeatureRoles(("A", "BUREAU_B"), ("K", "INST_L"))


def _rows(spark):
    return spark.range(120).selectExpr(
        "id AS SK_ID_CURR", "CAST(id % 4 = 0 AS BIGINT) AS TARGET", "IF(id % 7 = 0, NULL, CAST(id % 17 AS DOUBLE)) AS A",
        "CAST(IF(id % 4 = 0, 50, 20) + id % 13 AS DOUBLE) AS BUREAU_B", "IF(id = 5, 'r', 'c') AS K", "IF(id % 3 = 0, 'x', NULL) AS INST_L",
    )


class Meeting:
    """An estimator whose fit returns once three of them run at the same time."""

    together = threading.Barrier(3)

    def __init__(self, name):
        self.name = name

    def fit(self, rows):
        self.together.wait(timeout=30)
        return self.name, rows.count(), rows.rdd.getNumPartitions()


class Sizes:
    """An estimator whose fit returns the rows of each partition."""

    def fit(self, rows):
        return [len(p) for p in rows.rdd.glom().collect()]


def test_small_fits_run_at_the_same_time_and_keep_their_order(spark):
    design = spark.range(90, numPartitions=4)
    work = [(models.Fitter(lambda rows, k=k: (Meeting(k), rows)), design) for k in "abc"]
    assert models.fit_together(work) == [("a", 90, 1), ("b", 90, 1), ("c", 90, 1)]


@pytest.mark.parametrize("most,expected", [(1_000, 4), (50, 8)])
def test_a_design_takes_no_more_equal_partitions_than_cores_and_rows_need(spark, monkeypatch, most, expected):
    monkeypatch.setattr(models, "PARTITION_ROWS", 10)
    monkeypatch.setattr(models, "PARTITION_ROWS_MOST", most, raising=False)
    design = spark.range(400, numPartitions=40)
    sizes = models.Fitter(lambda rows: (Sizes(), rows))
    (got,) = models.fit_together([(sizes, design)])
    assert len(got) == expected and sum(got) == 400 and max(got) < 1.25 * 400 / expected


def test_restricted_preprocessing_equals_a_fit_of_the_part(spark):
    rows = _rows(spark)
    whole = prep.fit(rows, ROLES, share=0.1)
    for group in ("application", "bureau", "installments"):
        part = ROLES.without_group(group)
        own, cut = prep.fit(rows, part, share=0.1), whole.restricted(part)
        assert (cut.medians, cut.indicators, cut.scales, cut.kept, cut.rare_count) == (own.medians, own.indicators, own.scales, own.kept, own.rare_count)
        design = [prep.transform(rows, p, ("SK_ID_CURR",)).orderBy("SK_ID_CURR").collect() for p in (own, cut)]
        assert design[0] == design[1]


def test_ablation_fits_preprocessing_once_a_fold(spark, monkeypatch):
    seen, whole = [], prep.fit
    monkeypatch.setattr(prep, "fit", lambda rows, roles, *a: seen.append(roles) or whole(rows, roles, *a))
    rows = _rows(spark)
    got = {r["candidate"]: r for r in models.ablation(rows, ROLES, models.logistic(iterations=20), 3).collect()}
    assert seen == [ROLES] * 3
    assert set(got) == {"full", "without_application", "without_bureau", "without_installments"}
    monkeypatch.undo()
    for key in ("full", "without_bureau"):
        part = ROLES if key == "full" else ROLES.without_group("bureau")
        oof = models.out_of_fold(rows, part, {key: models.logistic(iterations=20)}, 3, models.ABLATION_SEED)
        alone = models.metrics.evaluate(models.labelled(oof), ["candidate"]).first()
        assert all(abs(alone[m] - got[key][m]) < 1e-9 for m in ("roc_auc", "pr_auc", "brier_score"))
        assert oof.select(F.countDistinct("SK_ID_CURR")).first()[0] == 120
