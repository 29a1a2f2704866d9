"""The long form of a design, slot-level importance from its non-zero entries, and deltas between experiments."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskgrain.operators import attribution, prep, selection


def test_long_form_and_slot_importance_equal_the_dense_one(spark):
    names = ["a", "b", "c", "d"]
    dense = [(1, [0.0, 2.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, -1.0]), (3, [0.0, 0.0, 0.0, 0.0]), (4, [1.0, 5.0, 0.0, 3.0])]
    vectors = [(k, Vectors.dense(v) if k % 2 else Vectors.sparse(4, {i: x for i, x in enumerate(v) if x})) for k, v in dense]
    design = spark.createDataFrame(vectors, ["id", "features"])
    long = prep.design_long(design, names, ("id",))
    assert sorted(map(tuple, long.collect())) == [(1, "b", 2.0), (2, "a", 1.0), (2, "d", -1.0), (4, "a", 1.0), (4, "b", 5.0), (4, "d", 3.0)]
    beta = {"a": 2.0, "b": -1.0, "c": 4.0, "d": 0.5}
    mean = {n: sum(v[i] for _, v in dense) / 4 for i, n in enumerate(names)}
    assert {r["slot"]: r["mean"] for r in attribution.slot_means(long, 4).collect()} == {n: m for n, m in mean.items() if m}
    weights = spark.createDataFrame([(n, beta[n], mean[n]) for n in names], "slot string, coefficient double, mean double")
    got = {r["feature"]: r for r in attribution.slot_importance(long, weights, 4).collect()}
    rows = [(k, n, beta[n] * (v[i] - mean[n])) for k, v in dense for i, n in enumerate(names)]
    want = {r["feature"]: r for r in attribution.importance(spark.createDataFrame(rows, "id bigint, feature string, attribution double")).collect()}
    assert set(got) == set(names)
    for n in names:
        assert got[n]["rank"] == want[n]["rank"]
        for k in ("mean_abs", "mean_signed", "share"):
            assert got[n][k] == pytest.approx(want[n][k], abs=1e-12)


def test_experiment_deltas_of_both_kinds(spark):
    table = spark.createDataFrame(
        [("base", "v1", 0.5), ("base", "v2", 0.6), ("base", "v3", 0.65), ("other", "v1", 0.7), ("other", "v3", 0.75), ("other", "v9", 0.1)], "model string, data string, auc double")
    got = {tuple(r)[:3]: round(r["delta_auc"], 9) for r in selection.experiment_deltas(table, "model", "data", ["v1", "v2", "v3"], "base", ["auc"]).collect()}
    assert got == {
        ("more_data", "base", "v2_minus_v1"): 0.1, ("more_data", "base", "v3_minus_v2"): 0.05,
        ("other_model", "v1", "other_minus_base"): 0.2, ("other_model", "v3", "other_minus_base"): 0.1}
    assert selection.experiment_deltas(table.where(F.lit(False)), "model", "data", ["v1"], "base", ["auc"]).count() == 0
