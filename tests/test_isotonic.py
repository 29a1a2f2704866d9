"""Isotonic pools against the textbook algorithm, and calibrated scores against linear interpolation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrain.operators import isotonic, models, splits
from riskgrain.schemas import SPLIT, ContractError


def pooled(rows):
    by = {}
    for y, x in rows:
        t = by.setdefault(x, [0.0, 0])
        t[0] += y
        t[1] += 1
    out = []
    for x in sorted(by):
        out.append([x, x, *by[x]])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            b, a = out.pop(), out.pop()
            out.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    return [(low, high, t / n, n) for low, high, t, n in out]


def frame(spark, rows):
    return spark.createDataFrame([(y, x) for y, x in rows], "label int, score double")


CASES = {
    "rising": [(int(k > 40), k / 100) for k in range(100)],
    "falling": [(int(k < 40), k / 100) for k in range(100)],
    "one": [(1, 0.5)] * 3,
    "noise": [(int(random.Random(k).random() < 0.5), random.Random(k + 10_000).random()) for k in range(900)],
    "signal": [(int(random.Random(k).random() < k / 900), k / 900) for k in range(900)],
    "ties": [(k % 3 == 0, round(random.Random(k).random(), 1)) for k in range(300)],
}


@pytest.mark.parametrize(("name", "few"), [*((n, 50_000) for n in CASES), ("noise", 0), ("falling", 0), ("ties", 0)])
def test_pools_and_interpolation_equal_brute_force(spark, monkeypatch, name, few):
    monkeypatch.setattr(isotonic, "FEW", few)
    rows = [(int(y), x) for y, x in CASES[name]]
    pools = isotonic.isotonic_pools(frame(spark, [*rows, (None, 0.3), (1, None), (1, float("nan"))]).repartition(3))
    want = pooled(rows)
    got = sorted(tuple(r) for r in pools.collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)
    at = sorted({0.0, 1.0, *(x for _, x in rows), *(x + 1e-4 for _, x in rows[:40] if x < 0.99)})
    points = [(p, v) for low, high, v, _ in want for p in sorted({low, high})]
    seen = isotonic.calibrate(spark.createDataFrame([(x,) for x in at] + [(None,)], "score double"), pools)
    found = {r["score"]: r["calibrated"] for r in seen.collect()}
    assert found.pop(None) is None
    assert [found[x] for x in at] == pytest.approx(np.interp(at, *zip(*points, strict=True)).tolist(), abs=1e-9)
    with pytest.raises(ContractError):
        isotonic.calibrate(frame(spark, rows), pools, out="label")


def test_no_rows_and_refit(spark):
    none = isotonic.isotonic_pools(frame(spark, []))
    assert none.count() == 0
    assert isotonic.calibrate(frame(spark, [(1, 0.5)]), none).first()["calibrated"] is None
    rows = CASES["signal"]
    scored = models.final_calibrator(frame(spark, rows), "isotonic")(frame(spark, rows)).agg(F.avg("score"), F.avg("label")).first()
    assert scored[0] == pytest.approx(scored[1], abs=1e-9)
    same = models.final_calibrator(frame(spark, rows), "identity")(frame(spark, [(1, 0.25)])).first()
    assert same["score"] == 0.25


def test_sealed_rows_stop_the_job(spark):
    rows = spark.createDataFrame([(1, 0, "train", 0.1), (2, 1, "validation", 0.2)], "SK_ID_CURR bigint, TARGET bigint, SPLIT string, score double")
    assert splits.sealed(rows).count() == 2 and splits.sealed(rows).columns == rows.columns
    for part in ("test", None, "dev"):
        with pytest.raises(Exception, match="sealed"):
            splits.sealed(rows.withColumn(SPLIT, F.lit(part))).collect()


def test_part_reconciliation_and_alignment(spark):
    schema = "SK_ID_CURR bigint, TARGET bigint, SPLIT string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    assigned = make([(1, 0, "train"), (2, 1, "train"), (3, 0, "validation"), (4, 1, "validation"), (5, 0, "test"), (6, 1, "test")])
    clean = {"train": assigned.where("SPLIT = 'train'"), "validation": assigned.where("SPLIT = 'validation'")}
    splits.check_parts(splits.part_reconciliation(clean, assigned))
    bad = {"train": make([(1, 1, None), (3, 0, None), (5, 0, None)]), "validation": make([(3, 0, None), (9, 1, None), (3, 0, None)])}
    got = {r["check_name"]: r["value"] for r in splits.part_reconciliation(bad, assigned).collect()}
    assert got == {
        "shared_ids": 1, "sealed_ids": 1, "unknown_ids": 1, "label_changes": 1, "misplaced_in_train": 2, "absent_from_train": 1,
        "misplaced_in_validation": 0, "absent_from_validation": 1}
    with pytest.raises(ContractError, match="sealed_ids"):
        splits.check_parts(splits.part_reconciliation(bad, assigned))
    v2 = make([(1, 0, "train"), (2, 0, "train"), (3, 0, "test"), (4, 1, "validation"), (5, 0, "test"), (5, 0, "test"), (7, 1, "test")])
    rows = [tuple(r) for r in splits.version_alignment({"v1": assigned, "v2": v2, "v3": v2}).orderBy("pair").collect()]
    assert rows == [("v1_v2", 6, 3, 2), ("v2_v3", 7, 0, 0)]
