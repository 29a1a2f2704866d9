import pytest
from pyspark.sql import functions as F

from riskgrain.operators import splits
from riskgrain.schemas import ContractError


def customers(spark, n, positives, start=1):
    return spark.range(start, start + n).selectExpr("id AS SK_ID_CURR", f"CAST(id < {start + positives} AS BIGINT) AS TARGET")


def cells(df):
    return {(r["SPLIT"], r["TARGET"]): r["n"] for r in df.groupBy("SPLIT", "TARGET").agg(F.count("*").alias("n")).collect()}


def test_apportionment():
    assert splits.apportion(10, [0.7, 0.15, 0.15]) == [7, 2, 1]
    assert splits.apportion(3, [1 / 3] * 3) == [1, 1, 1]
    assert sum(splits.apportion(307511, [0.7, 0.15, 0.15])) == 307511
    with pytest.raises(ContractError):
        splits.check_ratios({"a": 0.5, "b": 0.6})
    with pytest.raises(ContractError):
        splits.check_ratios({"a": 1.5, "b": -0.5})


def test_exact_stratified_counts(spark):
    c = customers(spark, 200, 40)
    got = cells(splits.stratified_split(c))
    assert got == {("train", 0): 112, ("train", 1): 28, ("validation", 0): 24, ("validation", 1): 6, ("test", 0): 24, ("test", 1): 6}
    check = splits.check_split(c, splits.stratified_split(c)).first()
    assert not any(check)


def test_same_result_for_any_order_and_partitioning(spark, tuples):
    c = customers(spark, 300, 50)
    base = tuples(splits.stratified_split(c))
    assert tuples(splits.stratified_split(c.repartition(7, F.rand(3)).orderBy(F.rand(1)))) == base
    other = splits.stratified_split(c, seed=43)
    assert tuples(other) != base and cells(other) == cells(splits.stratified_split(c))
    d = splits.assignment_digest
    assert d(splits.stratified_split(c)).first() == d(splits.stratified_split(c.repartition(5))).first()


def test_blake_order_equals_a_sorted_reference(spark):
    import hashlib

    c = customers(spark, 60, 20)
    got = {r["SK_ID_CURR"]: r["SPLIT"] for r in splits.stratified_split(c, key=splits.blake_key(42, b"person")).collect()}
    limits = splits.class_limits(40, 20, splits.DEFAULT_RATIOS)
    want = {}
    for t, ids in ((1, range(1, 21)), (0, range(21, 61))):
        ranked = sorted(ids, key=lambda i: (hashlib.blake2b(f"42:{i}".encode(), digest_size=16, person=b"person").digest(), i))
        for x in limits:
            if x.label == t:
                want |= dict.fromkeys(ranked[x.above : x.upto], x.part)
    assert got == want


@pytest.mark.parametrize("bad", ["SELECT 1L SK_ID_CURR, 1L TARGET UNION ALL SELECT 1L, 0L", "SELECT 1L SK_ID_CURR, NULL TARGET UNION ALL SELECT 2L, 1L",
                                 "SELECT 1L SK_ID_CURR, 2L TARGET UNION ALL SELECT 2L, 1L", "SELECT 1L SK_ID_CURR, 1L TARGET", "SELECT NULL SK_ID_CURR, 1L TARGET UNION ALL SELECT 2L, 0L"])
def test_broken_inputs(spark, bad):
    with pytest.raises(ContractError):
        splits.stratified_split(spark.sql(bad))


def test_check_finds_label_changes_and_unknown_names(spark):
    c = customers(spark, 200, 40)
    a = splits.stratified_split(c)
    bad = a.withColumn("TARGET", F.when(F.col("SK_ID_CURR") == 1, 0).otherwise(F.col("TARGET"))).withColumn(
        "SPLIT", F.when(F.col("SK_ID_CURR") == 2, "other").otherwise(F.col("SPLIT"))
    ).where("SK_ID_CURR <> 3")
    r = splits.check_split(c, bad).first()
    assert (r["label_changes"], r["bad_names"], r["unmatched_ids"]) == (1, 1, 1) and r["count_deviation"] > 0


def test_folds_and_holdout(spark):
    c = customers(spark, 100, 20)
    folds = splits.stratified_folds(c, 5, 43)
    per = {r["fold"]: (r["n"], r["p"]) for r in folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("TARGET").alias("p")).collect()}
    assert per == dict.fromkeys(range(1, 6), (20, 4)) and folds.select("SK_ID_CURR").distinct().count() == 100
    with pytest.raises(ContractError):
        splits.stratified_folds(customers(spark, 50, 3), 5, 1)
    h = cells(splits.holdout_split(c, 0.1, 7))
    assert h["holdout", 1] == 2 and h["holdout", 0] == 8


def test_test_part_is_sealed():
    assert splits.seal_test("train") == "train"
    for name in ("test", "other"):
        with pytest.raises(ContractError):
            splits.seal_test(name)
