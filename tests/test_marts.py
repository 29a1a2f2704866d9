import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskgrain.operators import features, mart_state, quality
from riskgrain.plans.build import build_marts
from riskgrain.schemas import (
    BUREAU_FEATURES,
    DERIVED_FEATURES,
    INSTALLMENT_FEATURES,
    V1_FEATURES,
    ContractError,
    check_prefix,
)
from tests import world


@pytest.fixture(scope="module")
def mart(spark):
    return {r["SK_ID_CURR"]: r for r in features.feature_mart(*world.tables(spark)).collect()}


def test_feature_name_counts():
    assert (len(V1_FEATURES), len(BUREAU_FEATURES), len(INSTALLMENT_FEATURES)) == (13, 37, 29)
    assert len(set(DERIVED_FEATURES)) == 79


def test_applicant_columns(mart):
    a, b, c, d = (mart[k] for k in (100001, 100002, 100003, 100004))
    assert a["APP_CREDIT_INCOME_RATIO"] == 2.0 and a["APP_INCOME_PER_FAMILY_MEMBER"] == 50.0
    assert a["APP_EXT_SOURCE_MEAN"] == pytest.approx(0.15) and a["APP_EXT_SOURCE_OBSERVED_COUNT"] == 2
    assert a["OWN_CAR_AGE_NOT_APPLICABLE"] == 1 and a["OWN_CAR_AGE_MISSING"] == 0
    assert b["DAYS_EMPLOYED"] is None and b["DAYS_EMPLOYED_SENTINEL"] == 1 and b["OWN_CAR_AGE_MISSING"] == 1
    assert b["APP_EXT_SOURCE_MEAN"] is None and b["APP_EMPLOYED_YEARS"] is None
    assert c["APP_CREDIT_INCOME_RATIO"] is None and c["APP_CREDIT_ANNUITY_RATIO"] is None and c["APP_INCOME_PER_FAMILY_MEMBER"] is None
    assert c["APP_CREDIT_GOODS_RATIO"] == 0.0
    assert d["APP_AGE_YEARS"] == pytest.approx(8000 / 365.25) and d["APP_EMPLOYED_AGE_RATIO"] == pytest.approx(0.0125)


def test_credit_history(mart):
    a, b, c, d = (mart[k] for k in (100001, 100002, 100003, 100004))
    assert (a["BUREAU_RECORD_COUNT"], a["BUREAU_LOAN_COUNT"], a["BUREAU_ACTIVE_COUNT"], a["BUREAU_CREDIT_TYPE_COUNT"]) == (2, 2, 1, 2)
    assert a["BUREAU_OVERDUE_LOAN_COUNT"] == 1 and a["BUREAU_CREDIT_AMOUNT_SUM"] == 1500.0
    assert a["BUREAU_DEBT_SUM"] == 200.0 and a["BUREAU_DEBT_CREDIT_RATIO"] == 0.2
    assert b["BUREAU_NON_PRIMARY_CURRENCY_COUNT"] == 1 and b["BUREAU_CREDIT_AMOUNT_OBSERVED_COUNT"] == 0
    assert b["BUREAU_CREDIT_AMOUNT_SUM"] is None and b["BUREAU_ANNUITY_SUM"] is None
    for row in (c, d):
        assert row["BUREAU_HAS_HISTORY"] == 0 and row["BUREAU_RECORD_COUNT"] == 0 and row["BUREAU_PROLONG_COUNT_SUM"] == 0.0
        assert row["BUREAU_ACTIVE_RATIO"] is None


def test_payment_history(mart):
    a, b, c, d = (mart[k] for k in (100001, 100002, 100003, 100004))
    assert (a["INST_SCHEDULE_COUNT"], a["INST_PAYMENT_EVENT_COUNT"], a["INST_PREV_LOAN_COUNT"]) == (2, 3, 1)
    assert (a["INST_PAYMENT_AMOUNT_OBSERVED_SCHEDULE_COUNT"], a["INST_MISSING_PAYMENT_SCHEDULE_COUNT"]) == (1, 1)
    assert a["INST_LATE_SCHEDULE_COUNT"] == 1 and a["INST_DAYS_LATE_MAX"] == 10.0
    assert a["INST_PAID_AMOUNT_SUM"] == 100.0 and a["INST_PAYMENT_RATIO"] == 1.0
    assert a["INST_LAST_365_SCHEDULE_COUNT"] == 2 and a["INST_LAST_365_LATE_RATIO"] == 1.0
    assert b["INST_UNDERPAID_SCHEDULE_COUNT"] == 1 and b["INST_PAID_AMOUNT_SUM"] == 0.0 and b["INST_PAYMENT_RATIO"] == 0.0
    assert b["INST_LAST_730_SCHEDULE_COUNT"] == 0 and b["INST_LAST_730_LATE_RATIO"] is None
    assert c["INST_PAYMENT_RATIO"] == pytest.approx(1.2) and c["INST_PAYMENT_GAP_SUM"] == 0.0
    assert d["INST_HAS_HISTORY"] == 0 and d["INST_SCHEDULE_COUNT"] == 0 and d["INST_LATE_RATIO"] is None


def test_late_with_unknown_due_day_counts_as_zero(spark):
    one = spark.createDataFrame([(1, 1, 1.0, 1, None, -3.0, 5.0, 5.0)], world.PAYMENTS)
    r = features.installment_schedules(one).first()
    assert r["DAYS_LATE"] == 0.0 and r["IS_UNDERPAID"] == 0


def test_one_cent_tolerance(spark):
    rows = [(1, 1, 1.0, n, -5.0, -5.0, 10.0, paid) for n, paid in ((1, 9.99), (2, 9.989999), (3, 10.0))]
    got = features.installment_schedules(spark.createDataFrame(rows, world.PAYMENTS))
    assert {r["NUM_INSTALMENT_NUMBER"]: r["IS_UNDERPAID"] for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_duplicate_loan_ids_are_counted_once(spark):
    doubled = world.BUREAU_ROWS + [world.BUREAU_ROWS[0]]
    r = features.bureau_features(spark.createDataFrame(doubled, world.BUREAU)).where("SK_ID_CURR = 100001").first()
    assert (r["BUREAU_RECORD_COUNT"], r["BUREAU_LOAN_COUNT"]) == (3, 2)


def test_credit_sums_do_not_depend_on_the_order_of_rows(spark):
    amounts = [337768.9, 303182.0, 168229.21, 103567.44, 204510.38, 161974.25, 313519.65, 121325.79, 190639.31, 233353.23, 363245.25, 201875.24]
    fields = world.BUREAU.replace(" bigint", "").replace(" string", "").replace(" double", "").split(", ")
    at = fields.index("AMT_CREDIT_SUM")
    row = lambda k, i, x: tuple(x if j == at else {"SK_ID_CURR": k, "SK_ID_BUREAU": 100 * k + i}.get(f, v) for j, (f, v) in enumerate(zip(fields, world.BUREAU_ROWS[0])))
    orders = [amounts, amounts[::-1], amounts[5:] + amounts[:5], sorted(amounts)]
    rows = [row(k, i, x) for k, order in enumerate(orders) for i, x in enumerate(order)]
    got = features.bureau_features(spark.createDataFrame(rows, world.BUREAU).coalesce(1)).collect()
    assert {(r["BUREAU_CREDIT_AMOUNT_SUM"], r["BUREAU_DEBT_CREDIT_RATIO"]) for r in got} == {(2703190.65, 12 * 200.0 / 2703190.65)}
    wild = [row(1, 1, 1.5), row(1, 2, float("inf")), row(2, 1, 1e30), row(2, 2, 2.0)]
    got = features.bureau_features(spark.createDataFrame(wild, world.BUREAU)).collect()
    assert {r["SK_ID_CURR"]: r["BUREAU_CREDIT_AMOUNT_SUM"] for r in got} == {1: float("inf"), 2: 1e30}


def test_contract_counts_and_lineage(spark):
    app, splits, bureau, pay = world.tables(spark)
    v1 = features.application_mart(app, splits)
    v2 = features.bureau_mart(v1, bureau)
    v3 = features.installment_mart(v2, pay)
    check_prefix(v1, v2)
    check_prefix(v2, v3)
    assert quality.lineage_mismatches(v1, v2).first()[0] == 0
    assert quality.lineage_mismatches(v2, v3).first()[0] == 0
    source = quality.enforce_source_contract(quality.source_contract(app, splits, bureau, pay))
    assert source["bureau", "positive_update_rows"] == 1
    b = {(r[0], r[1]): r[2] for r in quality.bureau_contract(v3, bureau, app).collect()}
    assert b["mart", "rows_aggregated"] == b["source", "expected_rows"] == 3
    i = {(r[0], r[1]): r[2] for r in quality.installment_contract(v3, pay, app).collect()}
    assert i["mart", "rows_aggregated"] == i["source", "expected_rows"] == 5 and i["mart", "schedules_aggregated"] == 4
    quality.enforce_mart_contract(
        quality.mart_contract(v3, splits), quality.bureau_contract(v3, bureau, app), quality.installment_contract(v3, pay, app)
    )


def _broken(spark, case):
    app, splits, bureau, pay = world.tables(spark)
    day = F.col("DAYS_ENTRY_PAYMENT")
    if case == "label":
        splits = splits.withColumn("TARGET", F.when(F.col("SK_ID_CURR") == 100001, 1).otherwise(F.col("TARGET")))
    elif case == "future_due":
        pay = pay.withColumn("DAYS_INSTALMENT", F.lit(1.0))
    elif case == "future_paid":
        pay = pay.withColumn("DAYS_ENTRY_PAYMENT", F.when(day.isNotNull(), F.lit(1.0)))
    elif case == "schedule":
        pay = pay.withColumn("AMT_INSTALMENT", F.col("AMT_INSTALMENT") + F.col("AMT_PAYMENT"))
    elif case == "unpaired":
        pay = pay.withColumn("DAYS_ENTRY_PAYMENT", F.lit(None).cast("double"))
    elif case == "duplicate_loan":
        bureau = bureau.union(bureau)
    elif case == "two_splits":
        splits = splits.withColumn("SPLIT", F.lit("train"))
    return app, splits, bureau, pay


@pytest.mark.parametrize("case", ["label", "future_due", "future_paid", "schedule", "unpaired", "duplicate_loan", "two_splits"])
def test_broken_sources_are_rejected(spark, case):
    with pytest.raises(ContractError):
        quality.enforce_source_contract(quality.source_contract(*_broken(spark, case)))


def test_publication_is_all_or_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    paths = {v: f"{folder}/{v}" for v in ("v1", "v2", "v3")}
    summary = build_marts(spark, *world.tables(spark), paths, f"{folder}/summary")
    assert [summary[v]["rows"] for v in ("v1", "v2", "v3")] == [4, 4, 4]
    assert spark.read.json(f"{folder}/summary").count() == 3
    assert sorted(os.listdir(folder)) == ["summary", "summary-states", "v1", "v2", "v3"]
    before = {f: os.listdir(f"{folder}/{f}") for f in ("v1", "v2", "v3", "summary")}
    with pytest.raises(ContractError):
        build_marts(spark, *_broken(spark, "label"), paths, f"{folder}/summary")
    app, splits, bureau, pay = world.tables(spark)
    original = quality.enforce_mart_contract
    try:
        quality.enforce_mart_contract = lambda *a: (_ for _ in ()).throw(ContractError("late failure"))
        with pytest.raises(ContractError):
            build_marts(spark, app, splits, bureau, pay, paths, f"{folder}/summary")
    finally:
        quality.enforce_mart_contract = original
    assert {f: os.listdir(f"{folder}/{f}") for f in before} == before
    assert sorted(os.listdir(folder)) == ["summary", "summary-states", "v1", "v2", "v3"]


def test_mart_joins_reuse_the_customer_partitioning(spark):
    """Broadcast off: the mart side is exchanged by customer once, not once per join."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = features.feature_mart(*world.tables(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    # application, split; bureau main, loans x2, types x2; schedules, customer, loans x2
    assert plan.count("Exchange hashpartitioning") == 11
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_customer_with_a_third_of_all_events(spark):
    """A hot customer is reduced before each shuffle and counted whole."""
    hot = spark.range(30000).selectExpr(
        "id % 7 AS SK_ID_PREV", "1L AS SK_ID_CURR", "1D AS NUM_INSTALMENT_VERSION", "id % 50 AS NUM_INSTALMENT_NUMBER",
        "-10D AS DAYS_INSTALMENT", "-9D AS DAYS_ENTRY_PAYMENT", "2D AS AMT_INSTALMENT", "0.01D AS AMT_PAYMENT",
    )
    cold = spark.range(60000).selectExpr(
        "1000 + id AS SK_ID_PREV", "1000 + id AS SK_ID_CURR", "1D AS NUM_INSTALMENT_VERSION", "1L AS NUM_INSTALMENT_NUMBER",
        "-10D AS DAYS_INSTALMENT", "-10D AS DAYS_ENTRY_PAYMENT", "2D AS AMT_INSTALMENT", "2D AS AMT_PAYMENT",
    )
    got = features.installment_features(hot.union(cold))
    r = got.where("SK_ID_CURR = 1").first()
    assert (r["INST_PAYMENT_EVENT_COUNT"], r["INST_PREV_LOAN_COUNT"], r["INST_SCHEDULE_COUNT"]) == (30000, 7, 350)
    assert r["INST_PAID_AMOUNT_SUM"] == pytest.approx(300.0) and got.count() == 60001


def mart_rows(spark, rows):
    return spark.createDataFrame(rows, "SK_ID_CURR bigint, TARGET tinyint, SPLIT string, X double, C string")


PLAIN_MART = [(1, 0, "train", 1.0, "a"), (2, 1, "validation", None, "b"), (3, 0, "test", 2.0, None), (4, 1, "train", 1.0, "a")]


def test_states_tell_versions_apart(spark, tmp_path):
    v1 = mart_rows(spark, PLAIN_MART)
    v2 = mart_rows(spark, PLAIN_MART[::-1]).repartition(3).withColumn("Y", F.lit(1))
    one, two = mart_state.mart_state(v1, "v1"), mart_state.mart_state(v2, "v2")
    assert mart_state.changed_columns(one, two).count() == 0
    assert [(r["column_name"], r["missing"]) for r in mart_state.changed_columns(two, one).collect()] == [("Y", True)]
    assert mart_state.check_states({"v1": one, "v2": two})["v2"] == {
        "row_count": 4, "unique_ids": 4, "missing_ids": 0, "repeated_ids": 0, "invalid_targets": 0, "invalid_splits": 0, "split_names": 3, "infinite_values": 0, "column_count": 6}
    # values that swap customers, a fan-out, a null for a value
    for change in ([(1, 0, "train", None, "a"), (2, 1, "validation", 1.0, "b")], [PLAIN_MART[0], PLAIN_MART[0], PLAIN_MART[1]], [(1, 0, "train", 1.0, None), PLAIN_MART[1]]):
        other = mart_state.mart_state(mart_rows(spark, [*change, *PLAIN_MART[2:]]), "v2")
        assert mart_state.changed_columns(one, other).count() > 0
        with pytest.raises(ContractError):
            mart_state.check_states({"v1": one, "v2": other})
    for k, row in enumerate([(None, 0, "train", 1.0, "a"), (5, 3, "train", 1.0, "a"), (5, None, "train", 1.0, "a"), (5, 0, "dev", 1.0, "a"), (5, 0, None, 1.0, "a"), (5, 0, "train", float("-inf"), "a"), (4, 0, "train", 1.0, "a")]):
        with pytest.raises(ContractError, match=["missing_ids", "invalid_targets", "invalid_targets", "invalid_splits", "invalid_splits", "infinite_values", "repeated_ids"][k]):
            mart_state.check_states({"v1": mart_state.mart_state(mart_rows(spark, [*PLAIN_MART, row]), "v1")})
    one.write.parquet(f"{tmp_path}/states")
    kept = spark.read.parquet(f"{tmp_path}/states")
    mart_state.check_loaded(v1.repartition(2), kept, "v1")
    with pytest.raises(ContractError, match="'X'"):
        mart_state.check_loaded(v1.withColumn("X", F.col("X") * 2), kept, "v1")
    with pytest.raises(ContractError, match="no published state"):
        mart_state.check_loaded(v1, kept, "v9")
    with pytest.raises(ContractError):
        mart_state.check_states({"v1": mart_state.mart_state(v1.limit(0), "v1")})


def test_source_contract_reads_each_table_once(spark, tmp_path):
    names = ("application", "splits", "bureau", "payments")
    for name, df in zip(names, world.tables(spark), strict=True):
        df.write.parquet(f"{tmp_path}/{name}")
    contract = quality.source_contract(*[spark.read.parquet(f"{tmp_path}/{n}") for n in names])
    got = {(r["scope"], r["check_name"]): r["value"] for r in contract.collect()}
    plan = contract._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 4
    assert got["application", "row_count"] == 4 and got["splits", "assignment_mismatches"] == 0 and got["installments", "row_count"] == 6
    app, splits_, bureau, payments = world.tables(spark)
    more = splits_.where("SK_ID_CURR > 100001").unionByName(spark.createDataFrame([(100001, 1, "train"), (None, 0, "test"), (7, 0, "dev")], world.SPLITS))
    paid = payments.unionByName(spark.createDataFrame([(11, 100002, 1.0, 9, 5.0, None, 1.0, 2.0), (None, 1, 1.0, 1, -1.0, 1.0, 1.0, 1.0), (None, 2, 1.0, 1, -2.0, 1.0, 1.0, 1.0), (13, 100003, 1.0, 1, -399.0, -401.0, 100.0, 1.0)], world.PAYMENTS))
    got = {(r["scope"], r["check_name"]): r["value"] for r in quality.source_contract(app, more, bureau, paid).collect()}
    assert (got["splits", "assignment_mismatches"], got["splits", "invalid_splits"], got["splits", "missing_ids"]) == (3, 1, 1)
    ins = {k[1]: v for k, v in got.items() if k[0] == "installments"}
    assert ins == {"row_count": 10, "missing_keys": 2, "future_due_rows": 1, "future_payment_rows": 2, "mismatched_missingness": 1, "owner_violations": 1, "inconsistent_schedules": 1}


def test_lineage_compares_marts_built_from_one_another(spark, monkeypatch):
    from riskgrain.plans import catalog

    credits = catalog.rolemap.bureau
    # amounts that every build draws anew: only a second build of V2 would make V3 differ from it
    monkeypatch.setattr(catalog.rolemap, "bureau", lambda s, d: credits(s, d).withColumn("AMT_CREDIT_SUM", F.rand() * 1000))
    assert catalog.QUERIES["mart_lineage_states"](spark, "/root/testdata/sf0.001").collect() == []
