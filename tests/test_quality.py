import pytest
from pyspark.sql import functions as F

from riskgrain.operators import profiling, quality, raw_text
from riskgrain.schemas import APPLICATION, BUREAU, INSTALLMENTS, TABLES, ContractError, feature_family, resolve_roles, schema_fingerprint


def text_rows(spark, table, overrides):
    """Full-width text rows filled with 0 and overridden per case."""
    spec = TABLES[table]
    base = dict.fromkeys(spec.columns, "0") | {"FLAG_OWN_CAR": "N", "FLAG_OWN_REALTY": "Y", "DAYS_BIRTH": "-9000", "SK_ID_CURR": "1"}
    base |= {"SK_ID_BUREAU": "1", "SK_ID_PREV": "1"}
    rows = [tuple({**base, **o}[c] for c in spec.columns) for o in overrides]
    return spark.createDataFrame(rows, spec.text_schema())


def violations(df, table):
    return {r["rule"]: r["violations"] for r in raw_text.rule_violations(df, table).collect() if r["violations"]}


def test_table_widths():
    assert [len(t.columns) for t in (APPLICATION, BUREAU, INSTALLMENTS)] == [122, 17, 8]
    assert len(APPLICATION.categorical) == 16


def test_application_rules(spark):
    df = text_rows(spark, "application", [
        {"SK_ID_CURR": "1"},
        {"SK_ID_CURR": "2", "TARGET": "3", "DAYS_BIRTH": "5", "DAYS_EMPLOYED": "10", "HOUR_APPR_PROCESS_START": "24"},
        {"SK_ID_CURR": "-3.5", "FLAG_MOBIL": "2", "FLAG_OWN_CAR": "Q", "AMT_CREDIT": "-1", "AMT_ANNUITY": "abc"},
        {"SK_ID_CURR": None, "DAYS_EMPLOYED": "365243", "FLAG_EMAIL": None},
    ])
    assert violations(df, "application") == {
        "target_domain": 1, "days_birth_negative": 1, "days_employed_domain": 1, "hour_range": 1, "sk_id_curr_integer": 1,
        "sk_id_curr_positive": 1, "flag_mobil_binary": 1, "flag_own_car_yn": 1, "amt_credit_non_negative": 1,
        "amt_annuity_numeric": 1, "sk_id_curr_not_null": 1, "flag_email_binary": 1,
    }


def test_child_rules_and_observations(spark):
    b = text_rows(spark, "bureau", [{"CREDIT_DAY_OVERDUE": "-1", "AMT_CREDIT_SUM_DEBT": "-5"}, {"CREDIT_ACTIVE": "Closed", "DAYS_ENDDATE_FACT": None}])
    assert violations(b, "bureau") == {"credit_day_overdue_non_negative": 1}
    seen = {r["observation"]: r["row_count"] for r in quality.domain_observations(b, "bureau").collect()}
    assert seen["negative_credit_sum_debt"] == 1 and seen["closed_without_enddate_fact"] == 1
    i = text_rows(spark, "installments", [{"DAYS_INSTALMENT": "1"}, {"DAYS_ENTRY_PAYMENT": None}, {"DAYS_ENTRY_PAYMENT": "-1", "AMT_PAYMENT": "3"}])
    assert violations(i, "installments") == {"days_instalment_non_positive": 1}
    seen = {r["observation"]: r["row_count"] for r in quality.domain_observations(i, "installments").collect()}
    assert seen["payment_fields_missing_mismatch"] == 1 and seen["payment_early"] == 2 and seen["payment_above_scheduled"] == 1


def test_duplicates_keys_and_dependencies(spark):
    i = text_rows(spark, "installments", [{}, {}, {"AMT_PAYMENT": "0.0"}, {"SK_ID_CURR": "2"}])
    plain = quality.duplicate_rows(i).first()
    assert (plain["row_count"], plain["duplicate_count"]) == (4, 1)
    assert quality.duplicate_rows(quality.normalise_numbers(i, INSTALLMENTS.numeric)).first()["duplicate_count"] == 2
    assert quality.dependency_violations(i, "SK_ID_PREV", "SK_ID_CURR").first()["violating_keys"] == 1
    k = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k bigint")
    assert tuple(quality.primary_key(k, "k").first()) == (4, 1, 2, 1)


def test_nulls_do_not_collide_in_duplicate_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert quality.duplicate_rows(df).first()["duplicate_count"] == 0


def test_findings_and_status(spark):
    df = text_rows(spark, "application", [{"SK_ID_CURR": "1", "AMT_CREDIT": "inf", "EXT_SOURCE_1": None}, {"SK_ID_CURR": "1", "EXT_SOURCE_1": None}])
    codes = {(r["code"], r["subject"]) for r in raw_text.table_findings(df, "application", 3).collect()}
    assert {("infinite_numeric_value", "AMT_CREDIT"), ("high_missing_rate", "EXT_SOURCE_1"), ("primary_key_duplicate", "SK_ID_CURR"), ("row_count_mismatch", None), ("target_imbalance", "TARGET")} <= codes
    assert quality.validation_status(raw_text.table_findings(df, "application")).first()["status"] == "FAIL"
    clean = text_rows(spark, "application", [{"SK_ID_CURR": "1"}, {"SK_ID_CURR": "2", "TARGET": "1"}])
    assert quality.validation_status(raw_text.table_findings(clean, "application")).first()["status"] == "PASS"
    with pytest.raises(ContractError):
        quality.check_exact_columns(clean.drop("AMT_CREDIT"), "application")


def test_no_token_reaches_a_cast_that_fails(spark):
    numbers = ["1", "-1.5", "+.5", "5.", " 7 ", "1e5", "1E-3", "inf", "-Infinity", "+INF", "0x1.8p1", "-0.0", "\t3\n"]
    others = ["", " ", ".", "-", "1e", "e5", "1d", "2.F ", "1 2", "nan", "-NaN", "Infinityx", "info", "N", "id5", "0,5", "1_0", "0x1", "\u0661"]
    df = spark.createDataFrame([(t,) for t in [*numbers, *others]], "t string")
    t, cast = F.col("t"), F.col("t").try_cast("double")
    suffix = t.rlike(r"[0-9.][dDfF]\s*$")
    rows = df.select("t", raw_text.parsed(t).alias("v"), t.rlike(raw_text.NUMBER).alias("fit"), F.when(~suffix & ~F.isnan(cast), cast).alias("old")).collect()
    assert all(r["v"] == r["old"] for r in rows), [r for r in rows if r["v"] != r["old"]]
    assert {r["t"] for r in rows if r["fit"]} == set(numbers) and all(r["v"] is not None for r in rows if r["fit"])


def scans(df):
    """Files scans of the plan as it ran; a reused exchange is not scanned again."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_text_states_see_every_kind_of_token_in_one_scan(spark, tmp_path):
    rows = [
        {"SK_ID_CURR": "1", "AMT_CREDIT": "inf", "AMT_ANNUITY": "1d", "CNT_CHILDREN": "0", "NAME_HOUSING_TYPE": "7"},
        {"SK_ID_CURR": "1.0", "AMT_CREDIT": "inf", "AMT_ANNUITY": "1d", "CNT_CHILDREN": "0.0", "NAME_HOUSING_TYPE": "7"},
        {"SK_ID_CURR": None, "TARGET": "1", "AMT_CREDIT": "-1e3", "AMT_ANNUITY": " ", "CNT_CHILDREN": " 2 ", "NAME_HOUSING_TYPE": "House"},
        {"SK_ID_CURR": "-Infinity", "TARGET": None, "AMT_CREDIT": "NaN", "AMT_ANNUITY": "", "REG_CITY_NOT_WORK_CITY": None, "LIVE_CITY_NOT_WORK_CITY": "no"},
    ]
    text_rows(spark, "application", rows).write.parquet(f"{tmp_path}/a")
    df = spark.read.parquet(f"{tmp_path}/a")
    states = raw_text.column_states(df, "application")
    assert scans(states) == 1
    got = {r["column_name"]: r for r in states.collect()}
    assert len(got) == 122 + 2
    pick = lambda c: tuple(got[c][k] for k in ("row_count", *raw_text.COUNTERS, "min_value", "max_value"))
    assert pick("AMT_CREDIT") == (4, 1, 0, 0, 2, 0, 1, 0, -1000.0, -1000.0)
    assert pick("AMT_ANNUITY") == (4, 0, 2, 4, 0, 0, 0, 0, None, None)
    assert pick("CNT_CHILDREN") == (4, 0, 0, 0, 0, 0, 0, 0, 0.0, 2.0)
    assert pick("SK_ID_CURR")[:7] == (4, 1, 0, 0, 1, 0, 0)
    assert got["REG_CITY_NOT_WORK_CITY"]["outside_count"] == 1 and got["LIVE_CITY_NOT_WORK_CITY"]["outside_count"] == 1
    assert (got["TARGET"]["missing_count"], got["TARGET"]["outside_count"], got["TARGET"]["one_count"]) == (1, 0, 1)
    assert (got["#row"]["surplus"], got["#key"]["surplus"], got["#key"]["missing_count"], got["#key"]["groups"]) == (1, 1, 1, 2)
    findings = raw_text.findings_of(states, "application", df.columns, 3)
    assert scans(findings) == 1
    found = {(r["code"], r["subject"]): r["value"] for r in findings.collect()}
    assert found["dtype_drift", "NAME_HOUSING_TYPE"] == 1.0 and found["target_invalid", "TARGET"] == 1.0 and found["row_count_mismatch", None] == 4.0
    assert found["duplicate_row", None] == 1.0 and ("rule_violation", "live_city_not_work_city_binary") in found
    parts = df.where("TARGET is null").unionByName(df.where("false")), df.where("TARGET is not null")
    merged = raw_text.merged_states(raw_text.column_states(parts[0], "application").unionByName(raw_text.column_states(parts[1], "application")))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in states.where("column_name not like '#%'").collect()}


def test_text_states_of_loans_and_empty_tables(spark):
    i = text_rows(spark, "installments", [
        {"SK_ID_PREV": "5", "SK_ID_CURR": "1"}, {"SK_ID_PREV": "5.0", "SK_ID_CURR": "2"}, {"SK_ID_PREV": "6", "SK_ID_CURR": "1"}, {"SK_ID_PREV": "6", "SK_ID_CURR": "1.0"},
        {"SK_ID_PREV": None, "SK_ID_CURR": "1"}, {"SK_ID_PREV": None, "SK_ID_CURR": "2"}, {"SK_ID_PREV": "7", "SK_ID_CURR": "x"}])
    got = {r["column_name"]: r for r in raw_text.column_states(i, "installments").collect()}
    assert (got["#owner"]["groups"], got["#owner"]["conflicts"], got["#row"]["surplus"]) == (3, 1, 1)
    none = {r["column_name"] for r in raw_text.column_states(i.where("false"), "installments").collect()}
    assert none == set()
    with pytest.raises(ContractError):
        raw_text.column_states(spark.range(0).select(), "bureau")
    # extra columns are taken for numbers, their names may hold dots
    b = spark.createDataFrame([("1", "2", "x")], "SK_ID_CURR string, SK_ID_BUREAU string, `a b` string")
    assert {r["rule"]: r["violations"] for r in raw_text.rule_violations(b, "bureau").collect()}["a b_numeric"] == 1


def test_coverage_overlap_and_reconciliation(spark):
    make = lambda ids: spark.createDataFrame([(i,) for i in ids], "SK_ID_CURR bigint")
    app, b, i = make([1, 2, 3, 4]), make([1, 1, 9]), make([1, 3, 3, 8, 7])
    c = {r["table_name"]: r for r in quality.history_coverage(app, {"bureau": b, "installments": i}).collect()}
    assert (c["bureau"]["matched_customers"], c["bureau"]["outside_customers"], c["installments"]["matched_rows"]) == (1, 1, 3)
    assert {r["coverage"]: r["customers"] for r in quality.history_overlap(app, b, i).collect()} == {"both": 1, "bureau_only": 0, "installments_only": 1, "neither": 2}
    l = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "SK_ID_CURR bigint, TARGET int")
    r = spark.createDataFrame([(1, 1), (3, 1), (4, 0)], "SK_ID_CURR bigint, TARGET int")
    got = quality.reconcile(l, r, ["TARGET"]).first()
    assert (got["only_left"], got["only_right"], got["target_differs"], got["mismatches"]) == (1, 1, 1, 3)
    with pytest.raises(ContractError):
        quality.attach_audit_attribute(l, r, "TARGET")


def test_roles_and_names(spark):
    df = spark.createDataFrame([(1, 0, "train", "F", 1.0, "a", 2.0)], "SK_ID_CURR long, TARGET tinyint, SPLIT string, CODE_GENDER string, X double, C string, BUREAU_N double")
    roles = resolve_roles(df)
    assert roles.numeric == ("X", "BUREAU_N") and roles.categorical == ("C",)
    assert roles.source_groups() == {"application": ("X", "C"), "bureau": ("BUREAU_N",), "installments": ()}
    with pytest.raises(ContractError):
        resolve_roles(df.withColumn("SK_ID_PREV", F.lit(1)))
    with pytest.raises(ContractError):
        resolve_roles(df, "v1")
    with pytest.raises(ContractError):
        resolve_roles(df.withColumn("A", F.array(F.lit(1))))
    assert schema_fingerprint(df) != schema_fingerprint(df.select("X"))
    assert [feature_family(f) for f in ("INST_HAS_HISTORY", "BUREAU_DEBT_OBSERVED_COUNT", "INST_LATE_RATIO", "INST_PAYMENT_GAP_SUM", "APP_AGE_YEARS")] == ["binary_flag", "count", "ratio", "continuous", "duration"]


EDA = "SK_ID_CURR bigint, TARGET int, AMT_INCOME_TOTAL double, DAYS_EMPLOYED bigint, EXT_SOURCE_2 double, CODE_GENDER string, NAME_FAMILY_STATUS string, FLAG_OWN_CAR string, OWN_CAR_AGE double, FLAG_MOBIL int"
EDA_ROWS = [
    (1, 0, 10.0, -5, None, "F", "Married", "Y", None, 1), (2, 0, 20.0, 365243, 0.5, "XNA", "Unknown", "N", None, 1), (3, 1, 30.0, -7, None, "M", "Married", "N", None, 1),
    (4, 1, 9e9, 365243, 0.1, "XNA", "Unknown", "Y", None, 0), (5, 0, -9e9, 365243, 0.1, "XNA", "Unknown", "Y", None, 0),
]


def test_profiles_read_training_rows_only(spark):
    a = spark.createDataFrame([(i, t) for i, t in ((1, "train"), (2, "train"), (3, "train"), (4, "test"), (5, "validation"))], "SK_ID_CURR bigint, SPLIT string")
    train = profiling.train_rows(spark.createDataFrame(EDA_ROWS, EDA), a)
    s = profiling.numeric_summary(train, ["AMT_INCOME_TOTAL"]).first()
    assert (s["mean"], s["min"], s["max"], s["std"]) == (20.0, 10.0, 30.0, 10.0) and s["p99"] == pytest.approx(29.8)
    k = {r["observation"]: (r["n"], r["base"]) for r in profiling.known_values(train).collect()}
    assert k == {"DAYS_EMPLOYED_SENTINEL": (1, 3), "CODE_GENDER_XNA": (1, 3), "NAME_FAMILY_STATUS_Unknown": (1, 3), "OWN_CAR_AGE_MISSING_AMONG_OWNERS": (1, 1)}
    assert [r["column_name"] for r in profiling.near_constant(train, ["FLAG_MOBIL", "CODE_GENDER"]).collect()] == ["FLAG_MOBIL"]
    m = {r["column_name"]: r["missing_rate"] for r in profiling.missingness(train).collect()}
    assert m["EXT_SOURCE_2"] == pytest.approx(2 / 3)


def test_correlation_of_pairs_equals_builtin(spark):
    """``d`` is constant, ``e`` is constant wherever ``c`` is observed, ``f`` has one infinity."""
    df = spark.range(200).selectExpr(
        "CAST(id AS DOUBLE) a", "CAST(id * id % 37 AS DOUBLE) b", "IF(id % 5 = 0, NULL, CAST(id * 7 % 11 AS DOUBLE)) c", "1D d",
        "IF(id % 5 = 0, id / 3D, 0.1D) e", "IF(id = 3, CAST('Infinity' AS DOUBLE), CAST(id * 13 % 17 AS DOUBLE)) f",
    )
    got = {(r["left_column"], r["right_column"]): r["correlation"] for r in profiling.correlation_pairs(df, list("abcdef")).collect()}
    names = [x + y for x, y in ("ab", "ac", "ae", "af", "bc", "be", "bf", "cf", "ef")]
    assert {x + y for x, y in got} == set(names)
    known = df.where("f < 1e300")
    for x, y in names:
        want = (known if "f" in (x, y) else df).selectExpr(f"corr({x}, {y})").first()[0]
        assert got[x, y] == pytest.approx(want, abs=1e-9)


def test_category_relation_pools_thin_levels(spark):
    rows = [("a", i % 2) for i in range(30)] + [("b", 1)] * 12 + [("c", 0)] * 10 + [(None, 1)] * 25
    df = spark.createDataFrame(rows, "C string, TARGET int")
    got = {r["level"]: (r["n"], r["supported"]) for r in profiling.target_category(df, ["C"]).collect()}
    assert got == {"a": (30, True), "[rare levels]": (22, True), "[missing]": (25, True)}
