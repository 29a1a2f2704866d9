import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskgrain.operators import attribution, metrics, models, prep, records, selection
from riskgrain.plans.build import score_batch, strategy_report, validate_raw
from riskgrain.schemas import ContractError, FeatureRoles
from riskgrain.sources import readers, sinks
from riskgrain.streaming.scoring import score_stream

PREP = "id bigint, AMT double, OWN_CAR_AGE double, OWN_CAR_AGE_NOT_APPLICABLE int, OWN_CAR_AGE_MISSING int, DEBT double, EMPTY double, KIND string"
TRAIN = [
    (1, 10.0, None, 1, 0, 100.0, None, "A"), (2, 20.0, 8.0, 0, 0, None, None, "A"),
    (3, None, None, 0, 1, 0.0, None, None), (4, 30.0, 8.0, 0, 0, 300.0, None, "XNA"),
]
ROLES = FeatureRoles(("AMT", "OWN_CAR_AGE", "OWN_CAR_AGE_NOT_APPLICABLE", "OWN_CAR_AGE_MISSING", "DEBT", "EMPTY"), ("KIND",))


def vectors(df, fitted):
    out = prep.transform(df, fitted, ("id",)).collect()
    return {r["id"]: dict(zip(fitted.output_names, r["features"].toArray())) for r in out}


def test_preprocessing_is_fit_on_train_only(spark):
    train = spark.createDataFrame(TRAIN, PREP)
    fitted = prep.fit(train, ROLES, "tree")
    held = spark.createDataFrame([(9, None, None, 0, 1, None, 5.0, "new"), (10, 1e9, None, 1, 0, 0.0, None, None)], PREP)
    v = vectors(train.union(held), fitted)
    assert v[2]["numeric__DEBT"] == 100.0 and v[2]["numeric__missingindicator_DEBT"] == 1.0
    assert v[3]["numeric__DEBT"] == 0.0 and v[3]["numeric__missingindicator_DEBT"] == 0.0
    assert v[3]["numeric__OWN_CAR_AGE"] == 8.0 and v[1]["numeric__OWN_CAR_AGE"] == 0.0
    assert v[1]["numeric__EMPTY"] == 0.0 and v[1]["numeric__missingindicator_EMPTY"] == 1.0
    assert v[9]["numeric__AMT"] == 20.0 and "numeric__missingindicator_OWN_CAR_AGE" not in v[9]
    levels = [n for n in fitted.output_names if n.startswith("categorical__")]
    assert sorted(levels) == ["categorical__KIND_A", "categorical__KIND_XNA", "categorical__KIND___MISSING__"]
    assert sum(v[9][n] for n in levels) == 0 and v[10]["categorical__KIND___MISSING__"] == 1.0
    assert [k for _, _, k in fitted.slot_sources][:1] == ["numeric_value"]


def test_linear_family_scales_by_population_deviation(spark):
    rows = [(1, 1.0, "A"), (2, 3.0, "A"), (3, None, "A")]
    df = spark.createDataFrame(rows, "id bigint, X double, KIND string")
    fitted = prep.fit(df, FeatureRoles(("X",), ("KIND",)), "linear")
    assert fitted.medians["X"] == 2.0 and fitted.scales["X"] == pytest.approx((2 / 3) ** 0.5)
    v = vectors(df, fitted)
    assert v[2]["numeric__X"] == pytest.approx(3 / (2 / 3) ** 0.5) and v[3]["numeric__missingindicator_X"] == 1.0


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_rare_levels_pool_and_unseen_pass(spark, threshold):
    """The result does not depend on how Spark joins the rare levels."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    df = spark.createDataFrame([(i, 1.0, k) for i, k in enumerate("AAAAABBC")], "id bigint, X double, KIND string")
    fitted = prep.fit(df, FeatureRoles(("X",), ("KIND",)), "tree", 0.3)
    assert fitted.kept["KIND"] == ("A", "__RARE__")
    held = spark.createDataFrame([(1, 1.0, "A"), (2, 1.0, "B"), (3, 1.0, "C"), (4, 1.0, "Z"), (5, 1.0, None)], "id bigint, X double, KIND string")
    got = {r["id"]: r["KIND"] for r in prep.group_levels(held, fitted).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {1: "A", 2: "__RARE__", 3: "__RARE__", 4: "Z", 5: "__MISSING__"}


def test_feature_contract(spark):
    make = lambda rows: spark.createDataFrame(rows, PREP)
    for bad in ((5, 1.0, 3.0, 1, 0, 1.0, 1.0, "A"), (5, 1.0, None, 0, 0, 1.0, 1.0, "A"), (5, float("inf"), 1.0, 0, 0, 1.0, 1.0, "A"), (5, 1.0, 1.0, 0, 0, 1.0, 1.0, "__RARE__")):
        with pytest.raises(ContractError):
            prep.check_features(make([*TRAIN, bad]), ROLES)
    with pytest.raises(ContractError):
        prep.has_car_rule(make(TRAIN).drop("OWN_CAR_AGE_MISSING"))


@pytest.fixture(scope="module")
def learnable(spark):
    return spark.range(200).selectExpr(
        "id AS SK_ID_CURR", "CAST(id % 5 = 0 AS BIGINT) AS TARGET", "CAST(100 + id % 17 AS DOUBLE) AS A",
        "CAST(IF(id % 5 = 0, 50, 20) + id % 13 AS DOUBLE) AS B", "IF(id % 5 = 0 OR id % 11 = 0, 'r', 'c') AS K",
    ).cache()


MODEL_ROLES = FeatureRoles(("A", "B"), ("K",))


def test_models_learn_and_share_one_metric_contract(spark, learnable):
    train, validation = learnable.where("SK_ID_CURR % 4 <> 0"), learnable.where("SK_ID_CURR % 4 = 0")
    fit = {
        "logistic": ("linear", models.logistic(iterations=50)),
        "forest": ("tree", models.forest(numTrees=5, maxDepth=3, minInstancesPerNode=2)),
        "boosting": ("tree", models.boosting(maxIter=3, maxDepth=2, minInstancesPerNode=2)),
    }
    table = models.compare_experiments([models.Experiment(k, MODEL_ROLES, f, m) for k, (f, m) in fit.items()], train, validation)
    got = {r["model"]: r for r in table.collect()}
    assert set(got) == set(fit) and all(r["sample_count"] == 50 and r["roc_auc"] > 0.9 for r in got.values())
    w = models.balanced_weights(learnable)
    assert w == {0: 200 / 320, 1: 200 / 80}
    assert models.prior_scores(train, validation).select("score").distinct().count() == 1


@pytest.fixture
def small_marts(monkeypatch, spark, learnable):
    """The catalog's marts V1 to V3 over a few learnable rows, each one column wider."""
    from riskgrain.plans import catalog

    split = F.when(F.col("SK_ID_CURR") % 4 == 0, "validation").otherwise("train").alias("SPLIT")
    v1 = learnable.select("SK_ID_CURR", "TARGET", split, "A", "K")
    v2 = v1.withColumn("BUREAU_B", F.col("A") + F.col("SK_ID_CURR") % 3)
    v3 = v2.join(learnable.select("SK_ID_CURR", F.col("B").alias("INST_B")), "SK_ID_CURR")
    for name, mart in (("_v1", v1), ("_v2", v2), ("_v3", v3)):
        monkeypatch.setattr(catalog, name, lambda s, d, mart=mart: mart)
    return catalog


@pytest.fixture
def boosters(monkeypatch):
    """The settings that reach the booster, which a plain logistic model stands in for."""
    from pyspark.ml.classification import LogisticRegression

    seen = []

    def stand_in(featuresCol, labelCol, **settings):
        seen.append(settings)
        return LogisticRegression(featuresCol=featuresCol, labelCol=labelCol, maxIter=2)

    monkeypatch.setattr(models, "GBTClassifier", stand_in)
    return seen


def test_registered_boosting_runs_all_rounds(spark, small_marts, boosters, monkeypatch):
    monkeypatch.setattr(models, "FOREST", {"numTrees": 2, "maxDepth": 2})
    small_marts.QUERIES["gbt_scores"](spark, "")
    small_marts.QUERIES["model_comparison"](spark, "")
    assert len(boosters) >= 2
    assert all(b == models.BOOSTING | {"seed": 42} for b in boosters)


def test_models_take_all_features_of_their_mart(spark, small_marts, boosters, monkeypatch):
    monkeypatch.setattr(models, "FOREST", {"numTrees": 2, "maxDepth": 2})
    fits, whole = [], prep.fit
    monkeypatch.setattr(prep, "fit", lambda train, roles, *a: fits.append(set(roles.features)) or whole(train, roles, *a))
    v1, v2, v3 = {"A", "K"}, {"A", "K", "BUREAU_B"}, {"A", "K", "BUREAU_B", "INST_B"}
    names = {r["model"] for r in small_marts.QUERIES["model_comparison"](spark, "").collect()}
    assert names == {"logistic_v1", "logistic_v2", "logistic_v3", "forest_v3", "boosting_v1", "boosting_v2", "boosting_v3"}
    assert fits == [v1, v2, v3, v3, v1, v2, v3]
    fits.clear()
    for name in ("logistic_oof", "gbt_scores", "logistic_attribution", "batch_scoring"):
        small_marts.QUERIES[name](spark, "")
    assert fits and all(f == v3 for f in fits)


def test_boosting_candidates_meet_the_guards(spark, small_marts, boosters):
    got = {r["candidate"]: r for r in small_marts.QUERIES["boosting_candidates"](spark, "").collect()}
    assert {k: r["complexity"] for k, r in got.items()} == {k: o for k, (o, _) in models.BOOSTING_CANDIDATES.items()}
    assert sum(r["selected"] for r in got.values()) == 1
    assert boosters == [models.BOOSTING | options | {"seed": 42} for _, options in models.BOOSTING_CANDIDATES.values()] * 3


def test_out_of_fold_scores_cover_every_row_once(spark, learnable):
    oof = models.out_of_fold(learnable, MODEL_ROLES, {"m": models.logistic(iterations=20)}, 3, 42)
    r = models.oof_completeness(oof, learnable).first()
    assert (r["repeated"], r["scored_once"], r["unscored"]) == (0, 200, 0)
    metrics.check_scores(models.labelled(oof))


def test_logistic_attribution_is_additive(spark, learnable):
    fitted = prep.fit(learnable, MODEL_ROLES)
    design = prep.transform(learnable, fitted, ("SK_ID_CURR", "TARGET"))
    model = models.logistic(iterations=30)(design)
    long, base = attribution.model_attribution(design, model, fitted.output_names, design, "SK_ID_CURR")
    from pyspark.ml.functions import vector_to_array

    raw = model.transform(design).select("SK_ID_CURR", vector_to_array("rawPrediction")[1].alias("raw_score"))
    assert attribution.additivity(long, raw, base, "SK_ID_CURR").first()["holds"]
    assert models.convergence(model)["iterations"] > 0


def test_crossfit_calibration(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 5 = 0 AS INT) AS label", "0.1D + IF(id % 5 = 0, 0.3D, 0D) + (id % 7) / 50D AS score")
    cf = models.crossfit_calibration(df)
    per = cf.groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("id").alias("u"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    assert all(r["n"] == r["u"] == 100 and 0 <= r["lo"] <= r["hi"] <= 1 for r in per.collect()) and per.count() == 3
    with pytest.raises(ContractError):
        models.fit_calibrator("sigmoid", df.withColumn("label", 1 - F.col("label")))


def test_isotonic_averages_ties_and_clips(spark):
    df = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.2, 0), (0.5, 1)], "score double, label int")
    apply = models.fit_calibrator("isotonic", df)
    held = apply(spark.createDataFrame([(0.0,), (0.1,), (0.9,)], "score double")).collect()
    assert [round(r["score"], 6) for r in sorted(held, key=lambda r: r["score"])] == [pytest.approx(1 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6), 1.0]


def fold_table(spark, values):
    rows = [(k, o, f, pr, 0.75, 0.35) for k, (o, pr) in values.items() for f in (1, 2, 3)]
    return spark.createDataFrame(rows, "candidate string, complexity int, fold int, pr_auc double, roc_auc double, top_recall double")


@pytest.mark.parametrize("values,expected", [
    ({"baseline": (0, 0.2400), "x": (1, 0.2409)}, "baseline"),
    ({"baseline": (0, 0.2400), "x": (1, 0.2420)}, "x"),
    ({"baseline": (0, 0.2400), "simple": (1, 0.2421), "complex": (2, 0.2425)}, "simple"),
    ({"baseline": (0, 0.2400), "simple": (1, 0.2421), "complex": (2, 0.2435)}, "complex"),
])
def test_candidate_selection(spark, values, expected):
    chosen = selection.candidate_checks(fold_table(spark, values)).where("selected").collect()
    assert [r["candidate"] for r in chosen] == [expected]


@pytest.mark.parametrize("briers,expected", [
    ({"identity": 0.0700, "sigmoid": 0.0680, "isotonic": 0.0700}, "sigmoid"), ({"identity": 0.0700, "sigmoid": 0.0701, "isotonic": 0.0700}, "identity"),
    ({"identity": 0.0700, "sigmoid": 0.06805, "isotonic": 0.0680}, "sigmoid"), ({"identity": 0.0700, "sigmoid": 0.0690, "isotonic": 0.0680}, "isotonic"),
])
def test_calibration_selection(spark, briers, expected):
    folds = spark.createDataFrame([(m, f, b) for m, b in briers.items() for f in range(1, 6)], "method string, fold int, brier_score double")
    totals = spark.createDataFrame([(m, b, 0.25) for m, b in briers.items()], "method string, brier_score double, log_loss double")
    assert [r["method"] for r in selection.calibration_checks(folds, totals).where("selected").collect()] == [expected]


# --- record contract -------------------------------------------------------
NUMBERS = {
    "AMT_CREDIT": 10.0, "CNT_CHILDREN": 1.0, "DAYS_EMPLOYED": -5.0, "DAYS_EMPLOYED_SENTINEL": 0.0, "HOUR_APPR_PROCESS_START": 5.0, "FLAG_MOBIL": 1.0,
    "OWN_CAR_AGE": None, "OWN_CAR_AGE_NOT_APPLICABLE": 1.0, "OWN_CAR_AGE_MISSING": 0.0, "EXT_SOURCE_1": 0.2, "EXT_SOURCE_2": 0.4, "EXT_SOURCE_3": None,
    "APP_EXT_SOURCE_OBSERVED_COUNT": 2.0, "APP_EXT_SOURCE_MEAN": 0.3, "BUREAU_HAS_HISTORY": 0.0, "BUREAU_RECORD_COUNT": 0.0, "BUREAU_DEBT_SUM": None,
    "INST_HAS_HISTORY": 1.0, "INST_SCHEDULE_COUNT": 3.0, "INST_LATE_RATIO": 0.5,
}
RECORD = "record_id string, FLAG_OWN_CAR string, " + ", ".join(f"{n} double" for n in NUMBERS)
SPECS = records.field_specs(list(NUMBERS), ["FLAG_OWN_CAR"])


def record(**change):
    v = {"record_id": "r1", "FLAG_OWN_CAR": "N", **NUMBERS, **change}
    return tuple(v[c.split()[0]] for c in RECORD.split(", "))


MUTATIONS = [
    ({}, set()),
    ({"record_id": " "}, {("RECORD_ID", None)}), ({"record_id": "a\u0001"}, {("RECORD_ID", None)}), ({"record_id": "x" * 129}, {("RECORD_ID", None)}),
    ({"OWN_CAR_AGE_MISSING": None}, {("NULL_NOT_ALLOWED", "OWN_CAR_AGE_MISSING")}), ({"BUREAU_RECORD_COUNT": None}, {("NULL_NOT_ALLOWED", "BUREAU_RECORD_COUNT")}),
    ({"FLAG_OWN_CAR": ""}, {("CATEGORY_VALUE", "FLAG_OWN_CAR")}), ({"FLAG_OWN_CAR": "__MISSING__"}, {("CATEGORY_VALUE", "FLAG_OWN_CAR")}),
    ({"AMT_CREDIT": -1.0}, {("NUMERIC_RANGE", "AMT_CREDIT")}), ({"AMT_CREDIT": float("nan")}, {("NUMERIC_RANGE", "AMT_CREDIT")}),
    ({"AMT_CREDIT": float("inf")}, {("NUMERIC_RANGE", "AMT_CREDIT")}), ({"HOUR_APPR_PROCESS_START": 24.0}, {("NUMERIC_RANGE", "HOUR_APPR_PROCESS_START")}),
    ({"EXT_SOURCE_1": 1.1}, {("NUMERIC_RANGE", "EXT_SOURCE_1")}), ({"CNT_CHILDREN": 0.5}, {("INTEGER_REQUIRED", "CNT_CHILDREN")}),
    ({"OWN_CAR_AGE": 3.0}, {("CAR_AGE_FLAGS", None)}), ({"FLAG_OWN_CAR": "Y"}, {("CAR_OWNERSHIP_FLAGS", None)}),
    ({"DAYS_EMPLOYED": 365243.0}, {("EMPLOYMENT_SENTINEL", None)}), ({"DAYS_EMPLOYED_SENTINEL": 1.0}, {("EMPLOYMENT_SENTINEL", None)}),
    ({"APP_EXT_SOURCE_MEAN": 0.31}, {("EXTERNAL_SCORE_SUMMARY", None)}), ({"APP_EXT_SOURCE_MEAN": None}, {("EXTERNAL_SCORE_SUMMARY", None)}),
    ({"APP_EXT_SOURCE_MEAN": 0.3000001}, set()),
    ({"INST_SCHEDULE_COUNT": 0.0}, {("HISTORY_FLAG_COUNT", "INST_SCHEDULE_COUNT")}),
    ({"BUREAU_DEBT_SUM": 0.0}, {("ABSENT_HISTORY_VALUES", "BUREAU_DEBT_SUM")}),
]


def test_record_mutations_map_to_codes(spark):
    rows = [record(**{"record_id": f"r{i}", **m}) for i, (m, _) in enumerate(MUTATIONS)]
    got = records.validate_records(spark.createDataFrame(rows, RECORD).coalesce(1), SPECS).collect()
    by_id = {r["record_id"]: {(e["code"], e["field"]) for e in r["errors"]} for r in got}
    for i, (change, codes) in enumerate(MUTATIONS):
        assert by_id[change.get("record_id", f"r{i}")] == codes, change


def test_duplicates_types_and_batch_rejection(spark):
    twice = spark.createDataFrame([record(), record(), record(record_id="r2")], RECORD)
    v = records.validate_records(twice, SPECS)
    assert {r["code"]: r["row_count"] for r in records.error_counts(v).collect()} == {"DUPLICATE_RECORD_ID": 2}
    with pytest.raises(ContractError) as e:
        records.split_valid(v)
    assert "r1" not in str(e.value)
    valid, bad = records.split_valid(v, strict=False)
    assert (valid.count(), bad.count()) == (1, 2)
    text = spark.createDataFrame([record()], RECORD).withColumn("AMT_CREDIT", F.lit("ten"))
    assert records.error_counts(records.validate_records(text, SPECS)).first()["code"] == "NUMERIC_TYPE"
    with pytest.raises(ContractError):
        records.validate_records(text.drop("AMT_CREDIT"), SPECS)


POLICY = {"medium_cutoff": 0.08, "high_cutoff": 0.18, "review_cutoff": 0.18}


def test_registered_stream_drops_repeated_ids(spark, tuples):
    from riskgrain.plans import catalog

    folder = tempfile.mkdtemp()
    events = spark.range(40).selectExpr(
        "id % 20 AS event_id", "'view' AS event_type", "CAST(id % 20 * 3 AS DOUBLE) AS value", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id % 7) AS ts",
    )
    events.write.parquet(os.path.join(folder, "events.parquet"))
    once = tuples(catalog.QUERIES["stream_policy"](spark, folder))
    assert sorted(int(r[0]) for r in once) == list(range(20))
    assert tuples(catalog.QUERIES["stream_repeats"](spark, folder)) == once


def test_batch_scoring_and_stream_agree(spark):
    batch = spark.createDataFrame([record(record_id=f"r{i}", AMT_CREDIT=float(i)) for i in range(5)], RECORD)
    scorer = lambda df: df.withColumn("score", F.col("AMT_CREDIT") / 20.0)
    out = {r["record_id"]: r for r in score_batch(batch, SPECS, scorer, POLICY, {"FLAG_OWN_CAR": ["Y"]}).collect()}
    assert out["r0"]["risk_band"] == "low" and out["r2"]["risk_band"] == "medium" and out["r4"]["priority_review"]
    assert out["r1"]["missing_values"] == 3 and out["r1"]["unknown_categories"] == "FLAG_OWN_CAR"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.union(spark.createDataFrame([record(record_id="bad", AMT_CREDIT=-1.0)], RECORD)).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/in")
    q = score_stream(stream, SPECS, scorer, POLICY).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["record_id"]: r for r in spark.table("scored").collect()}
    assert got["bad"]["error_codes"] == "NUMERIC_RANGE" and got["bad"]["probability"] is None
    assert {k: r["risk_band"] for k, r in got.items() if k != "bad"} == {k: r["risk_band"] for k, r in out.items()}


# --- sources ---------------------------------------------------------------
def test_csv_and_parquet_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.mkdir(f"{folder}/raw")
    header = "SK_ID_PREV,SK_ID_CURR,NUM_INSTALMENT_VERSION,NUM_INSTALMENT_NUMBER,DAYS_INSTALMENT,DAYS_ENTRY_PAYMENT,AMT_INSTALMENT,AMT_PAYMENT"
    with open(f"{folder}/raw/i.csv", "w") as f:
        f.write(header + "\n1,2,1.0,3,-5.0,,10.5,NaN\n")
    r = readers.read_raw_csv(spark, f"{folder}/raw/i.csv", "installments").first()
    assert (r["SK_ID_PREV"], r["NUM_INSTALMENT_NUMBER"], r["DAYS_ENTRY_PAYMENT"], r["AMT_PAYMENT"]) == (1, 3, None, None)
    t = readers.read_raw_csv(spark, f"{folder}/raw/i.csv", "installments", as_text=True, view="raw_i")
    assert t.first()["AMT_PAYMENT"] == "NaN" and spark.table("raw_i").count() == 1
    with open(f"{folder}/raw/a.csv", "w") as f:
        f.write("TARGET,OTHER,SK_ID_CURR\n1,x,7\nbad,y,8\n0,z,9.5\n")
    got = readers.read_targets(spark, f"{folder}/raw/a.csv").collect()
    assert [(r["SK_ID_CURR"], r["TARGET"]) for r in got] == [(7, 1), (8, None), (None, 0)]
    a = spark.createDataFrame([(3, 0, "train"), (1, 1, "test"), (2, 0, "train")], "SK_ID_CURR bigint, TARGET bigint, SPLIT string")
    sinks.write_assignments(a.repartition(3), f"{folder}/splits")
    assert [r["SK_ID_CURR"] for r in readers.read_assignments(spark, f"{folder}/splits").collect()] == [1, 2, 3]
    sinks.write_mart(a, f"{folder}/mart")
    train = readers.read_development(spark, f"{folder}/mart", "train", FeatureRoles((), ()))
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert train.count() == 2 and "EqualTo(SPLIT,train)" in plan
    with pytest.raises(ContractError):
        readers.read_development(spark, f"{folder}/mart", "test", FeatureRoles((), ()))


def test_descriptions_fall_back_to_cp1252(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/d.csv", "wb") as f:
        f.write("Table,Row,Description,Special\nbureau,SK_BUREAU_ID,café,\n".encode("cp1252"))
    d = readers.read_descriptions(spark, f"{folder}/d.csv")
    assert d.first()["Description"] == "café"
    from riskgrain.operators import quality

    profile = quality.column_profile(spark.createDataFrame([(1, "x")], "SK_ID_BUREAU bigint, CREDIT_TYPE string"), ("CREDIT_TYPE",))
    got = {r["column_name"]: r["description"] for r in quality.data_dictionary(profile, d, "bureau").collect()}
    assert got == {"SK_ID_BUREAU": "café", "CREDIT_TYPE": None}


def test_raw_validation_and_strategy_plans(spark):
    from tests.test_quality import text_rows

    tables = {t: text_rows(spark, t, [{}]) for t in ("application", "bureau", "installments")}
    findings, status = validate_raw(tables)
    assert status.first()["status"] == "PASS" and findings.where("code = 'support_table_scope'").count() == 2
    rows = [(i, int(i % 4 == 0), 1 - i / 400, i % 2, 1, i % 4, 20.0 + i % 50, "F") for i in range(400)]
    from tests.test_scores import GROUP

    report = strategy_report(spark.createDataFrame(rows, GROUP))
    assert report["deciles"].count() == 10 and report["bands"].count() == 3 and report["subgroups"].count() >= 8
