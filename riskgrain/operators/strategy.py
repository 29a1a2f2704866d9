"""Subgroup diagnostics at one global cut-off, with suppression and alerts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrain.functions.scalars import ratio
from riskgrain.operators.metrics import binary_metrics, calibration_summary, score_curve
from riskgrain.schemas import ContractError

# Support limits and alert thresholds.
MIN_PUBLISHED_ROWS = 20
MIN_RELIABLE_ROWS = 1000
MIN_RELIABLE_CLASS = 50
ROC_AUC_DROP = 0.05
BRIER_RISE = 0.02
ABSOLUTE_BIAS = 0.03
RECALL_DROP = 0.10



def subgroup_columns() -> dict[str, Column]:
    """Group name per family as a column expression; NULL marks a broken input."""
    b, i = F.col("BUREAU_HAS_HISTORY"), F.col("INST_HAS_HISTORY")
    seen, age, gender = F.col("APP_EXT_SOURCE_OBSERVED_COUNT"), F.col("APP_AGE_YEARS"), F.col("CODE_GENDER")
    return {
        "financial_history_coverage": F.when((b == 1) & (i == 1), "both_histories")
        .when((b == 0) & (i == 1), "installments_only")
        .when((b == 1) & (i == 0), "bureau_only")
        .when((b == 0) & (i == 0), "neither_history"),
        "external_score_coverage": F.when(seen.isin(0, 1), "zero_or_one_score")
        .when(seen == 2, "two_scores")
        .when(seen == 3, "three_scores"),
        "age_band": F.when(age.isNull() | F.isnan(age.cast("double")), "age_missing")
        .when(age < 30, "under_30")
        .when(age < 50, "age_30_to_49")
        .otherwise("age_50_plus"),
        "gender_audit": F.when(gender == "F", "female_recorded")
        .when(gender == "M", "male_recorded")
        .otherwise("other_or_unknown"),
    }


def subgroup_rows(scored: DataFrame) -> DataFrame:
    """One row per scored row and family (a fixed factor of four)."""
    cells = [F.struct(F.lit(k).alias("family"), e.alias("group")) for k, e in subgroup_columns().items()]
    return scored.select("label", "score", F.inline(F.array(*cells)))


def completeness(scored: DataFrame) -> DataFrame:
    """Rows per family against the total, and rows without a group."""
    long = subgroup_rows(scored).withColumnRenamed("group", "group_name")
    total = scored.agg(F.count("*").alias("n")).scalar()
    return long.groupBy("family").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("group_name").isNull()).alias("unassigned")
    ).withColumn("total_rows", total)


def overall_reference(scored: DataFrame, cutoff: float) -> DataFrame:
    m = binary_metrics(score_curve(scored), threshold=cutoff)
    return m.select(
        F.col("roc_auc").alias("all_roc_auc"),
        F.col("brier_score").alias("all_brier"),
        F.col("recall").alias("all_recall"),
        (F.col("predicted_positive_count") / F.col("sample_count")).alias("all_selection_rate"),
    )


def subgroup_metrics(scored: DataFrame, cutoff: float, reference: dict[str, float] | None = None) -> DataFrame:
    """Metrics, deltas and alert flags per (family, group).

    Groups under 20 rows keep only their size. Alerts need 1,000 rows and 50 of each class.
    ``reference`` overrides the overall metrics the deltas are taken against.
    """
    long = subgroup_rows(scored).withColumnRenamed("group", "group_name")
    keys = ["family", "group_name"]
    curve = score_curve(long, keys)
    c = F.col
    if reference is None:
        row = overall_reference(scored, cutoff).first()
        if row is None:
            raise ContractError("no scores to evaluate")
        reference = row.asDict()
    ref = {k: F.lit(v).cast("double") for k, v in reference.items()}
    m = binary_metrics(curve, keys, threshold=cutoff)
    cal = calibration_summary(curve, keys).select(*keys, "mean_probability_bias", "expected_calibration_error")
    # one row per group
    j = m.join(cal, keys)
    n = c("sample_count")
    shown = n >= MIN_PUBLISHED_ROWS
    reliable = (
        (n >= MIN_RELIABLE_ROWS) & (c("positive_count") >= MIN_RELIABLE_CLASS) & (c("negative_count") >= MIN_RELIABLE_CLASS)
    )
    selection = c("predicted_positive_count") / n
    details = {
        "positive_count": c("positive_count"),
        "negative_count": c("negative_count"),
        "positive_rate": c("prevalence"),
        "mean_score": c("mean_score"),
        "mean_bias": c("mean_probability_bias"),
        "expected_calibration_error": c("expected_calibration_error"),
        "brier_score": c("brier_score"),
        "roc_auc": c("roc_auc"),
        "pr_auc": c("pr_auc"),
        "pr_auc_over_prevalence": ratio(c("pr_auc"), c("prevalence")),
        "ks": c("ks"),
        "selected_count": c("predicted_positive_count"),
        "selection_rate": selection,
        "true_positive": c("true_positive"),
        "false_positive": c("false_positive"),
        "recall": c("recall"),
        "precision": c("precision"),
        "top_recall": c("top_recall"),
        "delta_roc_auc": c("roc_auc") - ref["all_roc_auc"],
        "delta_brier": c("brier_score") - ref["all_brier"],
        "delta_recall": c("recall") - ref["all_recall"],
        "delta_selection_rate": selection - ref["all_selection_rate"],
    }
    out = j.select(
        *keys,
        n.alias("row_count"),
        F.when(shown, "reported").otherwise("suppressed_small_group").alias("detail_status"),
        (shown & reliable).alias("reliable"),
        *[F.when(shown, e).alias(k) for k, e in details.items()],
    )
    triggers = {
        "roc_auc_drop": c("roc_auc") < ref["all_roc_auc"] - ROC_AUC_DROP,
        "brier_increase": c("brier_score") > ref["all_brier"] + BRIER_RISE,
        "absolute_calibration_bias": F.abs(c("mean_bias")) > ABSOLUTE_BIAS,
        "global_cutoff_recall_drop": c("recall") < ref["all_recall"] - RECALL_DROP,
    }
    names = F.array_compact(F.array(*[F.when(c("reliable") & t, k) for k, t in triggers.items()]))
    return out.withColumn("alerts", F.array_join(names, ";"))


def alert_rows(subgroups: DataFrame) -> DataFrame:
    """One row per raised alert with the observed value, its reference and the trigger."""
    c = F.col
    cases = {
        "roc_auc_drop": (c("roc_auc"), c("roc_auc") - c("delta_roc_auc"), c("delta_roc_auc"), -ROC_AUC_DROP),
        "brier_increase": (c("brier_score"), c("brier_score") - c("delta_brier"), c("delta_brier"), BRIER_RISE),
        "absolute_calibration_bias": (c("mean_bias"), F.lit(0.0), c("mean_bias"), ABSOLUTE_BIAS),
        "global_cutoff_recall_drop": (c("recall"), c("recall") - c("delta_recall"), c("delta_recall"), -RECALL_DROP),
    }
    cells = [
        F.struct(
            F.lit(k).alias("alert"), v.alias("observed_value"), o.alias("overall_reference"),
            d.alias("difference"), F.lit(t).alias("trigger_threshold"),
        )
        for k, (v, o, d, t) in cases.items()
    ]
    raised = subgroups.withColumn("_a", F.split("alerts", ";")).where(F.col("alerts") != "")
    long = raised.select("family", "group_name", "_a", F.inline(F.array(*cells)))
    return long.where(F.array_contains("_a", F.col("alert"))).drop("_a")


def alert_review(subgroups: DataFrame) -> DataFrame:
    """Brier of the constant prevalence forecast and the skill against it, per reported group."""
    c = F.col
    base = c("positive_rate") * (1.0 - c("positive_rate"))
    return subgroups.where(c("detail_status") == "reported").select(
        "family", "group_name", "row_count", "alerts",
        base.alias("constant_brier"),
        (1.0 - ratio(c("brier_score"), base)).alias("brier_skill"),
        "mean_bias", "top_recall",
    )


def unexpected_alerts(alerts: DataFrame, expected: list[tuple[str, str, str]]) -> DataFrame:
    """Raised alerts that nobody has reviewed, and reviewed ones that no longer appear."""
    spark = alerts.sparkSession
    known = spark.createDataFrame(expected, "family string, group_name string, alert string")
    on = ["family", "group_name", "alert"]
    raised = alerts.select(*on)
    return raised.join(known, on, "left_anti").withColumn("status", F.lit("new")).unionByName(
        known.join(raised, on, "left_anti").withColumn("status", F.lit("gone"))
    )


def enforce_alert_review(review: DataFrame, unexpected: DataFrame) -> None:
    """Block when the alert set changed, skill is not positive or bias is at the limit."""
    weak = review.where(F.col("alerts") != "").where((F.col("brier_skill") <= 0) | (F.abs("mean_bias") >= ABSOLUTE_BIAS))
    if not unexpected.isEmpty():
        raise ContractError("subgroup alerts differ from the reviewed set")
    if not weak.isEmpty():
        raise ContractError("a subgroup alert needs further review")
