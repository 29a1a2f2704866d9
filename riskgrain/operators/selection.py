"""Guarded selection rules as expressions over small metric tables (one row per candidate and fold)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Guards of candidate and calibration selection.
MIN_PR_AUC_GAIN = 0.001
MIN_WINNING_FOLDS = 2
MAX_ROC_AUC_LOSS = 0.001
MAX_RECALL_LOSS = 0.005
PR_AUC_TIE = 0.0005
MIN_BRIER_GAIN = 0.0001
MIN_CALIBRATION_WINS = 3
MAX_LOG_LOSS_RISE = 0.0001
BRIER_TIE = 0.0001

FOLD_METRICS = ("roc_auc", "pr_auc", "ks", "gini", "brier_score", "top_recall", "top_lift")


def fold_aggregate(folds: DataFrame, keys: Sequence[str], metrics: Sequence[str] = FOLD_METRICS) -> DataFrame:
    """Mean, population deviation, minimum and maximum of every fold metric."""
    long = folds.select(*keys, *[F.col(m).cast("double") for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"),
    )


def metric_deltas(table: DataFrame, key: str, minuend: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of one experiment minus those of every other, one row per other experiment."""
    base = table.where(F.col(key) == minuend).select(*[F.col(m).alias(f"_b_{m}") for m in metrics])
    rest = table.where(F.col(key) != minuend)
    return rest.select(
        F.concat(F.lit(f"{minuend}_minus_"), F.col(key)).alias("comparison"),
        *[(base.select(f"_b_{m}").scalar() - F.col(m)).alias(f"delta_{m}") for m in metrics],
    )


def experiment_deltas(
    table: DataFrame, model: str, data: str, versions: Sequence, baseline: str, metrics: Sequence[str]
) -> DataFrame:
    """(kind, subject, comparison, delta_...) between experiments, one row of ``table`` per model and data version.

    ``more_data``: the same model on a version minus the one before it. ``other_model``: on the same version another
    model minus the baseline. Pairs of which one side is absent have no row.
    """
    c, place = F.col, {v: i for i, v in enumerate(versions)}
    number = F.create_map(*[F.lit(x) for v, i in place.items() for x in (v, i)])[c(data)]
    rows = table.select(model, data, number.alias("_at"), *metrics).where(c("_at").isNotNull())
    other = rows.select(c(model).alias("_m"), c(data).alias("_d"), c("_at").alias("_o"), *[c(m).alias(f"_b_{m}") for m in metrics])
    deltas = [(c(m) - c(f"_b_{m}")).alias(f"delta_{m}") for m in metrics]

    def compared(kind: str, condition, subject: str, left: str, right: str) -> DataFrame:
        text = F.concat(c(left).cast("string"), F.lit("_minus_"), c(right).cast("string")).alias("comparison")
        return rows.join(other, condition).select(F.lit(kind).alias("kind"), c(subject).cast("string").alias("subject"), text, *deltas)

    more = compared("more_data", (c(model) == c("_m")) & (c("_at") == c("_o") + 1), model, data, "_d")
    against = (c("_at") == c("_o")) & (c("_m") == baseline) & (c(model) != baseline)
    return more.unionByName(compared("other_model", against, data, model, "_m"))


def _wins(folds: DataFrame, key: str, baseline: str, metric: str, higher: bool) -> DataFrame:
    """Folds in which a candidate beats the baseline."""
    base = folds.where(F.col(key) == baseline).select("fold", F.col(metric).alias("_base"))
    other = folds.where(F.col(key) != baseline).select(key, "fold", F.col(metric).alias("_own"))
    better = F.col("_own") > F.col("_base") if higher else F.col("_own") < F.col("_base")
    return other.join(base, "fold").groupBy(key).agg(F.count_if(better).alias("winning_folds"))


def candidate_checks(folds: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Deltas, wins, guards and the selected flag per candidate.

    ``folds``: candidate, complexity, fold, pr_auc, roc_auc, top_recall.
    """
    c = F.col
    means = folds.groupBy("candidate").agg(
        F.first("complexity").alias("complexity"),
        *[F.avg(m).alias(m) for m in ("pr_auc", "roc_auc", "top_recall")],
    )
    base = means.where(c("candidate") == baseline)
    delta = {m: c(m) - base.select(m).scalar() for m in ("pr_auc", "roc_auc", "top_recall")}
    checked = means.join(_wins(folds, "candidate", baseline, "pr_auc", True), "candidate", "left").select(
        "candidate", "complexity", "pr_auc",
        delta["pr_auc"].alias("pr_auc_delta"), delta["roc_auc"].alias("roc_auc_delta"),
        delta["top_recall"].alias("recall_delta"), "winning_folds",
    )
    eligible = (
        (c("candidate") != baseline)
        & (c("pr_auc_delta") >= MIN_PR_AUC_GAIN)
        & (c("winning_folds") >= MIN_WINNING_FOLDS)
        & (c("roc_auc_delta") >= -MAX_ROC_AUC_LOSS)
        & (c("recall_delta") >= -MAX_RECALL_LOSS)
    )
    return _select(
        checked.withColumn("eligible", F.coalesce(eligible, F.lit(False))),
        "candidate", baseline, best=F.max, value=c("pr_auc"), tie=PR_AUC_TIE,
        order=[c("complexity").asc(), c("pr_auc").desc(), c("candidate").asc()],
    )


def calibration_checks(folds: DataFrame, totals: DataFrame, baseline: str = "identity") -> DataFrame:
    """Guards and the selected flag per calibration method.

    ``folds``: method, fold, brier_score. ``totals``: method, brier_score, log_loss over all rows.
    """
    c = F.col
    base = totals.where(c("method") == baseline)
    checked = totals.join(_wins(folds, "method", baseline, "brier_score", False), "method", "left").select(
        "method", "brier_score", "log_loss",
        (base.select("brier_score").scalar() - c("brier_score")).alias("brier_gain"),
        (c("log_loss") - base.select("log_loss").scalar()).alias("log_loss_delta"),
        "winning_folds",
    )
    eligible = (
        (c("method") != baseline)
        & (c("brier_gain") >= MIN_BRIER_GAIN)
        & (c("winning_folds") >= MIN_CALIBRATION_WINS)
        & (c("log_loss_delta") <= MAX_LOG_LOSS_RISE)
    )
    preference = F.when(c("method") == "sigmoid", 0).otherwise(1)
    return _select(
        checked.withColumn("eligible", F.coalesce(eligible, F.lit(False))),
        "method", baseline, best=F.min, value=c("brier_score"), tie=BRIER_TIE,
        order=[preference.asc(), c("brier_score").asc(), c("log_loss").asc()],
    )


def _select(checked: DataFrame, key: str, baseline: str, best, value: Column, tie: float, order: list[Column]) -> DataFrame:
    """Among eligible rows within ``tie`` of the best, take the first in ``order``; else the baseline."""
    # one row per candidate
    everything = Window.partitionBy(F.lit(0))
    top = best(F.when(F.col("eligible"), value)).over(everything)
    near = F.col("eligible") & (F.abs(value - top) <= F.lit(tie))
    marked = checked.withColumn("_near", F.coalesce(near, F.lit(False)))
    place = F.row_number().over(everything.orderBy(F.col("_near").desc(), *order))
    any_near = F.max("_near").over(everything)
    return (
        marked.withColumn("_place", place).withColumn("_any", any_near)
        .withColumn("selected", F.when(F.col("_any"), F.col("_near") & (F.col("_place") == 1)).otherwise(F.col(key) == baseline))
        .drop("_near", "_place", "_any")
    )


def rank_models(table: DataFrame, key: str, metric: str = "pr_auc") -> DataFrame:
    """Models by metric (descending), name on ties."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(metric), F.asc(key))
    return table.withColumn("rank", F.row_number().over(order))


def best_per_metric(table: DataFrame, key: str, higher: Sequence[str], lower: Sequence[str] = ()) -> DataFrame:
    """The winning model of every metric."""
    names = [*higher, *lower]
    long = table.select(key, *[F.col(m).cast("double") for m in names]).unpivot([key], names, "metric", "value")
    sign = F.when(F.col("metric").isin(*lower), -1.0).otherwise(1.0) if lower else F.lit(1.0)
    order = Window.partitionBy("metric").orderBy(F.desc(sign * F.col("value")), F.asc(key))
    return long.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
