"""Tie-exact evaluation of binary scores.

Every metric is an aggregate over the score curve: one row per (keys, score) with running counts in
descending score order. Rows shrink to distinct scores before the global order is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrain.functions.scalars import capacity, finite, log_loss_term, ratio, risk_band
from riskgrain.operators.ranking import quantile_expr, running_sums
from riskgrain.schemas import ContractError

# Warning codes.
SINGLE_CLASS = "single_class_discrimination_undefined"
NO_POSITIVE = "no_positive_class"
NO_PREDICTED_POSITIVE = "no_predicted_positives"
UNDEFINED_F1 = "f1_undefined"

# Review capacities and risk-band shares.
STRATEGY_FRACTIONS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
HIGH_RISK_FRACTION = 0.10
MEDIUM_RISK_FRACTION = 0.30
DEFAULT_BINS = 10
DEFAULT_BANDS = 10


def score_violations(
    scored: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()
) -> DataFrame:
    """Counts of rows that break the score contract; ``keys`` also counts rows without a group."""
    y, s = F.col(label), F.col(score)
    ungrouped = [F.count_if(F.col(k).isNull()).alias(f"missing_{k}") for k in keys]
    return scored.agg(
        *ungrouped,
        F.count("*").alias("row_count"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_labels"),
        F.count_if(~finite(s)).alias("non_finite_scores"),
        F.count_if(finite(s) & ~s.between(0, 1)).alias("out_of_range_scores"),
    )


def check_scores(
    scored: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()
) -> None:
    """Run before any metric: the curve needs finite scores in [0, 1] and non-NULL keys."""
    r = score_violations(scored, label, score, keys).first()
    if not r["row_count"]:
        raise ContractError("no scores to evaluate")
    if any(v for name, v in r.asDict().items() if name != "row_count"):
        raise ContractError(f"score contract broken: {r.asDict()}")


def score_curve(
    scored: DataFrame,
    keys: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """Distinct scores with class counts and running counts in descending order."""
    keys = list(keys)
    by_score = scored.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(label).cast("bigint")).alias("pos"),
    )
    rows = by_score.withColumn("score_sum", F.col("score") * F.col("n"))
    run = running_sums(rows, "score", ["n", "pos", "score_sum"], keys, descending=True)
    return (
        run.withColumn("neg", F.col("n") - F.col("pos"))
        .withColumn("cum_neg", F.col("cum_n") - F.col("cum_pos"))
        .withColumn("tot_neg", F.col("tot_n") - F.col("tot_pos"))
    )


def _holds(k: Column) -> Column:
    """True on the one curve row whose tie group contains the k-th highest score."""
    return (F.col("cum_n") - F.col("n") < k) & (k <= F.col("cum_n"))


def _boundary(k: Column) -> list[Column]:
    """Cut-off, ties, weight and hits read off the boundary row."""
    weight = (k - (F.col("cum_n") - F.col("n"))) / F.col("n")
    return [
        F.col("score").alias("cutoff_score"),
        F.col("n").alias("boundary_tie_count"),
        weight.alias("boundary_selected_weight"),
        (F.col("cum_pos") - F.col("pos") + F.col("pos") * weight).alias("true_positive_weight"),
        (F.col("cum_score_sum") - F.col("score_sum") + F.col("score_sum") * weight).alias("selected_score_sum"),
    ]


def binary_metrics(
    curve: DataFrame,
    keys: Sequence[str] = (),
    threshold: float = 0.5,
    top_fraction: float | None = None,
    top_k: int | None = None,
) -> DataFrame:
    """All metrics of one score set per key, from one aggregate over the curve."""
    if not 0.0 <= threshold <= 1.0:
        raise ContractError("threshold must lie in [0, 1]")
    if top_k is not None and top_fraction is not None:
        raise ContractError("give top_fraction or top_k, not both")
    if top_k is not None and (isinstance(top_k, bool) or top_k < 1):
        raise ContractError("top_k must be a positive integer")
    k = F.lit(top_k).cast("bigint") if top_k is not None else capacity(F.col("tot_n"), top_fraction or 0.1)
    c = F.col
    p, n, total = c("tot_pos").cast("double"), c("tot_neg").cast("double"), c("tot_n").cast("double")
    pairs = c("pos") * ((n - c("cum_neg")) + c("neg") / 2.0)
    precision_here = c("cum_pos").cast("double") / c("cum_n")
    gap = ratio(c("cum_pos"), p) - ratio(c("cum_neg"), n)
    hit = c("score") >= F.lit(float(threshold))
    squared = c("pos") * F.pow(c("score") - 1.0, 2) + c("neg") * F.pow(c("score"), 2)
    agg = curve.groupBy(*keys).agg(
        F.max("tot_n").alias("sample_count"),
        F.max("tot_pos").alias("positive_count"),
        F.max("tot_neg").alias("negative_count"),
        F.sum(ratio(pairs, p * n)).alias("_auc"),
        F.sum(ratio(c("pos") * precision_here, p)).alias("_ap"),
        F.max(F.struct(gap.alias("gap"), c("score").alias("score"))).alias("_ks"),
        F.sum(squared / total).alias("brier_score"),
        F.sum(c("score_sum") / total).alias("mean_score"),
        F.coalesce(F.sum(F.when(hit, c("pos"))), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum(F.when(hit, c("neg"))), F.lit(0)).alias("false_positive"),
        F.max(k).alias("k"),
        F.max(F.when(_holds(k), F.struct(*_boundary(k)))).alias("_top"),
    )
    both = (c("positive_count") > 0) & (c("negative_count") > 0)
    fn = c("positive_count") - c("true_positive")
    chosen = c("true_positive") + c("false_positive")
    top_precision = c("_top.true_positive_weight") / c("k")
    warnings = F.array_compact(
        F.array(
            F.when(~both, SINGLE_CLASS),
            F.when(c("positive_count") == 0, NO_POSITIVE),
            F.when(chosen == 0, NO_PREDICTED_POSITIVE),
            F.when((chosen == 0) & (c("positive_count") == 0), UNDEFINED_F1),
        )
    )
    return agg.select(
        *keys,
        "sample_count",
        "positive_count",
        "negative_count",
        (c("positive_count") / c("sample_count")).alias("prevalence"),
        F.when(both, c("_auc")).alias("roc_auc"),
        F.when(both, c("_ap")).alias("pr_auc"),
        F.when(both, c("_ks.gap")).alias("ks"),
        F.when(both, c("_ks.score")).alias("ks_threshold"),
        F.when(both, 2.0 * c("_auc") - 1.0).alias("gini"),
        "brier_score",
        "mean_score",
        F.lit(float(threshold)).alias("threshold"),
        (c("negative_count") - c("false_positive")).alias("true_negative"),
        "false_positive",
        fn.alias("false_negative"),
        "true_positive",
        chosen.alias("predicted_positive_count"),
        ratio(c("true_positive"), c("positive_count")).alias("recall"),
        ratio(c("true_positive"), chosen).alias("precision"),
        ratio(2 * c("true_positive"), 2 * c("true_positive") + c("false_positive") + fn).alias("f1"),
        "k",
        (c("k") / c("sample_count")).alias("actual_fraction"),
        c("_top.cutoff_score").alias("cutoff_score"),
        c("_top.boundary_tie_count").alias("boundary_tie_count"),
        c("_top.boundary_selected_weight").alias("boundary_selected_weight"),
        c("_top.true_positive_weight").alias("true_positive_weight"),
        top_precision.alias("top_precision"),
        ratio(c("_top.true_positive_weight"), c("positive_count")).alias("top_recall"),
        ratio(top_precision, c("positive_count") / c("sample_count")).alias("top_lift"),
        F.array_join(warnings, ";").alias("warnings"),
    )


def evaluate(scored: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Metrics of each score set; a row that breaks the score contract, or has no group, fails the job that reads it."""
    label, score = options.pop("label", "label"), options.pop("score", "score")
    y, s = F.col(label), F.col(score)
    sound = y.isin(0, 1) & finite(s) & s.between(0, 1)
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    sound = F.coalesce(sound, F.lit(False))
    broken = F.raise_error(F.lit("score contract broken: labels are 0 or 1, scores in [0, 1], groups not NULL"))
    # on every column that is read, so that no filter can drop a bad row before it is seen
    checked = scored.withColumns(
        {c: F.when(sound, F.col(c)).otherwise(broken.cast(scored.schema[c].dataType)) for c in (label, score, *keys)}
    )
    return binary_metrics(score_curve(checked, keys, label, score), keys, **options)


def roc_pr_points(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC and PR coordinates at every distinct score."""
    c = F.col
    return curve.select(
        *keys,
        c("score").alias("threshold"),
        ratio(c("cum_neg"), c("tot_neg")).alias("false_positive_rate"),
        ratio(c("cum_pos"), c("tot_pos")).alias("true_positive_rate"),
        (c("cum_pos") / c("cum_n")).alias("precision"),
        ratio(c("cum_pos"), c("tot_pos")).alias("recall"),
    )


def _capacity_rows(curve: DataFrame, keys: Sequence[str], grid: Column, name: str) -> DataFrame:
    """One row per capacity: the grid entries whose k falls into a curve row's tie group."""
    hits = F.filter(grid, lambda g: _holds(g["k"]))
    return curve.withColumn("_g", F.explode(hits)).select(
        *keys,
        F.col(f"_g.{name}").alias(name),
        F.col("_g.k").alias("k"),
        "tot_n",
        "tot_pos",
        *_boundary(F.col("_g.k")),
    )


def topk_scenarios(
    curve: DataFrame, keys: Sequence[str] = (), fractions: Sequence[float] = STRATEGY_FRACTIONS
) -> DataFrame:
    """Capacity scenarios with hits, misses and increments over the previous capacity."""
    if not fractions or len(set(fractions)) != len(fractions):
        raise ContractError("fractions must be given once each")
    grid = F.array(
        *[
            F.struct(F.lit(float(f)).alias("review_fraction"), capacity(F.col("tot_n"), f).alias("k"))
            for f in sorted(fractions)
        ]
    )
    c = F.col
    rows = _capacity_rows(curve, keys, grid, "review_fraction")
    # at most one row per requested fraction and key
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("review_fraction")
    step_rows = c("k") - F.coalesce(F.lag("k").over(order), F.lit(0))
    step_hits = c("true_positive_weight") - F.coalesce(F.lag("true_positive_weight").over(order), F.lit(0.0))
    precision = c("true_positive_weight") / c("k")
    return rows.select(
        *keys,
        "review_fraction",
        c("k").alias("selected_count"),
        (c("k") / c("tot_n")).alias("actual_fraction"),
        "cutoff_score",
        "boundary_tie_count",
        "boundary_selected_weight",
        "true_positive_weight",
        precision.alias("precision"),
        ratio(c("true_positive_weight"), c("tot_pos")).alias("recall"),
        ratio(precision, c("tot_pos") / c("tot_n")).alias("lift"),
        (c("k") - c("true_positive_weight")).alias("false_positive_weight"),
        (c("tot_pos") - c("true_positive_weight")).alias("missed_positive_weight"),
        step_rows.alias("incremental_rows"),
        step_hits.alias("incremental_positive_weight"),
        ratio(step_hits, step_rows).alias("incremental_precision"),
    )


def risk_deciles(curve: DataFrame, keys: Sequence[str] = (), bands: int = DEFAULT_BANDS) -> DataFrame:
    """Bands as differences of cumulative fractional capacities; tied scores are shared evenly."""
    if bands < 2:
        raise ContractError("at least two bands are needed")
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("decile"),
                F.ceil((F.col("tot_n") * i).cast("double") / bands).alias("k"),
            )
            for i in range(1, bands + 1)
        ]
    )
    c = F.col
    rows = _capacity_rows(curve, keys, grid, "decile")
    # at most ``bands`` rows per key
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("decile")

    def step(name: str) -> Column:
        return c(name) - F.coalesce(F.lag(name).over(order), F.lit(0))

    top = curve.groupBy(*keys).agg(F.max("score").alias("_top"))
    rows = rows.join(top, list(keys)) if keys else rows.withColumn("_top", top.scalar())
    stepped = rows.select(
        *keys, "decile", "k", "tot_n", "tot_pos", "cutoff_score", "boundary_tie_count",
        "boundary_selected_weight", "true_positive_weight", "_top",
        step("k").alias("customer_count"),
        step("true_positive_weight").alias("positive_weight"),
        step("selected_score_sum").alias("_score"),
        F.lag("cutoff_score").over(order).alias("_previous"),
    )
    rate = ratio(c("positive_weight"), c("customer_count"))
    return stepped.select(
        *keys,
        "decile",
        "customer_count",
        (c("customer_count") / c("tot_n")).alias("population_fraction"),
        "positive_weight",
        (c("customer_count") - c("positive_weight")).alias("negative_weight"),
        F.coalesce(c("_previous"), c("_top")).alias("score_upper_bound"),
        c("cutoff_score").alias("score_lower_bound"),
        ratio(c("_score"), c("customer_count")).alias("mean_score"),
        rate.alias("observed_rate"),
        ratio(rate, c("tot_pos") / c("tot_n")).alias("lift"),
        c("k").alias("cumulative_count"),
        c("true_positive_weight").alias("cumulative_positive_weight"),
        ratio(c("true_positive_weight"), c("tot_pos")).alias("cumulative_recall"),
        "boundary_tie_count",
        "boundary_selected_weight",
    )


def calibration_bins(curve: DataFrame, keys: Sequence[str] = (), bins: int = DEFAULT_BINS) -> DataFrame:
    """Quantile bins of the scores that never split equal scores."""
    if bins < 2:
        raise ContractError("at least two bins are needed")
    keys = list(keys)
    c = F.col
    first, last = c("tot_n") - c("cum_n"), c("tot_n") - c("cum_n") + c("n") - 1
    step = 1.0 / bins
    probs = [min(1.0, i * step) for i in range(bins)] + [1.0]
    marks = curve.groupBy(*keys).agg(
        F.array_sort(
            F.array_distinct(F.array(*[quantile_expr(c("score"), first, last, c("tot_n"), p) for p in probs]))
        ).alias("_edges")
    )
    # one row of at most ``bins + 1`` edges per key
    placed = curve.join(marks, keys) if keys else curve.withColumn("_edges", marks.scalar())
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    binned = placed.withColumn("_bin", F.size(F.filter(inner, lambda e: e <= F.col("score"))))
    per = binned.groupBy(*keys, "_bin").agg(
        F.max("tot_n").alias("_total"),
        F.sum("n").alias("customer_count"),
        F.sum("pos").alias("positive_count"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.sum("score_sum").alias("_score"),
    )
    # at most ``bins`` rows per key
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bin")
    mean, rate = c("_score") / c("customer_count"), c("positive_count") / c("customer_count")
    return per.select(
        *keys,
        F.row_number().over(order).alias("bin"),
        "customer_count",
        "positive_count",
        "score_min",
        "score_max",
        mean.alias("mean_score"),
        rate.alias("observed_rate"),
        F.abs(rate - mean).alias("absolute_gap"),
        (c("customer_count") / c("_total")).alias("weight"),
    )


def calibration_summary(curve: DataFrame, keys: Sequence[str] = (), bins: int = DEFAULT_BINS) -> DataFrame:
    """Expected and maximum calibration error, bias and Brier per key."""
    keys = list(keys)
    c = F.col
    per = calibration_bins(curve, keys, bins).groupBy(*keys).agg(
        F.count("*").alias("effective_bins"),
        F.sum("customer_count").alias("sample_count"),
        (F.sum("positive_count") / F.sum("customer_count")).alias("prevalence"),
        F.sum(c("weight") * c("mean_score")).alias("mean_score"),
        F.sum(c("weight") * c("absolute_gap")).alias("expected_calibration_error"),
        F.max("absolute_gap").alias("maximum_calibration_error"),
    )
    squared = c("pos") * F.pow(c("score") - 1.0, 2) + c("neg") * F.pow(c("score"), 2)
    brier = curve.groupBy(*keys).agg(F.sum(squared / c("tot_n")).alias("brier_score"))
    whole = per.join(brier, keys) if keys else per.withColumn("brier_score", brier.scalar())
    return whole.withColumn("mean_probability_bias", c("mean_score") - c("prevalence"))


def log_loss(scored: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(log_loss_term(F.col(label), F.col(score))).alias("log_loss"))


def risk_bands(
    curve: DataFrame, high_fraction: float = HIGH_RISK_FRACTION, medium_fraction: float = MEDIUM_RISK_FRACTION
) -> DataFrame:
    """Three bands from the inclusive capacity cut-offs, with ordering checks on every row."""
    c = F.col
    cut = curve.agg(
        F.max(F.when(_holds(capacity(c("tot_n"), high_fraction)), c("score"))).alias("high"),
        F.max(F.when(_holds(capacity(c("tot_n"), medium_fraction)), c("score"))).alias("medium"),
    ).first()
    band = risk_band(c("score"), cut["medium"], cut["high"])
    per = curve.groupBy(band.alias("band")).agg(
        F.max("tot_n").alias("_n"),
        F.max("tot_pos").alias("_p"),
        F.sum("n").alias("row_count"),
        F.sum("pos").alias("positive_count"),
        F.sum("score_sum").alias("_s"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
    )
    per = per.select(
        "*",
        (c("_s") / c("row_count")).alias("mean_score"),
        (c("positive_count") / c("row_count")).alias("observed_rate"),
    )
    # three rows
    everything = Window.partitionBy(F.lit(0))

    def of(name: str, key: str) -> Column:
        return F.max(F.when(c("band") == key, c(name))).over(everything)

    def descends(name: str) -> Column:
        return (of(name, "high") > of(name, "medium")) & (of(name, "medium") > of(name, "low"))

    return per.select(
        "band",
        "row_count",
        (c("row_count") / c("_n")).alias("population_fraction"),
        "positive_count",
        ratio(c("positive_count"), c("_p")).alias("positive_share"),
        "mean_score",
        "observed_rate",
        (c("mean_score") - c("observed_rate")).alias("calibration_gap"),
        ratio(c("observed_rate"), c("_p") / c("_n")).alias("lift"),
        "score_min",
        "score_max",
        F.lit(cut["high"]).alias("high_cutoff"),
        F.lit(cut["medium"]).alias("medium_cutoff"),
        descends("observed_rate").alias("observed_descends"),
        descends("mean_score").alias("score_descends"),
        ratio(of("observed_rate", "high"), of("observed_rate", "low")).alias("high_low_ratio"),
    )


def replay_differences(
    current: DataFrame, recorded: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-6
) -> DataFrame:
    """Metric rows whose recomputed value is missing or differs from the recorded one."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(m).cast("double") for m in metrics]).unpivot(
            list(keys), list(metrics), "metric", name
        )

    on = [*keys, "metric"]
    both = long(current, "actual").join(long(recorded, "expected"), on, "full_outer")
    close = F.abs(F.col("actual") - F.col("expected")) <= tolerance
    return both.where(~F.coalesce(close, F.col("actual").isNull() & F.col("expected").isNull()))
