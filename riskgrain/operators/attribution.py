"""Attribution analytics on a long table: one row per scored row and feature."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrain.functions.scalars import capacity, ratio
from riskgrain.operators.metrics import score_curve
from riskgrain.operators.profiling import spearman
from riskgrain.operators.ranking import order_statistic, quantile_columns, ranked_values
from riskgrain.schemas import ContractError, source_group
from riskgrain.session import small_table

# List lengths and the direction band.
DIRECTION_BAND = 0.1
LOW_SHARE, HIGH_SHARE = 0.2, 0.8
ADDITIVITY_TOLERANCE = 1e-5
ROLL_UP_TOLERANCE = 1e-10


def linear_attribution(
    rows: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float], key: str = "id", values: bool = False
) -> DataFrame:
    """``coefficient * (value - mean)`` per row and feature; a missing value stands at the mean.

    ``values`` puts the feature's value beside its attribution, which spares a join of two tables of this length.
    """
    cells = []
    for f, b in coefficients.items():
        value = F.col(f).cast("double")
        part = F.coalesce((value - F.lit(float(means[f]))) * F.lit(float(b)), F.lit(0.0))
        cells.append(F.struct(F.lit(f).alias("feature"), value.alias("value"), part.alias("attribution")))
    long = rows.select(key, F.inline(F.array(*cells)))
    return long if values else long.drop("value")


def model_attribution(design: DataFrame, model, names: Sequence[str], train_design: DataFrame, key: str) -> tuple[DataFrame, float]:
    """Exact attribution of a fitted logistic model in log-odds, and its base value."""
    mean = train_design.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    beta = model.coefficients.toArray()
    base = float(model.intercept) + float(beta @ mean)
    cells = F.zip_with(
        vector_to_array("features"),
        F.array(*[F.struct(F.lit(float(b)).alias("b"), F.lit(float(m)).alias("m"), F.lit(n).alias("f")) for b, m, n in zip(beta, mean, names, strict=True)]),
        lambda x, s: F.struct(s["f"].alias("feature"), (s["b"] * (x - s["m"])).alias("attribution")),
    )
    return design.select(key, F.inline(cells)), base


def slot_table(spark, slots: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Transformed slot -> source feature, kind and source group (one row per vector slot)."""
    rows = [(n, s, k, source_group(s)) for n, s, k in slots]
    return small_table(spark, rows, "feature string, source_feature string, component_kind string, source_group string")


def map_slot(name: str, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[str, str]:
    """Source feature and component kind of a slot name; the longest categorical name wins."""
    indicator, number, category = "numeric__missingindicator_", "numeric__", "categorical__"
    if name.startswith(indicator):
        source, kind, known = name[len(indicator):], "missing_indicator", numeric
    elif name.startswith(number):
        source, kind, known = name[len(number):], "numeric_value", numeric
    elif name.startswith(category):
        rest = name[len(category):]
        fits = [c for c in categorical if rest.startswith(f"{c}_")]
        source, kind, known = max(fits, key=len, default=rest), "category_level", categorical
    else:
        raise ContractError(f"unknown slot {name}")
    if source not in known:
        raise ContractError(f"unknown slot {name}")
    return source, kind


def roll_up(attributions: DataFrame, slots: DataFrame, key: str = "id") -> DataFrame:
    """Sum slot attributions into source features."""
    joined = attributions.join(slots.select("feature", "source_feature"), "feature")
    return joined.groupBy(key, F.col("source_feature").alias("feature")).agg(F.sum("attribution").alias("attribution"))


def roll_up_gap(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Largest change of a row's total caused by the roll-up."""
    a = before.groupBy(key).agg(F.sum("attribution").alias("_a"))
    b = after.groupBy(key).agg(F.sum("attribution").alias("_b"))
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return a.join(b, key, "full_outer").agg(F.max(gap).alias("largest_gap"))


def importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute and signed attribution, share and rank per feature."""
    per = attributions.groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs"), F.avg("attribution").alias("mean_signed")
    )
    return _ranked_importance(per)


def _ranked_importance(per: DataFrame) -> DataFrame:
    # one row per feature
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs"), F.asc("feature"))
    whole = Window.partitionBy(F.lit(0))
    return per.select(
        "feature", "mean_abs", "mean_signed",
        ratio(F.col("mean_abs"), F.sum("mean_abs").over(whole)).alias("share"),
        F.row_number().over(order).alias("rank"),
    )


def slot_means(long: DataFrame, rows: int) -> DataFrame:
    """(slot, mean) over ``rows`` rows of a design in long form; rows without a slot's entry hold 0 there."""
    return long.groupBy("slot").agg((F.sum("value") / F.lit(float(rows))).alias("mean"))


def slot_importance(long: DataFrame, weights: DataFrame, rows: int) -> DataFrame:
    """Importance of every slot of a linear model from the non-zero entries (slot, value) of ``rows`` rows.

    ``weights``: slot, coefficient, mean, one row per slot. A row without an entry holds 0, whose attribution is the
    same for all such rows, so only their number counts.
    """
    c = F.col
    part = c("coefficient") * (c("value") - c("mean"))
    seen = long.join(F.broadcast(weights), "slot").groupBy("slot").agg(
        F.count("*").alias("_n"), F.sum(F.abs(part)).alias("_abs"), F.sum(part).alias("_sum"))
    zero = -c("coefficient") * c("mean")
    absent = F.lit(float(rows)) - F.coalesce(c("_n"), F.lit(0))
    per = weights.join(seen, "slot", "left").select(
        c("slot").alias("feature"), ((F.coalesce(c("_abs"), F.lit(0.0)) + absent * F.abs(zero)) / F.lit(float(rows))).alias("mean_abs"),
        ((F.coalesce(c("_sum"), F.lit(0.0)) + absent * zero) / F.lit(float(rows))).alias("mean_signed"))
    return _ranked_importance(per)


def group_importance(attributions: DataFrame, groups: DataFrame) -> DataFrame:
    """Importance summed by source group. ``groups``: feature, source_group."""
    per = importance(attributions).join(groups.select("feature", "source_group"), "feature")
    return per.groupBy("source_group").agg(
        F.count("*").alias("feature_count"), F.sum("mean_abs").alias("summed_mean_abs"), F.sum("share").alias("share")
    )


def direction(values: DataFrame) -> DataFrame:
    """Whether higher values raise the score. ``values``: feature, value, attribution (long)."""
    known = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    seen = values.groupBy("feature").agg(
        F.count("value").alias("observed_rows"), F.count_if(F.col("value").isNull()).alias("missing_rows")
    )
    marks = ranked_values(known, "value", ["feature"]).groupBy("feature").agg(
        *quantile_columns("value", {"_low": LOW_SHARE, "_high": HIGH_SHARE}), F.count("*").alias("_distinct")
    )
    # one row per feature
    low, high = F.col("value") <= F.col("_low"), F.col("value") >= F.col("_high")
    edge = known.join(F.broadcast(marks), "feature").groupBy("feature").agg(
        (F.avg(F.when(high, F.col("attribution"))) - F.avg(F.when(low, F.col("attribution")))).alias("_gap"),
        F.max("_distinct").alias("_distinct"),
    )
    rho = spearman(known, "value", "attribution", ["feature"]).select("feature", "spearman")
    enough = (F.col("observed_rows") >= 3) & (F.col("_distinct") >= 2)
    r = F.when(enough, F.col("spearman"))
    return (
        seen.join(edge, "feature", "left").join(rho, "feature", "left").select(
            "feature", "observed_rows", "missing_rows", r.alias("spearman"),
            F.when(enough, F.col("_gap")).alias("top_minus_bottom"),
            F.when(~F.coalesce(enough, F.lit(False)), "insufficient_variation")
            .when(r >= DIRECTION_BAND, "higher_values_tend_to_raise_risk_score")
            .when(r <= -DIRECTION_BAND, "higher_values_tend_to_lower_risk_score")
            .otherwise("weak_or_non_monotonic_relationship").alias("direction"),
        )
    )


def exact_top_k(scored: DataFrame, fraction: float, key: str = "id") -> DataFrame:
    """Mark exactly K = max(1, ceil(n * fraction)) rows; ties at the cut-off go to lower ids.

    The cut-off comes from the score curve and the last tied id from an order statistic over the
    tied ids, so the mark itself is a row-local condition.
    """
    curve = score_curve(scored)
    k = capacity(F.col("tot_n"), fraction)
    edge = (F.col("cum_n") - F.col("n") < k) & (k <= F.col("cum_n"))
    cut = curve.where(edge).select(
        k.alias("k"), "score", "n", (k - (F.col("cum_n") - F.col("n"))).alias("take")
    ).first()
    s = F.col("score")
    picked = s > F.lit(cut["score"])
    if cut["take"] == cut["n"]:
        picked = s >= F.lit(cut["score"])
    else:
        last = order_statistic(scored.where(s == F.lit(cut["score"])), key, int(cut["take"]))
        picked = picked | ((s == F.lit(cut["score"])) & (F.col(key) <= F.lit(last)))
    return scored.withColumn("reviewed", picked).withColumn("cutoff_score", F.lit(cut["score"]))


def error_groups(scored: DataFrame, fraction: float = 0.1, key: str = "id") -> DataFrame:
    """Exact-K review outcome per row."""
    marked = exact_top_k(scored, fraction, key)
    hit, positive = F.col("reviewed"), F.col("label") == 1
    return marked.withColumn(
        "error_group",
        F.when(hit & positive, "captured_positive").when(~hit & positive, "missed_positive")
        .when(hit, "reviewed_negative").otherwise("not_reviewed_negative"),
    )


def error_group_summary(grouped: DataFrame) -> DataFrame:
    """Size, mean and exact median score per outcome."""
    basic = grouped.groupBy("error_group").agg(F.count("*").alias("row_count"), F.avg("score").alias("mean_score"))
    medians = ranked_values(grouped, "score", ["error_group"]).groupBy("error_group").agg(
        *quantile_columns("score", {"median_score": 0.5})
    )
    return basic.join(medians, "error_group")


def _first(ranked: DataFrame, top: int | None) -> DataFrame:
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def error_group_features(grouped: DataFrame, attributions: DataFrame, key: str = "id", top: int | None = None) -> DataFrame:
    """Features per outcome, the strongest first; ``top`` keeps the first ranks."""
    per = attributions.join(grouped.select(key, "error_group"), key).groupBy("error_group", "feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs"), F.avg("attribution").alias("mean_signed")
    )
    order = Window.partitionBy("error_group").orderBy(F.desc("mean_abs"), F.asc("feature"))
    return _first(per.withColumn("rank", F.row_number().over(order)), top)


def captured_minus_missed(grouped: DataFrame, attributions: DataFrame, key: str = "id", top: int | None = None) -> DataFrame:
    """Mean attribution of captured minus missed positives, ranked by size."""
    g, a = F.col("error_group"), F.col("attribution")
    positives = grouped.where(g.isin("captured_positive", "missed_positive")).select(key, "error_group")
    per = attributions.join(positives, key).groupBy("feature").agg(
        F.avg(F.when(g == "captured_positive", a)).alias("captured_mean"),
        F.avg(F.when(g == "missed_positive", a)).alias("missed_mean"),
    ).withColumn("difference", F.col("captured_mean") - F.col("missed_mean"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("difference")), F.asc("feature"))
    return _first(per.withColumn("rank", F.row_number().over(order)), top)


def representative_rows(grouped: DataFrame, key: str = "id") -> DataFrame:
    """One row per outcome: the highest score, or the lowest among unreviewed negatives."""
    low = F.col("error_group") == "not_reviewed_negative"
    side = F.when(low, F.col("score")).otherwise(-F.col("score"))
    pick = F.min(F.struct(side.alias("s"), F.col(key).alias("k"), F.col("score"), F.col("label"))).alias("_p")
    return grouped.groupBy("error_group").agg(pick, F.max("cutoff_score").alias("cutoff_score")).select(
        "error_group", F.col("_p.k").alias(key), F.col("_p.label").alias("label"), F.col("_p.score").alias("score"), "cutoff_score"
    )


def representative_cases(
    grouped: DataFrame, attributions: DataFrame, base: float, key: str = "id", top: int | None = None
) -> DataFrame:
    """Ranked contributions of each representative row; the row id does not leave this function.

    A ``value`` column of the attributions is shown as the feature's own value; ``top`` keeps the first ranks.
    """
    # four rows
    chosen = F.broadcast(representative_rows(grouped, key))
    rows = attributions.join(chosen, key)
    shown = []
    if "value" in attributions.columns:
        shown = [F.col("value").alias("feature_value")]
    per = Window.partitionBy("error_group")
    order = per.orderBy(F.desc(F.abs("attribution")), F.asc("feature"))
    ranked = rows.withColumn("reconstructed_log_odds", F.lit(float(base)) + F.sum("attribution").over(per)).withColumn("rank", F.row_number().over(order))
    return _first(ranked, top).select(
        "error_group", "label", "score", "cutoff_score", "reconstructed_log_odds", "rank", "feature", *shown, "attribution",
        F.when(F.col("attribution") > 0, "raises_risk_score").otherwise("lowers_risk_score").alias("effect"),
    )


def additivity(attributions: DataFrame, raw_scores: DataFrame, base: float, key: str = "id") -> DataFrame:
    """Largest distance between base + attributions and the raw score in log-odds."""
    sums = attributions.groupBy(key).agg(F.sum("attribution").alias("_s"))
    gap = F.abs(F.lit(float(base)) + F.col("_s") - F.col("raw_score"))
    return sums.join(raw_scores.select(key, "raw_score"), key).agg(
        F.max(gap).alias("largest_gap"), (F.max(gap) <= ADDITIVITY_TOLERANCE).alias("holds")
    )
