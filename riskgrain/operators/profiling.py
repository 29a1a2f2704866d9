"""Train-only profiles and relations to the label, from value counts of long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.functions.scalars import clean_label, finite, ratio, ratio_or_zero
from riskgrain.operators.quality import level_counts
from riskgrain.operators.ranking import moment_columns, quantile_columns, ranked_values, summed_values, tie_ranks
from riskgrain.schemas import EMPLOYED_SENTINEL, TARGET, feature_family
from riskgrain.session import small_table

# Probabilities and limits of the profile.
SUMMARY_PROBS = {"p1": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}
IQR_FACTOR = 1.5
HIGH_CORRELATION = 0.95
NEAR_CONSTANT_SHARE = 0.99
HIGH_MISSING_SHARE = 0.40
RARE_SHARE = 0.001

OTHER_LEVEL = "[rare levels]"
MISSING_LEVEL = "[missing]"


def train_rows(table: DataFrame, assignments: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """Rows of the training part only, before anything is measured."""
    ids = assignments.where(F.col("SPLIT") == "train").select(key)
    return table.join(ids, key, "left_semi")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in skip
    ]


def long_numbers(df: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(carry..., column_name, value) with every value a double and NaN turned into NULL."""
    cast = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    return df.select(*carry, *cast).unpivot(list(carry), list(columns), "column_name", "value")


def numeric_summary(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float] = SUMMARY_PROBS) -> DataFrame:
    """Count, missing, unique, moments, exact quantiles, modal share and zero count per column, from counted values."""
    values = summed_values(long_numbers(df, columns), "value", ["column_name"])
    return values.groupBy("column_name").agg(*moment_columns("value"), *quantile_columns("value", dict(probs)))


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside the quartile fences, for columns with more than two distinct values."""
    ranked = ranked_values(long_numbers(df, columns), "value", ["column_name"])
    fences = ranked.groupBy("column_name").agg(
        *quantile_columns("value", {"q1": 0.25, "q3": 0.75}),
        F.count("*").alias("unique_count"),
        F.max("tot_n").alias("observed_count"),
    ).where(F.col("unique_count") > 2)
    spread = F.col("q3") - F.col("q1")
    fences = fences.withColumn("lower_bound", F.col("q1") - IQR_FACTOR * spread).withColumn(
        "upper_bound", F.col("q3") + IQR_FACTOR * spread
    )
    out = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    # one row per column
    hits = ranked.join(F.broadcast(fences), "column_name").groupBy("column_name").agg(
        F.first("lower_bound").alias("lower_bound"),
        F.first("upper_bound").alias("upper_bound"),
        F.first("observed_count").alias("observed_count"),
        F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("outlier_count"),
    )
    return hits.withColumn("outlier_rate", ratio_or_zero(F.col("outlier_count"), F.col("observed_count")))


def missingness(df: DataFrame) -> DataFrame:
    """Missing count and rate per column, ranked by (rate desc, column asc)."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).alias("missing_count"),
            ratio_or_zero(F.col(c), F.col("_n")).alias("missing_rate"),
        )
        for c in df.columns
    ]
    long = one.select(F.inline(F.array(*cells)))
    # one row per column of the table
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("missing_rate"), F.asc("column_name"))
    return long.withColumn("rank", F.row_number().over(order))


def high_missing(df: DataFrame, share: float = HIGH_MISSING_SHARE) -> DataFrame:
    """Columns of which at least ``share`` of the rows is missing."""
    return missingness(df).where(F.col("missing_rate") >= share).drop("rank")


def categorical_summary(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Ranked levels per column with NULL kept as a level, plus missing and distinct counts; ``top`` keeps the first."""
    counts = level_counts(df, columns)
    per = counts.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
    )
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(per, "column_name").select(
        "column_name", "rank", clean_label(F.col("value")).alias("value_label"), "n",
        ratio_or_zero(F.col("n"), F.col("row_count")).alias("rate"), "missing_count", "unique_count",
    )


# ---------------------------------------------------------------------------
# correlation
# ---------------------------------------------------------------------------
#: A variance below this share of the second moment about the centre is rounding: the column is constant there.
_FLAT = 1e-12
_GRAM_SCHEMA = (
    "left_column string, right_column string, n double, sx double, sy double, sxx double, syy double, sxy double"
)


def _gram_batches(columns: list[str], centers: dict[str, float]):
    """Per-partition pairwise-complete moments by matrix products over Arrow batches."""
    shift = np.array([centers[c] for c in columns])
    upper = np.triu_indices(len(columns), 1)

    def run(batches):
        total = None
        for frame in batches:
            x = frame[columns].to_numpy(dtype="float64", na_value=np.nan) - shift
            seen = np.isfinite(x).astype("float64")
            x = np.where(seen > 0, x, 0.0)
            square = x * x
            part = [seen.T @ seen, x.T @ seen, seen.T @ x, square.T @ seen, seen.T @ square, x.T @ x]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pd.DataFrame(
                {
                    "left_column": [columns[i] for i in upper[0]],
                    "right_column": [columns[j] for j in upper[1]],
                    **dict(zip(("n", "sx", "sy", "sxx", "syy", "sxy"), [m[upper] for m in total])),
                }
            )

    return run


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair, over all rows.

    Matrix products inside each partition (one partial row per pair and partition), then a sum per pair. NaN and
    infinite values count as missing; a pair in which a column is constant where both are observed has no correlation
    and no row.
    """
    columns = list(columns)
    cast = {c: F.col(c).cast("double") for c in columns}
    numbers = df.select(*[F.when(finite(v), v).alias(c) for c, v in cast.items()])
    means = numbers.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centers = {c: float(means[c] or 0.0) for c in columns}
    moments = numbers.mapInPandas(_gram_batches(columns, centers), _GRAM_SCHEMA)
    s = moments.groupBy("left_column", "right_column").agg(
        *[F.sum(m).alias(m) for m in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    c = F.col
    cov = c("sxy") - c("sx") * c("sy") / c("n")
    var_x, var_y = (c(f"s{v}{v}") - c(f"s{v}") * c(f"s{v}") / c("n") for v in "xy")
    varied = (var_x > F.lit(_FLAT) * c("sxx")) & (var_y > F.lit(_FLAT) * c("syy"))
    long = s.where(c("n") > 1).select(
        "left_column", "right_column", F.when(varied, cov / (F.sqrt(var_x) * F.sqrt(var_y))).alias("correlation")
    )
    known = F.col("correlation").isNotNull() & ~F.isnan("correlation")
    return long.where(known).withColumn("absolute_correlation", F.abs("correlation")).withColumn(
        "high", F.abs("correlation") >= HIGH_CORRELATION
    )


def spearman(pairs: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with shared ranks for ties, from counted (x, y) pairs.

    Rows collapse to distinct pairs first, so a pair repeated in a third of all rows is one row. Each rank is carried by
    the pairs in the order of its values; nothing is joined on a value, so one that many pairs share makes no hot task.
    """
    keys = list(keys)
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counted = both.groupBy(*keys, x, y).agg(F.count("*").alias("_n"))
    ranked = tie_ranks(tie_ranks(counted, x, y, "_n", keys, "_rx"), y, x, "_n", keys, "_ry")
    n, middle = F.col("_n"), (F.col("_rx_of") + 1) / 2.0
    dx, dy = F.col("_rx") - middle, F.col("_ry") - middle
    sums = ranked.groupBy(*keys).agg(
        F.sum(n).alias("observed_rows"),
        F.sum(n * dx * dy).alias("_xy"), F.sum(n * dx * dx).alias("_xx"), F.sum(n * dy * dy).alias("_yy"),
    )
    scale = F.sqrt(F.col("_xx") * F.col("_yy"))
    return sums.select(*keys, "observed_rows", ratio(F.col("_xy"), scale).alias("spearman"))


# ---------------------------------------------------------------------------
# relations to the label
# ---------------------------------------------------------------------------
def target_numeric(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """Mean and median by class and the point-biserial correlation per column, from values counted by class."""
    long = long_numbers(df, columns, [target]).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    per = summed_values(long, "value", ["column_name", target]).groupBy("column_name", target).agg(
        *moment_columns("value"), *quantile_columns("value", {"median": 0.5}))
    c, y = F.col, F.col(target)
    of = lambda t, x: F.max(F.when(y == t, x))
    square = F.coalesce(F.pow(c("std"), 2) * (c("observed_count") - 1), F.lit(0.0))
    wide = per.groupBy("column_name").agg(
        *[F.coalesce(of(t, c("observed_count")), F.lit(0)).alias(f"count_{t}") for t in (0, 1)],
        *[of(t, c(m)).alias(f"{m}_{t}") for m in ("mean", "median") for t in (0, 1)],
        F.sum(square).alias("_within"), F.min("min").alias("_lo"), F.max("max").alias("_hi"),
    )
    # sums of squares of two classes: within each, and between their means
    gap, n0, n1 = c("mean_1") - c("mean_0"), c("count_0").cast("double"), c("count_1").cast("double")
    between = n0 * n1 / F.nullif(n0 + n1, F.lit(0.0))
    varied = (c("count_0") > 0) & (c("count_1") > 0) & (c("_lo") != c("_hi"))
    return wide.select(
        "column_name", "count_0", "count_1", "mean_0", "mean_1", "median_0", "median_1",
        F.when(varied, gap * F.sqrt(between) / F.nullif(F.sqrt(c("_within") + between * gap * gap), F.lit(0.0))).alias("point_biserial"),
    )


def target_missingness(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """Label rate where a column is missing against where it is observed; ``supported`` if both sides have enough rows."""
    flags = df.select(F.col(target).alias("_y"), *[F.col(c).isNull().alias(c) for c in columns])
    long = flags.unpivot(["_y"], list(columns), "column_name", "gone")
    gone, y = F.col("gone"), F.col("_y").cast("double")
    per = long.groupBy("column_name").agg(
        F.count_if(gone).alias("missing_count"),
        F.count_if(~gone).alias("observed_count"),
        F.avg(F.when(gone, y)).alias("rate_missing"),
        F.avg(F.when(~gone, y)).alias("rate_observed"),
    )
    support = F.greatest(F.lit(20), F.ceil((F.col("missing_count") + F.col("observed_count")) * F.lit(RARE_SHARE)))
    return per.withColumn("rate_difference", F.col("rate_missing") - F.col("rate_observed")).withColumn(
        "supported", F.least("missing_count", "observed_count") >= support
    )


def target_category(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """Label rate per level, NULL a level of its own, thin levels pooled; ``supported`` if a level has enough rows."""
    counts = level_counts(df, columns, {"positives": F.col(target).cast("bigint")})
    totals = df.agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
    support = F.greatest(F.lit(20), F.ceil(totals.select("n").scalar() * F.lit(RARE_SHARE)))
    level = F.coalesce("value", F.lit(MISSING_LEVEL))
    pooled = counts.groupBy(
        "column_name", F.when(F.col("n") < support, F.lit(OTHER_LEVEL)).otherwise(level).alias("level")
    ).agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    rate = F.col("positives") / F.col("n")
    return pooled.select(
        "column_name", "level", "n", rate.alias("target_rate"),
        (rate - totals.select("rate").scalar()).alias("rate_difference"), (F.col("n") >= support).alias("supported"),
    )


def near_constant(df: DataFrame, columns: Sequence[str], share: float = NEAR_CONSTANT_SHARE) -> DataFrame:
    """Columns whose most frequent value (NULL included) covers almost all rows."""
    counts = level_counts(df, columns)
    per = counts.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.max(F.struct("n", "value")).alias("_top"),
    )
    rate = F.col("_top.n") / F.col("row_count")
    return per.where(rate >= share).select(
        "column_name", clean_label(F.col("_top.value")).alias("dominant_value"),
        F.col("_top.n").alias("n"), rate.alias("rate"),
    )


def rare_categories(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Levels held by at most max(2, 0.1 %) rows; ``limit`` keeps the rarest."""
    counts = level_counts(df, columns).where(F.col("value").isNotNull())
    n = df.agg(F.count("*").alias("n")).scalar()
    most = F.greatest(F.lit(2), F.ceil(n * F.lit(RARE_SHARE)))
    rare = counts.where(F.col("n") <= most)
    out = rare.select("column_name", clean_label(F.col("value")).alias("value_label"), "n", ratio_or_zero(F.col("n"), n).alias("rate"))
    return out.orderBy("n", "column_name", "value_label").limit(limit) if limit is not None else out


def known_values(df: DataFrame) -> DataFrame:
    """Known oddities of the applicant table with their rates."""
    n = F.count("*")
    owner = F.col("FLAG_OWN_CAR") == "Y"
    seen = {
        "DAYS_EMPLOYED_SENTINEL": (F.count_if(F.col("DAYS_EMPLOYED") == EMPLOYED_SENTINEL), n),
        "CODE_GENDER_XNA": (F.count_if(F.col("CODE_GENDER") == "XNA"), n),
        "NAME_FAMILY_STATUS_Unknown": (F.count_if(F.col("NAME_FAMILY_STATUS") == "Unknown"), n),
        "OWN_CAR_AGE_MISSING_AMONG_OWNERS": (F.count_if(owner & F.col("OWN_CAR_AGE").isNull()), F.count_if(owner)),
    }
    one = df.agg(*[a.alias(f"{k}_c") for k, (a, _) in seen.items()], *[b.alias(f"{k}_n") for k, (_, b) in seen.items()])
    cells = [
        F.struct(
            F.lit(k).alias("observation"), F.col(f"{k}_c").alias("n"), F.col(f"{k}_n").alias("base"),
            ratio_or_zero(F.col(f"{k}_c"), F.col(f"{k}_n")).alias("rate"),
        )
        for k in seen
    ]
    return one.select(F.inline(F.array(*cells)))


# ---------------------------------------------------------------------------
# derived-feature profile
# ---------------------------------------------------------------------------
def feature_profile(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Profile of derived features: family, coverage, quantiles, modal share, candidates."""
    probs = {k: SUMMARY_PROBS[k] for k in ("p1", "q1", "median", "q3", "p99")}
    families = small_table(
        train.sparkSession, [(f, feature_family(f)) for f in features], "column_name string, family string"
    )
    c = F.col
    per = numeric_summary(train, features, probs).join(families, "column_name")
    skewed = (
        (c("unique_count") > 2) & (c("min") >= 0) & (c("p99") > F.greatest(F.lit(1.0), c("median") * 10))
    )
    return per.select(
        "column_name", "family", "observed_count", "missing_count",
        ratio_or_zero(c("missing_count"), c("row_count")).alias("missing_rate"),
        "unique_count", "zero_count",
        ratio_or_zero(c("zero_count"), c("observed_count")).alias("zero_rate"),
        ratio_or_zero(c("modal_count"), c("observed_count")).alias("modal_rate"),
        "mean", "std", "min", "p1", "q1", "median", "q3", "p99", "max",
        (c("missing_count") > 0).alias("missing_indicator_candidate"),
        F.coalesce(skewed, F.lit(False)).alias("log1p_candidate"),
    )


def feature_by_target(train: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """Rows, coverage, mean and median of each feature per class, from values counted by class."""
    per = summed_values(long_numbers(train, features, [target]), "value", ["column_name", target]).groupBy("column_name", target).agg(
        *moment_columns("value"), *quantile_columns("value", {"median": 0.5}))
    rate = ratio_or_zero(F.col("missing_count"), F.col("row_count"))
    return per.select("column_name", target, "row_count", "observed_count", rate.alias("missing_rate"), "mean", "median")


def smd_ranking(train: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """Standardised mean difference between the classes, ranked by size."""
    long = long_numbers(train, features, [target]).where(F.col("value").isNotNull())
    y = F.col(target)
    per = long.groupBy("column_name").agg(
        *[F.avg(F.when(y == t, F.col("value"))).alias(f"_m{t}") for t in (0, 1)],
        F.stddev_samp("value").alias("_sd"),
    )
    smd = F.when(F.col("_sd") > 0, (F.col("_m1") - F.col("_m0")) / F.col("_sd"))
    scored = per.select("column_name", smd.alias("smd")).where(F.col("smd").isNotNull())
    # one row per feature; noise below 1e-12 must not break ties
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.abs("smd"), 12)), F.asc("column_name"))
    return scored.withColumn("rank", F.row_number().over(order))
