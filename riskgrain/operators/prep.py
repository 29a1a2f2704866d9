"""Leakage-safe preprocessing: every statistic comes from an explicit training frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.operators.profiling import long_numbers
from riskgrain.operators.quality import level_counts
from riskgrain.operators.ranking import quantile_columns, ranked_values
from riskgrain.schemas import ContractError, FeatureRoles, require_columns
from riskgrain.session import cut_lineage

# Tokens and share limit of the category rules.
MISSING_LEVEL = "__MISSING__"
RARE_LEVEL = "__RARE__"
RARE_SHARE = 0.001
CAR_AGE, CAR_NOT_APPLICABLE, CAR_MISSING = "OWN_CAR_AGE", "OWN_CAR_AGE_NOT_APPLICABLE", "OWN_CAR_AGE_MISSING"


@dataclass(frozen=True)
class FittedPrep:
    """Statistics of one training frame. Sizes grow with columns and kept levels, not with rows."""

    roles: FeatureRoles
    family: str
    car_fill: float
    medians: dict[str, float]
    indicators: tuple[str, ...]
    scales: dict[str, float]
    kept: dict[str, tuple[str, ...]]
    rare: DataFrame
    rare_count: dict[str, int]

    def restricted(self, roles: FeatureRoles) -> FittedPrep:
        """What fitting the same frame on a part of the features would give; every statistic is per column."""
        missing = set(roles.features) - set(self.roles.features)
        if missing:
            raise ContractError(f"features: {sorted(missing)} were not fitted")
        only = lambda d, names: {c: d[c] for c in names}
        return replace(
            self, roles=roles, medians=only(self.medians, roles.numeric),
            indicators=tuple(c for c in roles.numeric if c in self.indicators), scales=only(self.scales, roles.numeric),
            kept=only(self.kept, roles.categorical), rare_count=only(self.rare_count, roles.categorical),
        )

    @property
    def output_names(self) -> list[str]:
        """Names of the assembled vector's slots, in order."""
        return (
            [f"numeric__{c}" for c in self.roles.numeric]
            + [f"numeric__missingindicator_{c}" for c in self.indicators]
            + [f"categorical__{c}_{level}" for c in self.roles.categorical for level in self.kept[c]]
        )

    @property
    def slot_sources(self) -> list[tuple[str, str, str]]:
        """(slot name, source feature, component kind) for every vector slot."""
        kinds = (
            [(c, "numeric_value") for c in self.roles.numeric]
            + [(c, "missing_indicator") for c in self.indicators]
            + [(c, "category_level") for c in self.roles.categorical for _ in self.kept[c]]
        )
        return [(n, c, k) for n, (c, k) in zip(self.output_names, kinds, strict=True)]


def has_car_rule(df: DataFrame) -> bool:
    present = {CAR_AGE, CAR_NOT_APPLICABLE, CAR_MISSING} & set(df.columns)
    if present and len(present) < 3:
        raise ContractError("car age needs both of its flags")
    return bool(present)


#: Violated if the car age and its two flags contradict each other: the flags are 0 or 1 and not both 1, and the age
#: is there exactly if both are 0.
CAR_CONFLICT = (
    f"NOT coalesce({CAR_NOT_APPLICABLE} IN (0, 1) AND {CAR_MISSING} IN (0, 1), false)"
    f" OR {CAR_NOT_APPLICABLE} + {CAR_MISSING} > 1 OR ({CAR_NOT_APPLICABLE} + {CAR_MISSING} = 0) <> ({CAR_AGE} IS NOT NULL)"
)


def car_conflict():
    """Row predicate: the car age and its two flags contradict each other."""
    return F.expr(CAR_CONFLICT)


def check_features(df: DataFrame, roles: FeatureRoles) -> None:
    """Types, finite numbers, car rule and reserved tokens, counted in one pass."""
    require_columns(df, roles.features, "features")
    if set(roles.numeric) & set(roles.categorical):
        raise ContractError("features: roles overlap")
    for c in roles.numeric:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            raise ContractError(f"features: {c} is not numeric")
    floats = [c for c in roles.numeric if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    infinite = [F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))) for c in floats]
    reserved = [F.count_if(F.col(c).isin(MISSING_LEVEL, RARE_LEVEL)) for c in roles.categorical]
    car = F.count_if(car_conflict()) if has_car_rule(df) else F.lit(0)
    row = df.agg(
        reduce(lambda a, b: a + b, infinite, F.lit(0)).alias("infinite"),
        reduce(lambda a, b: a + b, reserved, F.lit(0)).alias("reserved"),
        car.alias("car"),
    ).first()
    if row["infinite"]:
        raise ContractError("features: infinite values")
    if row["reserved"]:
        raise ContractError("features: a category uses a reserved token")
    if row["car"]:
        raise ContractError("features: car age and its flags contradict each other")


def fill_car_age(df: DataFrame, owner_median: float) -> DataFrame:
    """Structural absence becomes 0; an owner's missing age becomes the owners' median."""
    if not has_car_rule(df):
        return df
    return df.withColumn(
        CAR_AGE,
        F.when(F.col(CAR_NOT_APPLICABLE) == 1, 0.0)
        .when(F.col(CAR_MISSING) == 1, F.lit(float(owner_median)))
        .otherwise(F.col(CAR_AGE)),
    )


def owner_median(train: DataFrame) -> float:
    if not has_car_rule(train):
        return 0.0
    owners = train.where(
        (F.col(CAR_NOT_APPLICABLE) == 0) & (F.col(CAR_MISSING) == 0) & F.col(CAR_AGE).isNotNull()
    ).select(F.col(CAR_AGE).cast("double").alias("value"))
    ranked = ranked_values(owners, "value")
    return float(ranked.agg(*quantile_columns("value", {"m": 0.5})).first()["m"] or 0.0)


def column_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median, missing count and observed count per numeric column."""
    long = long_numbers(train, columns)
    ranked = ranked_values(long, "value", ["column_name"])
    medians = ranked.groupBy("column_name").agg(*quantile_columns("value", {"median": 0.5}))
    seen = long.groupBy("column_name").agg(
        F.count("value").alias("observed_count"), F.count_if(F.col("value").isNull()).alias("missing_count")
    )
    return seen.join(medians, "column_name", "left")


def impute(df: DataFrame, medians: dict[str, float], indicators: Sequence[str]) -> DataFrame:
    """Median fill (0 for columns without a median) and 0/1 indicators for the named columns."""
    flags = [F.col(c).isNull().cast("double").alias(f"missing_{c}") for c in indicators]
    rest = [F.col(c) for c in df.columns if c not in medians]
    filled = [
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(m or 0.0))).alias(c)
        for c, m in medians.items()
    ]
    return df.select(*rest, *filled, *flags)


def population_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Population standard deviation per column; 1 where it is zero."""
    row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: (row[c] or 1.0) for c in columns}


def level_shares(train: DataFrame, columns: Sequence[str], share: float = RARE_SHARE) -> DataFrame:
    """Training levels per column with their share and whether they are pooled as rare."""
    marked = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)).alias(c) for c in columns])
    counts = level_counts(marked, columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("_total"))
    rate = F.col("n") / F.col("_total")
    return counts.join(totals, "column_name").select(
        "column_name", F.col("value").alias("level"), "n", rate.alias("share"),
        ((rate < F.lit(share)) & (F.col("value") != MISSING_LEVEL)).alias("is_rare"),
    )


def fit(train: DataFrame, roles: FeatureRoles, family: str = "linear", share: float = RARE_SHARE) -> FittedPrep:
    """Fit on training rows only. ``linear`` also scales without centring."""
    if family not in ("linear", "tree"):
        raise ContractError(f"unknown model family {family!r}")
    if not 0 < share < 1:
        raise ContractError("the rare share must lie in (0, 1): it bounds the kept levels by 1/share")
    require_columns(train, roles.features, "features")
    train = train.select(*roles.features)
    check_features(train, roles)
    car_fill = owner_median(train)
    ready = fill_car_age(train, car_fill)
    # one row per numeric column
    stats = {r["column_name"]: r for r in column_medians(ready, roles.numeric).collect()}
    medians = {c: float(stats[c]["median"] or 0.0) for c in roles.numeric}
    indicators = tuple(c for c in roles.numeric if stats[c]["missing_count"] > 0)
    scales = (
        population_scales(impute(ready, medians, ()), roles.numeric)
        if family == "linear"
        else dict.fromkeys(roles.numeric, 1.0)
    )
    kept: dict[str, tuple[str, ...]] = {}
    rare_count: dict[str, int] = dict.fromkeys(roles.categorical, 0)
    rare = None
    if roles.categorical:
        levels = cut_lineage(level_shares(train, roles.categorical, share))
        rare = levels.where("is_rare").select("column_name", "level")
        rare_count |= {r["column_name"]: r["count"] for r in rare.groupBy("column_name").count().collect()}
        # kept levels each cover at least ``share`` of the rows, so their number is bounded by 1/share
        found: dict[str, list[str]] = {c: [] for c in roles.categorical}
        for r in levels.where("NOT is_rare").select("column_name", "level").collect():
            found[r["column_name"]].append(r["level"])
        kept = {c: tuple(sorted(v) + ([RARE_LEVEL] if rare_count[c] else [])) for c, v in found.items()}
    return FittedPrep(roles, family, car_fill, medians, indicators, scales, kept, rare, rare_count)


def group_levels(df: DataFrame, prep: FittedPrep) -> DataFrame:
    """NULL and rare training levels become tokens; levels never seen in training pass through."""
    out = df
    for c in prep.roles.categorical:
        level = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL))
        out = out.withColumn(c, level)
        if not prep.rare_count[c]:
            continue
        hit = prep.rare.where(F.col("column_name") == c).select(F.col("level").alias("_key"), F.lit(1).alias("_rare"))
        # common levels can never match: they get a per-partition key so that no task collects them
        common = F.col(c).isin(*[v for v in prep.kept[c] if v != RARE_LEVEL])
        key = F.when(common, F.concat(F.lit("\u0001"), F.spark_partition_id().cast("string"))).otherwise(F.col(c))
        out = (
            out.withColumn("_key", key)
            .join(hit, "_key", "left")
            .withColumn(c, F.when(F.col("_rare") == 1, RARE_LEVEL).otherwise(F.col(c)))
            .drop("_key", "_rare")
        )
    return out


def transform(df: DataFrame, prep: FittedPrep, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
    """Assemble the feature vector; unseen categories become all zeros."""
    numeric, categorical = list(prep.roles.numeric), list(prep.roles.categorical)
    # carried columns keep their raw values next to the transformed ones
    narrow = df.select(*numeric, *categorical, *[F.col(c).alias(f"_keep_{c}") for c in keep])
    ready = group_levels(fill_car_age(narrow, prep.car_fill), prep)
    filled = impute(ready, prep.medians, prep.indicators)
    for c in numeric:
        if prep.scales[c] != 1.0:
            filled = filled.withColumn(c, F.col(c) / F.lit(prep.scales[c]))
    inputs = numeric + [f"missing_{c}" for c in prep.indicators]
    if categorical:
        indexed = filled
        for c in categorical:
            model = StringIndexerModel.from_labels(list(prep.kept[c]), c, f"_i_{c}", "keep")
            indexed = model.transform(indexed)
        encoder = OneHotEncoder(
            inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_v_{c}" for c in categorical],
            handleInvalid="error", dropLast=True,
        ).fit(indexed)
        filled = encoder.transform(indexed)
        inputs += [f"_v_{c}" for c in categorical]
    assembled = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error").transform(filled)
    return assembled.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], output)


def design_long(design: DataFrame, names: Sequence[str], keep: Sequence[str] = (), vector: str = "features") -> DataFrame:
    """(keep..., slot, value): the non-zero slots of each row's vector under their names."""
    slots = F.array(*[F.lit(n) for n in names])
    entries = F.transform(vector_to_array(vector), lambda x, i: F.struct(F.get(slots, i).alias("slot"), x.alias("value")))
    return design.select(*keep, F.inline(F.filter(entries, lambda e: e["value"] != 0)))


def non_finite_rows(design: DataFrame, vector: str = "features") -> DataFrame:
    """Rows whose assembled vector holds NaN or an infinity."""
    bad = F.exists(vector_to_array(vector), lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return design.agg(F.count("*").alias("row_count"), F.count_if(bad).alias("non_finite_rows"))
