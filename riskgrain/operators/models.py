"""Classifiers, out-of-fold scoring and score calibration as Spark ML jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrain.functions.scalars import logit
from riskgrain.operators import isotonic, metrics, prep
from riskgrain.operators.ranking import quantile_columns, ranked_values
from riskgrain.operators.splits import sealed, stratified_folds
from riskgrain.schemas import ID, SPLIT, TARGET, ContractError, FeatureRoles
from riskgrain.session import cut_lineage

# Model settings.
LOGISTIC_C = 1.0
LOGISTIC_ITERATIONS = 600
LOGISTIC_TOLERANCE = 1e-4
FOREST = {"numTrees": 150, "maxDepth": 12, "minInstancesPerNode": 100, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.7}
BOOSTING = {"maxIter": 500, "stepSize": 0.05, "minInstancesPerNode": 100, "maxDepth": 5}
BOOSTING_CANDIDATES = {
    "baseline": (0, {}),
    "regularized_sampling": (1, {"minInstancesPerNode": 200, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}),
    "higher_capacity_regularized": (
        2,
        {"maxDepth": 6, "minInstancesPerNode": 150, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    ),
}
TUNING_FOLDS, CALIBRATION_FOLDS = 3, 5
TUNING_SEED, CALIBRATION_SEED, ABLATION_SEED = 42, 43, 44
CALIBRATION_METHODS = ("identity", "sigmoid", "isotonic")

#: Rows of a design in one partition at least: a round of boosting is some ten jobs, each of which starts every partition.
PARTITION_ROWS = 20_000
#: Rows of a design in one partition at most, which bounds the memory of a task; below that a design takes no more partitions than
#: there are cores, as each of them shuffles a histogram of every node, feature and bin at every level of a tree.
PARTITION_ROWS_MOST = 500_000
#: Rows of the designs that are fitted at the same time; a single larger one fills the cores alone.
ROWS_AT_ONCE = 1_000_000
#: Fits at the same time at most.
FITS_AT_ONCE = 12


@dataclass(frozen=True)
class Fitter:
    """Fits a design. ``prepare`` makes the estimator and the rows it is to see, without fitting."""

    prepare: Callable[[DataFrame], tuple[object, DataFrame]]

    def __call__(self, design: DataFrame):
        estimator, rows = self.prepare(design)
        return estimator.fit(rows)


def dealt(design: DataFrame, rows: int) -> DataFrame:
    """``design`` in as few partitions as its rows and the cores need, all of about the same size."""
    cores = design.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(rows // PARTITION_ROWS, max(cores, -(-rows // PARTITION_ROWS_MOST))))
    if parts == 1:
        return design.coalesce(1)
    return design if parts == design.rdd.getNumPartitions() else cut_lineage(design.repartition(parts))


def fit_together(work: Sequence[tuple[Fitter, DataFrame]]) -> list:
    """The fitted models, in order. Fits wait for many small jobs in turn, so those of small designs run side by side.

    Every fit sees all rows of its design, in as few partitions as its rows need.
    """
    known: dict[int, tuple[int, DataFrame]] = {}
    for _, design in work:
        if id(design) not in known:
            rows = design.count()
            known[id(design)] = rows, dealt(design, rows)
    ready = [fitter.prepare(known[id(design)][1]) for fitter, design in work]
    largest = max((rows for rows, _ in known.values()), default=0)
    workers = max(1, min(len(work), FITS_AT_ONCE, ROWS_AT_ONCE // max(1, largest)))
    if workers == 1:
        return [estimator.fit(rows) for estimator, rows in ready]
    with ThreadPoolExecutor(workers) as pool:
        started = [pool.submit(inheritable_thread_target(rows.sparkSession)(estimator.fit), rows) for estimator, rows in ready]
        return [s.result() for s in started]


def class_distribution(rows: DataFrame, target: str = TARGET) -> DataFrame:
    return rows.agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(target) == 0).alias("negatives"),
        F.count_if(F.col(target) == 1).alias("positives"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
    )


def balanced_weights(train: DataFrame, target: str = TARGET) -> dict[int, float]:
    """n / (2 * n_class) for both classes."""
    r = class_distribution(train, target).first()
    if not r["negatives"] or not r["positives"]:
        raise ContractError("both classes are needed")
    return {0: r["row_count"] / (2 * r["negatives"]), 1: r["row_count"] / (2 * r["positives"])}


def prior_scores(train: DataFrame, rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Constant score: the training prevalence."""
    rate = train.agg(F.avg(F.col(target).cast("double")).alias("rate")).scalar()
    return rows.withColumn("score", rate)


def logistic(c: float = LOGISTIC_C, iterations: int = LOGISTIC_ITERATIONS) -> Fitter:
    """L2 logistic regression; the penalty is rescaled to Spark's mean-loss objective."""

    def prepare(design: DataFrame):
        n = design.count()
        return LogisticRegression(
            featuresCol="features", labelCol=TARGET, regParam=1.0 / (c * n), elasticNetParam=0.0,
            standardization=False, maxIter=iterations, tol=LOGISTIC_TOLERANCE,
        ), design

    return Fitter(prepare)


def forest(seed: int = 42, **overrides) -> Fitter:
    def prepare(design: DataFrame):
        w = balanced_weights(design)
        weighted = design.withColumn("_w", F.when(F.col(TARGET) == 1, F.lit(w[1])).otherwise(F.lit(w[0])))
        return RandomForestClassifier(
            featuresCol="features", labelCol=TARGET, weightCol="_w", seed=seed, **{**FOREST, **overrides}
        ), weighted

    return Fitter(prepare)


def boosting(seed: int = 42, **overrides) -> Fitter:
    def prepare(design: DataFrame):
        return GBTClassifier(featuresCol="features", labelCol=TARGET, seed=seed, **{**BOOSTING, **overrides}), design

    return Fitter(prepare)


def convergence(model) -> dict:
    """Iterations and convergence of a logistic fit."""
    s = model.summary
    return {
        "iterations": int(s.totalIterations),
        "iteration_cap": int(model.getMaxIter()),
        "converged": int(s.totalIterations) < int(model.getMaxIter()),
        "final_objective": float(s.objectiveHistory[-1]),
    }


def score(model, design: DataFrame, keep: Sequence[str] = (ID, TARGET)) -> DataFrame:
    """Probability of class 1, NULL and NaN rejected at the next metric contract."""
    return model.transform(design).select(*keep, vector_to_array("probability")[1].alias("score"))


@dataclass(frozen=True)
class Experiment:
    key: str
    roles: FeatureRoles
    family: str
    fitter: Fitter


def run_experiments(experiments: Sequence[Experiment], train: DataFrame, validation: DataFrame) -> list[DataFrame]:
    """Fit preprocessing and models on train, return each one's validation scores; rows that carry a sealed part fail the job."""
    train, validation = (sealed(df) if SPLIT in df.columns else df for df in (train, validation))
    fitted = [prep.fit(train, e.roles, e.family) for e in experiments]
    designs = [cut_lineage(prep.transform(train, f, (ID, TARGET))) for f in fitted]
    fits = fit_together([(e.fitter, design) for e, design in zip(experiments, designs, strict=True)])
    return [score(model, prep.transform(validation, f, (ID, TARGET))) for model, f in zip(fits, fitted, strict=True)]


def run_experiment(experiment: Experiment, train: DataFrame, validation: DataFrame) -> DataFrame:
    """The validation scores of one experiment."""
    return run_experiments([experiment], train, validation)[0]


def labelled(scores: DataFrame) -> DataFrame:
    return scores.withColumn("label", F.col(TARGET).cast("int"))


def compare_experiments(experiments: Sequence[Experiment], train: DataFrame, validation: DataFrame) -> DataFrame:
    """One metric row per experiment under the same contract."""
    scored = run_experiments(experiments, train, validation)
    parts = [df.withColumn("model", F.lit(e.key)) for df, e in zip(scored, experiments, strict=True)]
    return metrics.evaluate(labelled(reduce(DataFrame.unionByName, parts)), ["model"])


def out_of_fold(
    train: DataFrame, roles: FeatureRoles, fitters: dict[str, Fitter], folds: int, seed: int, family: str = "linear"
) -> DataFrame:
    """Every training row scored once by a model that never saw it: id, label, fold, candidate, score.

    Each fold fits its own preprocessing once and shares it across candidates. The scores are
    checkpointed, so an executor loss does not refit a model.
    """
    work = [(key, roles, fitter) for key, fitter in fitters.items()]
    return _out_of_fold(train, roles, work, folds, seed, family)


def _out_of_fold(
    train: DataFrame, roles: FeatureRoles, work: Sequence[tuple[str, FeatureRoles, Fitter]], folds: int, seed: int, family: str
) -> DataFrame:
    """Out-of-fold scores of (candidate, its part of the roles, fitter)."""
    numbered = cut_lineage(train.join(stratified_folds(train, folds, seed).select(ID, "fold"), ID))
    planned = []
    for k in range(1, folds + 1):
        part = numbered.where(F.col("fold") != k)
        held = numbered.where(F.col("fold") == k)
        whole, made = prep.fit(part, roles, family), {}
        for key, own, fitter in work:
            if own not in made:
                fitted = whole.restricted(own)
                made[own] = cut_lineage(prep.transform(part, fitted, (ID, TARGET))), prep.transform(held, fitted, (ID, TARGET, "fold"))
            planned.append((key, fitter, *made[own]))
    fits = fit_together([(fitter, design) for _, fitter, design, _ in planned])
    parts = [
        score(model, held_design, (ID, TARGET, "fold")).withColumn("candidate", F.lit(key))
        for model, (key, _, _, held_design) in zip(fits, planned, strict=True)
    ]
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def oof_completeness(oof: DataFrame, train: DataFrame) -> DataFrame:
    """Rows scored more than once, never scored, or not finite, per candidate."""
    per = oof.groupBy("candidate", ID).agg(F.count("score").alias("n"))
    total = train.agg(F.count("*").alias("n")).scalar()
    return per.groupBy("candidate").agg(
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n") == 1).alias("scored_once")
    ).withColumn("unscored", total - F.col("scored_once") - F.col("repeated"))


def ablation(
    train: DataFrame, roles: FeatureRoles, fitter: Fitter, folds: int = TUNING_FOLDS, seed: int = ABLATION_SEED, family: str = "linear"
) -> DataFrame:
    """Out-of-fold metrics with all features and with each source group left out.

    Statistics are per column, so a fold fits its preprocessing once for all variants.
    """
    variants = {"full": roles} | {
        f"without_{g}": roles.without_group(g) for g, members in roles.source_groups().items() if members
    }
    work = [(key, r, fitter) for key, r in variants.items() if r.features]
    return metrics.evaluate(labelled(_out_of_fold(train, roles, work, folds, seed, family)), ["candidate"])


# ---------------------------------------------------------------------------
# calibration
# ---------------------------------------------------------------------------
def fit_calibrator(method: str, rows: DataFrame, label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """Fit on (label, score); the result replaces ``score`` of any frame."""
    if method == "identity":
        return lambda df: df
    y = F.col(label).cast("double").alias("_y")
    if method == "sigmoid":
        points = VectorAssembler(inputCols=["_x"], outputCol="_f")
        model = LogisticRegression(
            featuresCol="_f", labelCol="_y", regParam=0.0, standardization=False, maxIter=1000, tol=1e-9
        ).fit(points.transform(rows.select(logit(F.col("score")).alias("_x"), y)))
        slope, intercept = float(model.coefficients[0]), float(model.intercept)
        if not slope > 0:
            raise ContractError("the sigmoid does not keep the score order")
        z = F.lit(slope) * logit(F.col("score")) + F.lit(intercept)
        return lambda df: df.withColumn("score", 1.0 / (1.0 + F.exp(-z)))
    if method == "isotonic":
        pools = isotonic.isotonic_pools(rows, label)
        return lambda df: isotonic.calibrate(df, pools, out="_p").withColumn("score", F.col("_p")).drop("_p")
    raise ContractError(f"unknown calibration method {method!r}")


def crossfit_calibration(scored: DataFrame, folds: int = CALIBRATION_FOLDS, seed: int = CALIBRATION_SEED) -> DataFrame:
    """Cross-fitted scores of every method: id, label, fold, method, score."""
    numbered = cut_lineage(
        scored.select("id", "label", "score").join(
            stratified_folds(scored, folds, seed, "id", "label").select("id", "fold"), "id"
        )
    )
    parts = []
    for k in range(1, folds + 1):
        part, held = numbered.where(F.col("fold") != k), numbered.where(F.col("fold") == k)
        for method in CALIBRATION_METHODS:
            parts.append(fit_calibrator(method, part)(held).withColumn("method", F.lit(method)))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def final_calibrator(oof: DataFrame, method: str, label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """The selected method refitted on all out-of-fold rows, for batches to come."""
    return fit_calibrator(method, oof, label)


def score_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Minimum, mean, exact median, maximum and population deviation of the scores."""
    basic = scored.groupBy(*keys).agg(
        F.min("score").alias("minimum"), F.avg("score").alias("mean"),
        F.max("score").alias("maximum"), F.stddev_pop("score").alias("std"),
    )
    medians = ranked_values(scored, "score", keys).groupBy(*keys).agg(*quantile_columns("score", {"median": 0.5}))
    return basic.join(medians, list(keys)) if keys else basic.withColumn("median", medians.scalar())
