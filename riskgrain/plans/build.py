"""End-to-end jobs: raw validation, mart build with publication, evaluation, batch scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrain.operators import features, mart_state, metrics, quality, raw_text, records, strategy
from riskgrain.schemas import ID, TABLES, check_prefix, schema_fingerprint
from riskgrain.sources.sinks import publish, write_mart


def validate_raw(tables: Mapping[str, DataFrame], exact_columns: bool = True) -> tuple[DataFrame, DataFrame]:
    """(findings, status) over the three raw tables read as text."""
    parts = []
    for name, df in tables.items():
        if exact_columns:
            quality.check_exact_columns(df, name)
        parts.append(raw_text.table_findings(df, name, TABLES[name].expected_rows))
    children = {k: v for k, v in tables.items() if k != "application"}
    parts.append(quality.scope_findings(quality.history_coverage(tables["application"], children)))
    findings = reduce(DataFrame.unionByName, parts)
    return findings, quality.validation_status(findings)


def build_marts(
    spark: SparkSession,
    application: DataFrame,
    splits: DataFrame,
    bureau: DataFrame,
    payments: DataFrame,
    paths: Mapping[str, str],
    summary_path: str,
) -> dict:
    """Check the sources, write V1, V2 and V3, check them, then publish all with the summary last.

    Each mart is read back from its staged files, which also cuts the lineage of the next one. The marts' states are
    published beside the summary; versions are compared by them.
    """
    quality.enforce_source_contract(quality.source_contract(application, splits, bureau, payments))
    summary: dict = {}

    def stage(version: str, build) -> callable:
        def write(target: str) -> None:
            write_mart(build(), target)
            staged[version] = target

        return write

    staged: dict[str, str] = {}

    def read(version: str) -> DataFrame:
        return spark.read.parquet(staged[version])

    states: dict[str, DataFrame] = {}

    def write_states(target: str) -> None:
        all_states = reduce(DataFrame.unionByName, [mart_state.mart_state(read(v), v) for v in ("v1", "v2", "v3")])
        all_states.coalesce(1).write.mode("overwrite").parquet(target)
        written = spark.read.parquet(target)
        states.update({v: written.where(F.col("version") == v) for v in ("v1", "v2", "v3")})

    def write_summary(target: str) -> None:
        for version, state in states.items():
            mart = read(version)
            summary[version] = {
                "rows": state.where(F.col("column_name") == ID).first()["row_count"],
                "columns": len(mart.columns),
                "schema_fingerprint": schema_fingerprint(mart),
            }
        rows = [(v, s["rows"], s["columns"], s["schema_fingerprint"]) for v, s in summary.items()]
        spark.createDataFrame(rows, "version string, row_count bigint, column_count int, schema_fingerprint string").coalesce(
            1
        ).write.mode("overwrite").json(target)

    def check(_: dict[str, str]) -> None:
        v1, v2, v3 = read("v1"), read("v2"), read("v3")
        check_prefix(v1, v2)
        check_prefix(v2, v3)
        quality.enforce_mart_contract(
            *[quality.mart_contract(m, splits) for m in (v1, v2, v3)],
            quality.bureau_contract(v3, bureau, application),
            quality.installment_contract(v3, payments, application),
        )
        mart_state.check_states(states)

    publish(
        spark,
        {
            paths["v1"]: stage("v1", lambda: features.application_mart(application, splits)),
            paths["v2"]: stage("v2", lambda: features.bureau_mart(read("v1"), bureau)),
            paths["v3"]: stage("v3", lambda: features.installment_mart(read("v2"), payments)),
            f"{summary_path.rstrip('/')}-states": write_states,
            summary_path: write_summary,
        },
        check,
    )
    return summary


def strategy_report(scored: DataFrame) -> dict[str, DataFrame]:
    """Deciles, capacity scenarios, bands, subgroups and alerts of one scored validation set."""
    metrics.check_scores(scored)
    curve = metrics.score_curve(scored)
    cutoff = metrics.binary_metrics(curve, top_fraction=metrics.HIGH_RISK_FRACTION).first()["cutoff_score"]
    groups = strategy.subgroup_metrics(scored, cutoff)
    return {
        "metrics": metrics.binary_metrics(curve, threshold=cutoff),
        "deciles": metrics.risk_deciles(curve),
        "scenarios": metrics.topk_scenarios(curve),
        "bands": metrics.risk_bands(curve),
        "calibration": metrics.calibration_bins(curve),
        "subgroups": groups,
        "alerts": strategy.alert_rows(groups),
    }


def score_batch(
    batch: DataFrame,
    specs: Sequence[records.FieldSpec],
    scorer,
    policy: Mapping[str, float],
    known_levels: Mapping[str, Sequence[str]] | None = None,
    strict: bool = True,
    calibrator=None,
) -> DataFrame:
    """Validate, score (``scorer`` adds ``score``), calibrate (``calibrator`` replaces it) and apply the policy.

    With ``strict`` any invalid row rejects the whole batch; otherwise only valid rows are scored.
    """
    validated = records.validate_records(batch, specs)
    valid, _ = records.split_valid(validated, strict)
    names = [s.name for s in specs]
    scored = scorer(valid)
    scored = records.apply_policy(calibrator(scored) if calibrator else scored, policy)
    return scored.select(
        "record_id", F.col("score").alias("probability"), "risk_band", "priority_review",
        *records.record_warnings(names, known_levels),
    )
