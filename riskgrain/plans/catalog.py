"""Registered queries: every operator over the given tables, with comparison SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.functions.scalars import log_loss_term, logit, semantic_type
from riskgrain.operators import (
    attribution,
    features,
    isotonic,
    mart_state,
    metrics,
    models,
    prep,
    profiling,
    quality,
    raw_text,
    records,
    selection,
    splits,
    strategy,
)
from riskgrain.plans import oracle_base as ob
from riskgrain.plans.oracle_base import long_numbers, long_texts, sql
from riskgrain.schemas import (
    CATEGORICAL,
    DERIVED_FEATURES,
    ID,
    SPLIT,
    TABLES,
    TARGET,
    FeatureRoles,
    resolve_roles,
)
from riskgrain.session import cut_lineage, shared_folder, stored
from riskgrain.sources import rolemap
from riskgrain.sources.sinks import write_mart
from riskgrain.streaming.scoring import score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

APP_TEXT = [c for c in rolemap.APPLICATION_SQL if c in CATEGORICAL["application"]]
APP_NUMBERS = [c for c in rolemap.APPLICATION_SQL if c not in CATEGORICAL["application"] and c not in (ID, TARGET)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; results of the operators themselves are not rounded."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# --- inputs ----------------------------------------------------------------
def _app(s: SparkSession, d: str) -> DataFrame:
    return rolemap.application(s, d)


def _split(s: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(_app(s, d))


def _v1(s: SparkSession, d: str) -> DataFrame:
    return features.application_mart(_app(s, d), _split(s, d))


def _v2(s: SparkSession, d: str) -> DataFrame:
    return features.bureau_mart(_v1(s, d), rolemap.bureau(s, d))


def _v3(s: SparkSession, d: str) -> DataFrame:
    return features.installment_mart(_v2(s, d), rolemap.installments(s, d))


def _written(s: SparkSession, d: str, version: str) -> DataFrame:
    """A mart as it is after it was written, which is what its contract is about."""
    path = f"{shared_folder(s)}/mart-{version}-{uuid.uuid4().hex}"
    write_mart({"v1": _v1, "v2": _v2, "v3": _v3}[version](s, d), path)
    return s.read.parquet(path)


def _chained(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The three marts as written, each built from the written one before, as ``build_marts`` does and the SQL reads them."""
    marts: dict[str, DataFrame] = {}
    for version, make in (
        ("v1", lambda: _v1(s, d)),
        ("v2", lambda: features.bureau_mart(marts["v1"], rolemap.bureau(s, d))),
        ("v3", lambda: features.installment_mart(marts["v2"], rolemap.installments(s, d))),
    ):
        path = f"{shared_folder(s)}/mart-{version}-{uuid.uuid4().hex}"
        write_mart(make(), path)
        marts[version] = s.read.parquet(path)
    return marts


def _states(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The states of the three marts, written, as each is compared more than once."""
    return {v: stored(mart_state.mart_state(mart, v)) for v, mart in _chained(s, d).items()}


def _train_app(s: SparkSession, d: str) -> DataFrame:
    """Training rows of the applicants; written once because the profiles read them several times."""
    return cut_lineage(profiling.train_rows(_app(s, d), _split(s, d)))


def _train(s: SparkSession, d: str) -> DataFrame:
    """Training rows of the mart; written once because the profiles read them several times."""
    return cut_lineage(_v3(s, d).where(F.col(SPLIT) == "train"))


def _curve(s: SparkSession, d: str) -> DataFrame:
    return metrics.score_curve(rolemap.scores(s, d))


def _scored_mart(s: SparkSession, d: str) -> DataFrame:
    score = (F.col(ID) * 7919 % 1000).cast("double") / 1000.0
    return cut_lineage(
        _v3(s, d).select(
            F.col(ID).alias("id"), F.col(TARGET).cast("int").alias("label"), score.alias("score"),
            "BUREAU_HAS_HISTORY", "INST_HAS_HISTORY", "APP_EXT_SOURCE_OBSERVED_COUNT", "APP_AGE_YEARS", "CODE_GENDER",
            *COEFFICIENTS,
        )
    )


# Fixed linear model of the attribution queries.
COEFFICIENTS = {
    "APP_CREDIT_INCOME_RATIO": 0.04, "BUREAU_RECORD_COUNT": 0.1, "BUREAU_ACTIVE_RATIO": -0.8,
    "INST_LATE_RATIO": 1.5, "INST_PAYMENT_RATIO": -0.6,
}
MEANS = {
    "APP_CREDIT_INCOME_RATIO": 6.0, "BUREAU_RECORD_COUNT": 9.0, "BUREAU_ACTIVE_RATIO": 0.3,
    "INST_LATE_RATIO": 0.5, "INST_PAYMENT_RATIO": 0.95,
}
BASE_VALUE = -2.4

# --- marts -----------------------------------------------------------------
register("v1_application", sql(["v1"], "SELECT * FROM v1", ob.V1_DOUBLES))(_v1)

_HISTORY_V2 = f"SELECT SK_ID_CURR, TARGET, SPLIT, {', '.join('BUREAU_' + n for n in ['HAS_HISTORY', *ob.BUREAU_AGG])} FROM v2"


@register("bureau_features_v2", sql(["v2"], _HISTORY_V2, ob.BUREAU_DOUBLES))
def _(s, d):
    return _v2(s, d).select(ID, TARGET, SPLIT, *[c for c in DERIVED_FEATURES if c.startswith("BUREAU_")])


@register(
    "bureau_aggregate_all_customers",
    sql(
        ["bureau"],
        "SELECT SK_ID_CURR, " + ", ".join(f"{e} AS BUREAU_{n}" for n, e in ob.BUREAU_AGG.items())
        + " FROM bureau WHERE DAYS_CREDIT_UPDATE <= 0 GROUP BY SK_ID_CURR",
        ob.BUREAU_DOUBLES,
    ),
)
def _(s, d):
    return features.bureau_features(rolemap.bureau(s, d))


_LEVEL = [*features.SCHEDULE_KEY, "DAYS_DUE", "PAYMENT_EVENT_COUNT", "MISSING_PAYMENT_EVENT_COUNT", "DAYS_PAID_LAST", "DAYS_LATE", "PAYMENT_RATIO", "IS_UNDERPAID"]
_LEVEL_MONEY = ["SCHEDULED_AMOUNT", "PAID_AMOUNT", "PAYMENT_GAP"]


@register(
    "installment_levels",
    sql(
        ["lvl"],
        f"SELECT {', '.join(_LEVEL)}, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in _LEVEL_MONEY) + " FROM lvl",
        ["PAYMENT_RATIO", *_LEVEL_MONEY],
    ),
)
def _(s, d):
    rows = features.installment_schedules(rolemap.installments(s, d))
    return rows.select(*_LEVEL, *[F.col(c).cast("double").alias(c) for c in _LEVEL_MONEY])


_HISTORY_V3 = f"SELECT SK_ID_CURR, TARGET, SPLIT, {', '.join('INST_' + n for n in ['HAS_HISTORY', *ob.INST_AGG])} FROM v3"


@register("installment_features_v3", sql(["v3"], _HISTORY_V3, ob.INST_DOUBLES))
def _(s, d):
    return _v3(s, d).select(ID, TARGET, SPLIT, *[c for c in DERIVED_FEATURES if c.startswith("INST_")])


register(
    "feature_mart_v3", sql(["v3"], "SELECT * FROM v3", ob.V1_DOUBLES + ob.BUREAU_DOUBLES + ob.INST_DOUBLES)
)(_v3)


@register(
    "scope_semi_join",
    sql(["bureau", "app"], "SELECT SK_ID_BUREAU, SK_ID_CURR, AMT_CREDIT_SUM FROM bureau WHERE DAYS_CREDIT_UPDATE <= 0 AND EXISTS (SELECT 1 FROM app WHERE app.SK_ID_CURR = bureau.SK_ID_CURR)"),
)
def _(s, d):
    rows = features.in_scope(features.usable_credits(rolemap.bureau(s, d)), _app(s, d))
    return rows.select("SK_ID_BUREAU", ID, "AMT_CREDIT_SUM")


# --- contracts and quality -------------------------------------------------
def _cells(scope: str, source: str, items: dict[str, str]) -> str:
    """(scope, check_name, value) rows from scalar subqueries or aggregates over ``source``."""
    return " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, '{k}' AS check_name, ({e})::BIGINT AS value FROM {source}" for k, e in items.items()
    )


def _count(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


_CUSTOMER = {
    "row_count": "count(*)", "unique_ids": "count(DISTINCT SK_ID_CURR)", "missing_ids": _count("SK_ID_CURR IS NULL"),
    "invalid_targets": _count("TARGET IS NULL OR TARGET NOT IN (0, 1)"),
}
_SPLIT_CHECKS = {
    **_CUSTOMER, "invalid_splits": _count("SPLIT IS NULL OR SPLIT NOT IN ('train', 'validation', 'test')"), "split_names": "count(DISTINCT SPLIT)",
}


def _mismatch(left: str, right: str, columns: list[str]) -> str:
    differ = " OR ".join(f"l.{c} <> r.{c}" for c in columns)
    return f"(SELECT count(*) FROM {left} AS l FULL JOIN {right} AS r ON l.SK_ID_CURR = r.SK_ID_CURR WHERE l.SK_ID_CURR IS NULL OR r.SK_ID_CURR IS NULL OR {differ})"


_SCHEDULE = "SELECT SK_ID_CURR FROM inst GROUP BY SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER HAVING "
_SOURCE = " UNION ALL ".join(
    [
        _cells("application", "app", {**_CUSTOMER, "employed_sentinel_rows": _count("DAYS_EMPLOYED = 365243")}),
        _cells("splits", "split", _SPLIT_CHECKS),
        _cells("splits", "(SELECT 1)", {"assignment_mismatches": _mismatch("app", "split", ["TARGET"])}),
        _cells("bureau", "bureau", {
            "row_count": "count(*)", "missing_keys": _count("SK_ID_CURR IS NULL OR SK_ID_BUREAU IS NULL"),
            "unique_loan_ids": "count(DISTINCT SK_ID_BUREAU)", "future_credit_rows": _count("DAYS_CREDIT > 0"),
            "positive_update_rows": _count("DAYS_CREDIT_UPDATE > 0"),
        }),
        _cells("installments", "inst", {
            "row_count": "count(*)", "missing_keys": _count("SK_ID_CURR IS NULL OR SK_ID_PREV IS NULL"),
            "future_due_rows": _count("DAYS_INSTALMENT > 0"), "future_payment_rows": _count("DAYS_ENTRY_PAYMENT > 0"),
            "mismatched_missingness": _count("(DAYS_ENTRY_PAYMENT IS NULL) <> (AMT_PAYMENT IS NULL)"),
        }),
        _cells("installments", "(SELECT 1)", {
            "owner_violations": "SELECT count(*) FROM (SELECT SK_ID_PREV FROM inst GROUP BY SK_ID_PREV HAVING count(DISTINCT SK_ID_CURR) > 1)",
            "inconsistent_schedules": f"SELECT count(*) FROM ({_SCHEDULE} count(DISTINCT DAYS_INSTALMENT) > 1 OR count(DISTINCT AMT_INSTALMENT) > 1)",
        }),
    ]
)


@register("source_contract", sql(["app", "split", "bureau", "inst"], _SOURCE))
def _(s, d):
    return quality.source_contract(_app(s, d), _split(s, d), rolemap.bureau(s, d), rolemap.installments(s, d))


@register(
    "mart_contract",
    sql(["v3", "split"], _cells("mart", "v3", _SPLIT_CHECKS) + " UNION ALL " + _cells("splits", "(SELECT 1)", {
        "only_left": "SELECT count(*) FROM v3 WHERE SK_ID_CURR NOT IN (SELECT SK_ID_CURR FROM split)",
        "only_right": "SELECT count(*) FROM split WHERE SK_ID_CURR NOT IN (SELECT SK_ID_CURR FROM v3)",
        "mismatches": _mismatch("v3", "split", ["TARGET", "SPLIT"]),
    })),
)
def _(s, d):
    return quality.mart_contract(_written(s, d, "v3"), _split(s, d))


def _odd(c: str, upper: bool = True) -> str:
    return f"coalesce({c} < 0 OR isnan({c}) OR isinf({c}){f' OR {c} > 1' if upper else ''}, false)"


@register(
    "bureau_contract",
    sql(["v2", "bureau", "app"], _cells("mart", "v2", {
        "rows_aggregated": "sum(BUREAU_RECORD_COUNT)", "customers_with_history": "sum(BUREAU_HAS_HISTORY)",
        "no_history_violations": _count("BUREAU_HAS_HISTORY = 0 AND (BUREAU_RECORD_COUNT <> 0 OR BUREAU_ACTIVE_RATIO IS NOT NULL)"),
        "history_flag_violations": _count("BUREAU_HAS_HISTORY = 1 AND BUREAU_RECORD_COUNT = 0"),
        "count_violations": _count("greatest(BUREAU_ACTIVE_COUNT, BUREAU_OVERDUE_LOAN_COUNT) > BUREAU_RECORD_COUNT"),
        "ratio_violations": _count(f"{_odd('BUREAU_ACTIVE_RATIO')} OR {_odd('BUREAU_OVERDUE_LOAN_RATIO')}"),
    }) + " UNION ALL SELECT 'source', 'expected_rows', count(*) FROM bureau WHERE DAYS_CREDIT_UPDATE <= 0 AND SK_ID_CURR IN (SELECT SK_ID_CURR FROM app)"),
)
def _(s, d):
    return quality.bureau_contract(_written(s, d, "v2"), rolemap.bureau(s, d), _app(s, d))


_I = {k: f"INST_{k}_COUNT" for k in ("SCHEDULE", "MISSING_PAYMENT_SCHEDULE", "LATE_SCHEDULE", "UNDERPAID_SCHEDULE", "LAST_365_SCHEDULE", "LAST_365_LATE", "LAST_730_SCHEDULE", "LAST_730_LATE")}
_DATED, _PAID = "INST_PAYMENT_DATE_OBSERVED_SCHEDULE_COUNT", "INST_PAYMENT_AMOUNT_OBSERVED_SCHEDULE_COUNT"


@register(
    "installment_contract",
    sql(["v3", "inst", "app"], _cells("mart", "v3", {
        "rows_aggregated": "sum(INST_PAYMENT_EVENT_COUNT)", "schedules_aggregated": "sum(INST_SCHEDULE_COUNT)",
        "customers_with_history": "sum(INST_HAS_HISTORY)",
        "no_history_violations": _count("INST_HAS_HISTORY = 0 AND (INST_SCHEDULE_COUNT <> 0 OR INST_LATE_RATIO IS NOT NULL)"),
        "history_flag_violations": _count("INST_HAS_HISTORY = 1 AND INST_SCHEDULE_COUNT = 0"),
        "count_violations": _count(
            f"greatest({_DATED}, {_PAID}, {_I['LAST_730_SCHEDULE']}) > {_I['SCHEDULE']} "
            f"OR {_I['SCHEDULE']} - {_I['MISSING_PAYMENT_SCHEDULE']} <> {_DATED} OR {_I['SCHEDULE']} - {_I['MISSING_PAYMENT_SCHEDULE']} <> {_PAID} "
            f"OR {_I['LATE_SCHEDULE']} > {_DATED} OR {_I['UNDERPAID_SCHEDULE']} > {_PAID} OR {_I['LAST_365_SCHEDULE']} > {_I['LAST_730_SCHEDULE']} "
            f"OR {_I['LAST_365_LATE']} > {_I['LAST_365_SCHEDULE']} OR {_I['LAST_730_LATE']} > {_I['LAST_730_SCHEDULE']}"
        ),
        "ratio_violations": _count(" OR ".join(
            [_odd(f"INST_{k}_RATIO") for k in ("MISSING_PAYMENT", "LATE", "UNDERPAID", "LAST_365_LATE", "LAST_730_LATE")] + [_odd("INST_PAYMENT_RATIO", False)]
        )),
    }) + " UNION ALL SELECT 'source', 'expected_rows', count(*) FROM inst WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM app)"),
)
def _(s, d):
    return quality.installment_contract(_written(s, d, "v3"), rolemap.installments(s, d), _app(s, d))


#: A mart that breaks its contract: (column, condition, value) changes, and customers that come twice.
_PLANTED = [
    ("SK_ID_CURR", "SK_ID_CURR % 89 = 0", "NULL"), ("TARGET", "SK_ID_CURR % 97 = 0", "2"), ("SPLIT", "SK_ID_CURR % 101 = 0", "'dev'"),
    ("AMT_CREDIT", "SK_ID_CURR % 103 = 0", "AMT_CREDIT + 1"), ("EXT_SOURCE_1", "SK_ID_CURR % 107 = 0", "NULL"),
    ("BUREAU_DEBT_SUM", "SK_ID_CURR % 109 = 0", "CAST('Infinity' AS DOUBLE)"), ("OWN_CAR_AGE", "SK_ID_CURR % 113 = 0", "CAST('-Infinity' AS DOUBLE)"),
]
_TWICE = "SK_ID_CURR % 83 = 0"
_SWAPS = ", ".join(f"CASE WHEN {when} THEN {value} ELSE {c} END AS {c}" for c, when, value in _PLANTED)
ob.cte("v2_planted", ("v2",), f"WITH twice AS (SELECT * FROM v2 UNION ALL SELECT * FROM v2 WHERE {_TWICE}) SELECT * REPLACE ({_SWAPS}) FROM twice")


def _planted(s: SparkSession, d: str) -> DataFrame:
    mart = _v2(s, d)
    copies = mart.select("*", F.explode(F.expr(f"IF({_TWICE}, array(0, 1), array(0))")).alias("copy")).drop("copy")
    swaps = {c: f"CAST(CASE WHEN {when} THEN {value} ELSE {c} END AS {mart.schema[c].dataType.simpleString()})" for c, when, value in _PLANTED}
    path = f"{shared_folder(s)}/mart-planted-{uuid.uuid4().hex}"
    write_mart(copies.selectExpr(*[f"{swaps.get(c, c)} AS {c}" for c in mart.columns]), path)
    return s.read.parquet(path)


_V1_NAMES = ["SK_ID_CURR", "TARGET", "SPLIT", *ob._KEPT, *ob.V1_SQL]
_V2_NAMES = [*_V1_NAMES, "BUREAU_HAS_HISTORY", *(f"BUREAU_{n}" for n in ob.BUREAU_AGG)]
_V3_NAMES = [*_V2_NAMES, "INST_HAS_HISTORY", *(f"INST_{n}" for n in ob.INST_AGG)]
_ALL_DOUBLES = {*ob.V1_DOUBLES, *ob.BUREAU_DOUBLES, *ob.INST_DOUBLES}


def _state_cells(scope: str, source: str, names: list[str]) -> str:
    infinite = " + ".join(f"count(*) FILTER (isinf({c}))" for c in names if c in _ALL_DOUBLES)
    return _cells(scope, source, {
        **_SPLIT_CHECKS, "repeated_ids": "count(SK_ID_CURR) - count(DISTINCT SK_ID_CURR)", "infinite_values": infinite, "column_count": f"max({len(names)})"})


register("mart_states", sql(["v3"], " UNION ALL ".join([_state_cells("v1", "v1", _V1_NAMES), _state_cells("v2", "v2", _V2_NAMES), _state_cells("v3", "v3", _V3_NAMES)])))(
    lambda s, d: reduce(DataFrame.unionByName, [mart_state.state_contract(state) for state in _states(s, d).values()]))
register("loader_contract", sql(["v2_planted"], _state_cells("v2", "v2_planted", _V2_NAMES)))(
    lambda s, d: mart_state.state_contract(mart_state.mart_state(_planted(s, d), "v2")))


def _changed_sql(lower: str, higher: str, names: list[str]) -> str:
    """A column is unchanged if (customer, value) pairs are the same bag in both marts."""
    pair = lambda c, t: f"SELECT SK_ID_CURR AS k, {c} AS v FROM {t}"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, false AS missing, true AS changed WHERE EXISTS (({pair(c, lower)} EXCEPT ALL {pair(c, higher)}) UNION ALL ({pair(c, higher)} EXCEPT ALL {pair(c, lower)}))"
        for c in names)


@register("mart_lineage_states", sql(["v3"], _changed_sql("v1", "v2", _V1_NAMES) + " UNION ALL " + _changed_sql("v2", "v3", _V2_NAMES)))
def _(s, d):
    of = _states(s, d)
    return mart_state.changed_columns(of["v1"], of["v2"]).unionByName(mart_state.changed_columns(of["v2"], of["v3"]))


# identifiers are compared as (customer, customer), so a lost one shows in every column of its rows
register(
    "mart_lineage_planted",
    sql(["v1", "v2_planted"], "SELECT column_name, false AS missing, true AS changed FROM (VALUES " + ", ".join(f"('{c}')" for c in _V1_NAMES) + ") AS t(column_name) WHERE (SELECT count(*) FROM v1) <> (SELECT count(*) FROM v2_planted)"),
)(lambda s, d: mart_state.changed_columns(mart_state.mart_state(_written(s, d, "v1"), "v1"), mart_state.mart_state(_planted(s, d), "v2")))
ob.cte("v2_edited", ("v2",), "SELECT * REPLACE (CASE WHEN SK_ID_CURR % 103 = 0 THEN AMT_CREDIT + 1 ELSE AMT_CREDIT END AS AMT_CREDIT, CASE WHEN SK_ID_CURR % 107 = 0 THEN NULL ELSE EXT_SOURCE_2 END AS EXT_SOURCE_2) FROM v2")


@register("mart_lineage_edited", sql(["v1", "v2_edited"], _changed_sql("v1", "v2_edited", _V1_NAMES)))
def _(s, d):
    k = F.col(ID)
    edited = _v2(s, d).withColumn("AMT_CREDIT", F.when(k % 103 == 0, F.col("AMT_CREDIT") + 1).otherwise(F.col("AMT_CREDIT"))).withColumn(
        "EXT_SOURCE_2", F.when(k % 107 != 0, F.col("EXT_SOURCE_2")))
    path = f"{shared_folder(s)}/mart-edited-{uuid.uuid4().hex}"
    write_mart(edited, path)
    return mart_state.changed_columns(mart_state.mart_state(_written(s, d, "v1"), "v1"), mart_state.mart_state(s.read.parquet(path), "v2"))


_V1_COLUMNS = "SELECT * EXCLUDE (" + ", ".join("BUREAU_" + n for n in ["HAS_HISTORY", *ob.BUREAU_AGG]) + ") FROM v2"


@register("lineage_except_all", sql(["v1", "v2"], f"SELECT count(*) AS mismatches FROM (SELECT * FROM v1 EXCEPT ALL {_V1_COLUMNS})"))
def _(s, d):
    return quality.lineage_mismatches(_written(s, d, "v1"), _written(s, d, "v2"))


@register(
    "split_reconcile",
    sql(["app", "hold"], "SELECT count(*) AS row_count, count(*) FILTER (l.SK_ID_CURR IS NULL) AS only_right, count(*) FILTER (r.SK_ID_CURR IS NULL) AS only_left, "
        "count(*) FILTER (l.TARGET <> r.TARGET) AS target_differs, count(*) FILTER (l.SK_ID_CURR IS NULL OR r.SK_ID_CURR IS NULL OR l.TARGET <> r.TARGET) AS mismatches "
        "FROM app AS l FULL JOIN hold AS r ON l.SK_ID_CURR = r.SK_ID_CURR"),
)
def _(s, d):
    app = _app(s, d)
    return quality.reconcile(app, splits.holdout_split(app, 0.1, 7), [TARGET])


@register(
    "id_set_overlap",
    sql(["app", "bureau"], "SELECT (SELECT count(*) FROM (SELECT SK_ID_CURR FROM app INTERSECT SELECT SK_ID_CURR FROM bureau)) AS in_both, "
        "(SELECT count(*) FROM (SELECT SK_ID_CURR FROM app EXCEPT SELECT SK_ID_CURR FROM bureau)) AS left_only, "
        "(SELECT count(*) FROM (SELECT SK_ID_CURR FROM bureau EXCEPT SELECT SK_ID_CURR FROM app)) AS right_only"),
)
def _(s, d):
    return quality.id_overlap(_app(s, d), rolemap.bureau(s, d))


RAW_TABLES = tuple(rolemap.RAW)


def _parsed(c: str) -> str:
    return f"CASE WHEN NOT isnan(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END"


def _domain_sql(table: str, c: str) -> str:
    """Whether a token ``c`` with number ``v`` breaks the domain of its column."""
    d = raw_text.column_domain(table, c)
    if d is None:
        return "false"
    if d.numbers:
        broken = "(v IS NULL OR v NOT IN (0, 1))"
    elif d.texts:
        broken = "t NOT IN ('Y', 'N')"
    else:
        strict = "=" if d.open_ends else ""
        bounds = [f"v <{strict} {d.low}" if d.low > -raw_text.INF else "", f"v >{strict} {d.high}" if d.high < raw_text.INF else ""]
        broken = "(" + " OR ".join(b for b in bounds if b) + ")" + "".join(f" AND v <> {x}" for x in d.also)
        broken = f"v IS NOT NULL AND {broken}" + (" AND NOT isinf(v)" if c.startswith("SK_ID_") else "")
    return f"CASE WHEN gone THEN {str(d.null_counts).lower()} ELSE {broken} END"


def _states_sql(table: str) -> str:
    """The state of each column and fact of a raw table, column by column."""
    source, out = f"raw_{table}", []
    number = {c: c not in CATEGORICAL[table] for c in rolemap.RAW[table]}
    for c in rolemap.RAW[table]:
        gone = "t IS NULL" + (" OR lower(trim(t)) IN ('nan', '+nan', '-nan')" if number[c] else "")
        out.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) FILTER (gone) AS missing_count, count(*) FILTER (trim(t) = '') AS blank_count, "
            f"count(*) FILTER (NOT gone AND v IS NULL) AS text_count, count(*) FILTER (isinf(v) AND {str(number[c]).lower()}) AS infinite_count, count(*) FILTER (isfinite(v) AND v <> floor(v)) AS fraction_count, "
            f"count(*) FILTER ({_domain_sql(table, c)}) AS outside_count, count(*) FILTER (v = 1) AS one_count, min(v) FILTER (isfinite(v)) AS min_value, max(v) FILTER (isfinite(v)) AS max_value, "
            f"0::BIGINT AS groups, 0::BIGINT AS surplus, 0::BIGINT AS conflicts FROM (SELECT {c} AS t, {_parsed(c)} AS v, {gone} AS gone FROM {source})")
    same = {c: f"coalesce(({_parsed(c)})::VARCHAR, {c})" if number[c] else c for c in rolemap.RAW[table]}
    facts = {raw_text.ROW: (f"SELECT {', '.join(same.values())}, 1 AS one, count(*) AS n, 1 AS lo, 1 AS hi FROM {source} GROUP BY ALL", "one")}
    key = TABLES[table].primary_key
    if key:
        facts[raw_text.KEY] = (f"SELECT {same[key]} AS g, count(*) AS n, 1 AS lo, 1 AS hi FROM {source} GROUP BY g", "g")
    if table in raw_text.OWNED:
        facts[raw_text.OWNER] = (f"SELECT {same[raw_text.OWNED[table]]} AS g, count(*) AS n, min({_parsed(ID)}) AS lo, max({_parsed(ID)}) AS hi FROM {source} GROUP BY g", "g")
    for name, (grouped, g) in facts.items():
        out.append(
            f"SELECT '{table}', '{name}', sum(n)::BIGINT, coalesce(sum(n) FILTER ({g} IS NULL), 0)::BIGINT, 0, 0, 0, 0, 0, 0, NULL, NULL, count({g}), "
            f"coalesce(sum(n - 1) FILTER ({g} IS NOT NULL), 0)::BIGINT, count(*) FILTER ({g} IS NOT NULL AND lo <> hi) FROM ({grouped})")
    return " UNION ALL ".join(out)


for _t in RAW_TABLES:
    ob.cte(f"states_{_t}", (f"raw_{_t}",), _states_sql(_t))
_ALL_STATES = [f"states_{t}" for t in RAW_TABLES]


def _raw_states(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: raw_text.column_states(rolemap.raw_text(s, d, t), t) for t in RAW_TABLES}


def _each(s: SparkSession, d: str, make: Callable[[DataFrame, str, list[str]], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [make(states, t, list(rolemap.RAW[t])) for t, states in _raw_states(s, d).items()])


register("raw_text_states", sql(_ALL_STATES, " UNION ALL ".join(f"SELECT * FROM {t}" for t in _ALL_STATES), ["min_value", "max_value"]))(
    lambda s, d: _each(s, d, lambda states, t, columns: states))


def _merged(s: SparkSession, d: str, table: str) -> DataFrame:
    """States of three parts of a table, as if it came in three deliveries."""
    rows = rolemap.raw_text(s, d, table)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    return reduce(DataFrame.unionByName, [raw_text.column_states(rows.where(part == k), table) for k in range(3)])


register(
    "raw_text_merged",
    sql(_ALL_STATES, " UNION ALL ".join(f"SELECT * FROM {t} WHERE NOT starts_with(column_name, '#')" for t in _ALL_STATES), ["min_value", "max_value"]),
)(lambda s, d: reduce(DataFrame.unionByName, [raw_text.merged_states(_merged(s, d, t)) for t in RAW_TABLES]))


def _rules_sql(table: str) -> str:
    rules = [(rule, c, counter) for c in rolemap.RAW[table] for rule, counter in raw_text.column_rules(table, c)]
    return " UNION ALL ".join(
        f"SELECT table_name, '{rule}' AS rule, column_name, 'ERROR' AS severity, {counter} AS violations FROM states_{table} WHERE column_name = '{c}'" for rule, c, counter in rules)


register("raw_rules", sql(_ALL_STATES, " UNION ALL ".join(map(_rules_sql, RAW_TABLES))))(lambda s, d: _each(s, d, raw_text.rules_of))


def _text_profile_sql(table: str) -> str:
    number = ", ".join(f"'{c}'" for c in rolemap.RAW[table] if c not in CATEGORICAL[table])
    kinds = " ".join(f"WHEN '{c}' THEN '{semantic_type(c, c in CATEGORICAL[table])}'" for c in rolemap.RAW[table])
    return (
        f"SELECT table_name, column_name, CASE column_name {kinds} END AS semantic_type, row_count, missing_count, missing_count / row_count::DOUBLE AS missing_rate, blank_count, "
        f"row_count - missing_count - text_count AS number_count, text_count, infinite_count, fraction_count, CASE WHEN column_name IN ({number}) THEN min_value END AS min_value, "
        f"CASE WHEN column_name IN ({number}) THEN max_value END AS max_value FROM states_{table} WHERE NOT starts_with(column_name, '#')")


register("raw_text_profile", sql(_ALL_STATES, " UNION ALL ".join(map(_text_profile_sql, RAW_TABLES)), ["missing_rate", "min_value", "max_value"]))(
    lambda s, d: _each(s, d, raw_text.profile_of))


def _seen(table: str, source: str, items: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{k}' AS observation, count(*) FILTER ({p}) AS row_count FROM {source}" for k, p in items.items()
    )


@register(
    "domain_observations",
    sql(["app", "bureau", "inst"], " UNION ALL ".join([
        _seen("application", "app", {
            "days_employed_365243": "DAYS_EMPLOYED = 365243", "code_gender_xna": "CODE_GENDER = 'XNA'",
            "family_status_unknown": "NAME_FAMILY_STATUS = 'Unknown'",
            "own_car_age_missing_when_car_owned": "FLAG_OWN_CAR = 'Y' AND OWN_CAR_AGE IS NULL"}),
        _seen("bureau", "bureau", {
            "negative_credit_sum_debt": "AMT_CREDIT_SUM_DEBT < 0", "negative_credit_sum_limit": "AMT_CREDIT_SUM_LIMIT < 0",
            "positive_days_credit_update": "DAYS_CREDIT_UPDATE > 0",
            "active_with_enddate_fact": "CREDIT_ACTIVE = 'Active' AND DAYS_ENDDATE_FACT IS NOT NULL",
            "closed_without_enddate_fact": "CREDIT_ACTIVE = 'Closed' AND DAYS_ENDDATE_FACT IS NULL"}),
        _seen("installments", "inst", {
            "payment_fields_both_missing": "DAYS_ENTRY_PAYMENT IS NULL AND AMT_PAYMENT IS NULL",
            "payment_fields_missing_mismatch": "(DAYS_ENTRY_PAYMENT IS NULL) <> (AMT_PAYMENT IS NULL)",
            "payment_late": "DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT", "payment_early": "DAYS_ENTRY_PAYMENT < DAYS_INSTALMENT",
            "payment_on_time": "DAYS_ENTRY_PAYMENT = DAYS_INSTALMENT", "payment_below_scheduled": "AMT_PAYMENT < AMT_INSTALMENT",
            "payment_above_scheduled": "AMT_PAYMENT > AMT_INSTALMENT", "payment_equal_scheduled": "AMT_PAYMENT = AMT_INSTALMENT"}),
    ])),
)
def _(s, d):
    a = quality.domain_observations(_app(s, d), "application")
    b = quality.domain_observations(rolemap.bureau(s, d), "bureau")
    return a.unionByName(b).unionByName(quality.domain_observations(rolemap.installments(s, d), "installments"))


_KIND = {c: ("target" if c == "TARGET" else "identifier" if c.startswith("SK_ID_") else "amount" if c.startswith("AMT_") else
             "relative_days" if c.startswith("DAYS_") else "flag" if c.startswith("FLAG_") else "count" if c.startswith("CNT_") else
             "external_score" if c.startswith("EXT_SOURCE_") else "category" if c in APP_TEXT else "numeric") for c in rolemap.APPLICATION_SQL}


def _profile_cell(c: str) -> str:
    text = c in APP_TEXT
    low, high = ("NULL", "NULL") if text else (f"min({c})", f"max({c})")
    blank = f"count(*) FILTER (trim({c}) = '')" if text else "0::BIGINT"
    return (
        f"'{c}' AS column_name, '{_KIND[c]}' AS semantic_type, count(*) AS row_count, count(*) - count({c}) AS missing_count, "
        f"(count(*) - count({c})) / count(*)::DOUBLE AS missing_rate, {blank} AS blank_count, 0::BIGINT AS infinite_count, "
        f"{low}::DOUBLE AS min_value, {high}::DOUBLE AS max_value"
    )


@register("column_profile", sql(["app"], ob.union_cells("app", list(rolemap.APPLICATION_SQL), _profile_cell), ["missing_rate", "min_value", "max_value"]))
def _(s, d):
    return quality.column_profile(_app(s, d), APP_TEXT)


_BUREAU_TEXT = ["CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE"]


@register(
    "category_top20",
    sql(["bureau"], "SELECT column_name, value, n, rk::INTEGER AS rank, distinct_count FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk, "
        f"count(*) OVER (PARTITION BY column_name) AS distinct_count FROM (SELECT column_name, value, count(*) AS n FROM ({long_texts('bureau', _BUREAU_TEXT)}) WHERE value IS NOT NULL GROUP BY ALL))"),
)
def _(s, d):
    return quality.category_top(rolemap.bureau(s, d), _BUREAU_TEXT)


@register(
    "duplicate_rows",
    sql([], "SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_count, count(*) FILTER (n > 1) AS duplicated_groups "
        "FROM (SELECT *, count(*) AS n FROM lineitem GROUP BY ALL)"),
)
def _(s, d):
    return quality.duplicate_rows(rolemap.table(s, d, "lineitem"))


@register(
    "primary_key",
    sql(["bureau"], "SELECT count(*) AS row_count, count(*) - count(SK_ID_CURR) AS null_count, count(DISTINCT SK_ID_CURR) AS distinct_count, "
        "count(SK_ID_CURR) - count(DISTINCT SK_ID_CURR) AS duplicate_count FROM bureau"),
)
def _(s, d):
    return quality.primary_key(rolemap.bureau(s, d), ID)


@register(
    "loan_customer_dependency",
    sql(["inst"], "SELECT count(*) AS key_count, count(*) FILTER (k > 1) AS violating_keys FROM (SELECT count(DISTINCT SK_ID_CURR) AS k FROM inst WHERE SK_ID_PREV IS NOT NULL GROUP BY SK_ID_PREV)"),
)
def _(s, d):
    return quality.dependency_violations(rolemap.installments(s, d), "SK_ID_PREV", "SK_ID_CURR")


@register(
    "functional_dependency",
    sql([], "SELECT count(*) AS key_count, count(*) FILTER (k > 1) AS violating_keys FROM (SELECT count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY l_partkey)"),
)
def _(s, d):
    return quality.dependency_violations(rolemap.table(s, d, "lineitem"), "l_partkey", "l_suppkey")


@register(
    "schedule_consistency",
    sql(["inst"], "SELECT count(*) AS schedule_groups, count(*) FILTER (dd > 1) AS due_day_conflicts, count(*) FILTER (aa > 1) AS amount_conflicts, count(*) FILTER (dd > 1 OR aa > 1) AS inconsistent_groups "
        "FROM (SELECT count(DISTINCT DAYS_INSTALMENT) AS dd, count(DISTINCT AMT_INSTALMENT) AS aa FROM inst GROUP BY SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER)"),
)
def _(s, d):
    return quality.schedule_consistency(rolemap.installments(s, d))


def _coverage_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM app) AS application_customers, count(DISTINCT c.SK_ID_CURR) AS support_customers, "
        "count(DISTINCT a.SK_ID_CURR) AS matched_customers, count(DISTINCT c.SK_ID_CURR) - count(DISTINCT a.SK_ID_CURR) AS outside_customers, "
        "count(*) AS support_rows, count(a.SK_ID_CURR) AS matched_rows, count(DISTINCT a.SK_ID_CURR) / (SELECT count(*) FROM app)::DOUBLE AS coverage_rate, "
        f"count(a.SK_ID_CURR) / count(*)::DOUBLE AS matched_row_rate FROM {source} AS c LEFT JOIN app AS a USING (SK_ID_CURR)"
    ).replace("count(DISTINCT c.SK_ID_CURR)", "count(DISTINCT SK_ID_CURR)")


@register("history_coverage", sql(["app", "bureau", "inst"], _coverage_sql("bureau", "bureau") + " UNION ALL " + _coverage_sql("installments", "inst"), ["coverage_rate", "matched_row_rate"]))
def _(s, d):
    return quality.history_coverage(_app(s, d), {"bureau": rolemap.bureau(s, d), "installments": rolemap.installments(s, d)})


@register(
    "history_overlap",
    sql(["app", "bureau", "inst"], "SELECT q.coverage, ifnull(customers, 0) AS customers, ifnull(customers, 0) / (SELECT count(*) FROM app)::DOUBLE AS rate FROM (VALUES ('both'), ('bureau_only'), ('installments_only'), ('neither')) AS q(coverage) LEFT JOIN "
        "(SELECT CASE WHEN b AND i THEN 'both' WHEN b THEN 'bureau_only' WHEN i THEN 'installments_only' ELSE 'neither' END AS coverage, count(*) AS customers FROM "
        "(SELECT SK_ID_CURR IN (SELECT SK_ID_CURR FROM bureau) AS b, SK_ID_CURR IN (SELECT SK_ID_CURR FROM inst) AS i FROM app) GROUP BY 1) AS p USING (coverage)", ["rate"]),
)
def _(s, d):
    return quality.history_overlap(_app(s, d), rolemap.bureau(s, d), rolemap.installments(s, d))


def _findings_sql(table: str) -> str:
    line = "SELECT '{}' AS severity, '{}' AS code, table_name, {} AS subject, ({})::DOUBLE AS value FROM states_" + table + " WHERE {}"
    plain = "NOT starts_with(column_name, '#')"
    key, owned = TABLES[table].primary_key, raw_text.OWNED.get(table)
    parts = [
        f"SELECT severity, 'rule_violation' AS code, table_name, rule AS subject, violations::DOUBLE AS value FROM ({_rules_sql(table)}) WHERE violations > 0",
        line.format("ERROR", "infinite_numeric_value", "column_name", "infinite_count", f"{plain} AND infinite_count > 0"),
        line.format("WARNING", "high_missing_rate", "column_name", "missing_count / row_count::DOUBLE", f"{plain} AND 2 * missing_count >= row_count"),
        line.format("WARNING", "dtype_drift", "column_name", "text_count", f"{plain} AND text_count > 0 AND row_count > missing_count + text_count"),
        line.format("WARNING", "duplicate_row", "NULL::VARCHAR", "surplus", "column_name = '#row' AND surplus > 0"),
        line.format("ERROR", "primary_key_null", f"'{key}'", "missing_count", "column_name = '#key' AND missing_count > 0"),
        line.format("ERROR", "primary_key_duplicate", f"'{key}'", "surplus", "column_name = '#key' AND surplus > 0"),
        line.format("ERROR", "previous_customer_dependency", f"'{owned}'", "conflicts", "column_name = '#owner' AND conflicts > 0"),
        line.format("ERROR", "row_count_mismatch", "NULL::VARCHAR", "row_count", f"column_name = '#row' AND row_count <> {EXPECTED_ROWS[table]}"),
    ]
    if table == "application":
        parts += [
            line.format("ERROR", "target_invalid", "'TARGET'", "missing_count + outside_count", "column_name = 'TARGET' AND missing_count + outside_count > 0"),
            line.format("INFO", "target_imbalance", "'TARGET'", "one_count / row_count::DOUBLE", "column_name = 'TARGET' AND missing_count + outside_count = 0"),
        ]
    return " UNION ALL ".join(parts)


#: Row counts a delivery is said to have; those of the given tables differ.
EXPECTED_ROWS = {"application": 307_511, "bureau": 1_716_428, "installments": 13_605_401}
_FINDINGS = " UNION ALL ".join(map(_findings_sql, RAW_TABLES)) + "".join(
    f" UNION ALL SELECT 'INFO', 'support_table_scope', '{t}', NULL, (count(DISTINCT SK_ID_CURR) FILTER (SK_ID_CURR NOT IN (SELECT SK_ID_CURR FROM raw_application WHERE SK_ID_CURR IS NOT NULL)))::DOUBLE FROM raw_{t}"
    for t in RAW_TABLES[1:])


def _findings(s: SparkSession, d: str) -> DataFrame:
    found = _each(s, d, lambda states, t, columns: raw_text.findings_of(states, t, columns, EXPECTED_ROWS[t]))
    children = {t: rolemap.raw_text(s, d, t).select(ID) for t in RAW_TABLES[1:]}
    scope = quality.scope_findings(quality.history_coverage(rolemap.raw_text(s, d, "application").select(ID), children))
    return found.unionByName(scope)


register("validation_findings", sql([*_ALL_STATES], _FINDINGS, ["value"]))(_findings)
register(
    "validation_status",
    sql([*_ALL_STATES], "SELECT count(*) AS finding_count, count(*) FILTER (severity = 'ERROR') AS error_count, count(*) FILTER (severity = 'WARNING') AS warning_count, "
        f"if(count(*) FILTER (severity = 'ERROR') > 0, 'FAIL', 'PASS') AS status FROM ({_FINDINGS})"),
)(lambda s, d: quality.validation_status(_findings(s, d)))


# --- split -----------------------------------------------------------------
register("stratified_split", sql(["split"], "SELECT SK_ID_CURR, TARGET, SPLIT FROM split"))(_split)
register("holdout_split", sql(["hold"], "SELECT SK_ID_CURR, TARGET, SPLIT FROM hold"))(
    lambda s, d: splits.holdout_split(_app(s, d), 0.1, 7)
)
register("blake_split")(
    lambda s, d: splits.stratified_split(_app(s, d), key=splits.blake_key(42, b"riskgrain"))
)
register(
    "split_summary",
    sql(["split"], "SELECT SPLIT, count(*) AS row_count, count(*) FILTER (TARGET = 0) AS target_0, count(*) FILTER (TARGET = 1) AS target_1, "
        "count(*) / (SELECT count(*) FROM split)::DOUBLE AS row_ratio, avg(TARGET) AS target_rate, avg(TARGET) - (SELECT avg(TARGET) FROM split) AS rate_difference FROM split GROUP BY SPLIT",
        ["row_ratio", "target_rate", "rate_difference"]),
)(lambda s, d: splits.split_summary(_split(s, d)))
register(
    "split_target_counts",
    sql(["split"], "SELECT q.SPLIT, t.TARGET::INTEGER AS TARGET, count(r.SK_ID_CURR) AS row_count, (SELECT count(*) FROM split AS z WHERE z.SPLIT = q.SPLIT) AS split_rows "
        "FROM (VALUES ('train'), ('validation'), ('test')) AS q(SPLIT) CROSS JOIN (VALUES (0), (1)) AS t(TARGET) LEFT JOIN split AS r ON r.SPLIT = q.SPLIT AND r.TARGET = t.TARGET GROUP BY ALL"),
)(lambda s, d: splits.split_target_counts(_split(s, d)))
register(
    "split_check",
    sql(["app", "split"], "SELECT (SELECT count(*) - count(DISTINCT SK_ID_CURR) FROM split) AS duplicate_ids, count(*) FILTER (a.SK_ID_CURR IS NULL OR s.SK_ID_CURR IS NULL) AS unmatched_ids, "
        "count(*) FILTER (a.TARGET <> s.TARGET) AS label_changes, count(*) FILTER (s.SPLIT NOT IN ('train', 'validation', 'test')) AS bad_names, "
        "(SELECT sum(abs(seen - want))::BIGINT FROM (SELECT l.t, l.part, l.to_rank - l.after_rank AS want, (SELECT count(*) FROM split AS z WHERE z.TARGET = l.t AND z.SPLIT = l.part) AS seen FROM split_limit AS l)) AS count_deviation "
        "FROM app AS a FULL JOIN split AS s ON a.SK_ID_CURR = s.SK_ID_CURR"),
)(lambda s, d: splits.check_split(_app(s, d), _split(s, d)))
register(
    "kfold_assignment",
    sql(["app"], "SELECT SK_ID_CURR, TARGET, ((row_number() OVER (PARTITION BY TARGET ORDER BY sha256('43:' || SK_ID_CURR), SK_ID_CURR) - 1) % 5 + 1)::INTEGER AS fold FROM app"),
)(lambda s, d: splits.stratified_folds(_app(s, d), 5, 43))
register(
    "assignment_digest",
    sql(["split"], "SELECT count(*) AS row_count, concat_ws('-', " + ", ".join(
        f"sum(CAST(('0x' || substr(sha256(concat_ws(',', SK_ID_CURR, TARGET, SPLIT)), {8 * k + 1}, 8)) AS BIGINT))" for k in range(8)) + ") AS digest FROM split"),
)(lambda s, d: splits.assignment_digest(_split(s, d)))

# --- profiles --------------------------------------------------------------
_LONG_APP = long_numbers("train_app", APP_NUMBERS)
_QUANTILES = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in profiling.SUMMARY_PROBS.items())
_STATS = "count(*) AS row_count, count(value) AS observed_count, count(*) - count(value) AS missing_count, count(*) FILTER (value = 0) AS zero_count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max"
_MODE = "(SELECT column_name, max(n) AS modal_count FROM (SELECT column_name, value, count(*) AS n FROM long_rows WHERE value IS NOT NULL GROUP BY ALL) GROUP BY column_name)"
ob.cte("long_rows", ("train_app",), _LONG_APP)
register(
    "numeric_summary",
    sql(["long_rows"], f"SELECT s.*, m.modal_count FROM (SELECT column_name, {_STATS}, {_QUANTILES}, count(DISTINCT value) AS unique_count FROM long_rows GROUP BY column_name) AS s JOIN {_MODE} AS m USING (column_name)",
        ["mean", "std", "min", "max", *profiling.SUMMARY_PROBS]),
)(lambda s, d: profiling.numeric_summary(_train_app(s, d), APP_NUMBERS))
register(
    "iqr_outliers",
    sql(["long_rows"], "SELECT column_name, any_value(lo) AS lower_bound, any_value(hi) AS upper_bound, count(value) AS observed_count, count(*) FILTER (value < lo OR value > hi) AS outlier_count, "
        "count(*) FILTER (value < lo OR value > hi) / count(value)::DOUBLE AS outlier_rate FROM long_rows JOIN (SELECT column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
        "(SELECT column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(DISTINCT value) AS u FROM long_rows GROUP BY column_name) WHERE u > 2) USING (column_name) WHERE value IS NOT NULL GROUP BY column_name",
        ["lower_bound", "upper_bound", "outlier_rate"]),
)(lambda s, d: profiling.iqr_outliers(_train_app(s, d), APP_NUMBERS))
register(
    "missingness_ranking",
    sql(["train_app"], "SELECT *, row_number() OVER (ORDER BY missing_rate DESC, column_name)::INTEGER AS rank FROM ("
        + ob.union_cells("train_app", APP_NUMBERS + APP_TEXT, lambda c: f"'{c}' AS column_name, count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*)::DOUBLE AS missing_rate") + ")",
        ["missing_rate"]),
)(lambda s, d: profiling.missingness(_train_app(s, d).select(*APP_NUMBERS, *APP_TEXT)))
ob.cte("long_levels", ("train_app",), f"SELECT column_name, value, count(*) AS n, sum(y)::BIGINT AS positives FROM ({long_texts('train_app', APP_TEXT, 'TARGET AS y')}) GROUP BY column_name, value")
register(
    "categorical_summary",
    sql(["long_levels"], "SELECT column_name, rk::INTEGER AS rank, ifnull(value, '(missing)') AS value_label, n, n / total::DOUBLE AS rate, gone AS missing_count, kinds AS unique_count FROM (SELECT *, "
        "row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS FIRST) AS rk, sum(n) OVER (PARTITION BY column_name) AS total, (sum(if(value IS NULL, n, 0)) OVER (PARTITION BY column_name))::BIGINT AS gone, "
        "count(value) OVER (PARTITION BY column_name) AS kinds FROM long_levels)", ["rate"]),
)(lambda s, d: profiling.categorical_summary(_train_app(s, d), APP_TEXT))

_CORR = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED", "EXT_SOURCE_2", "EXT_SOURCE_3", "CNT_FAM_MEMBERS"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]
register(
    "correlation_pairs",
    sql(["train_app"], "SELECT left_column, right_column, r AS correlation, abs(r) AS absolute_correlation, abs(r) >= 0.95 AS high FROM ("
        + " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM train_app" for a, b in _PAIRS) + ") WHERE r IS NOT NULL",
        ["correlation", "absolute_correlation"]),
)(lambda s, d: profiling.correlation_pairs(_train_app(s, d), _CORR))
_WIDE = [c for c in ob.V1_DOUBLES + ob.BUREAU_DOUBLES + ob.INST_DOUBLES if c in DERIVED_FEATURES and c not in ("APP_CREDIT_GOODS_RATIO",)]
_WIDE_PAIRS = [(a, b) for i, a in enumerate(_WIDE) for b in _WIDE[i + 1:]]
register(
    "correlation_pairs_wide",
    sql(["train"], "SELECT left_column, right_column, r AS correlation, abs(r) AS absolute_correlation, abs(r) >= 0.95 AS high FROM (SELECT unnest(cells, recursive := true) FROM (SELECT ["
        + ", ".join(f"{{'left_column': '{a}', 'right_column': '{b}', 'r': corr({a}::DOUBLE, {b}::DOUBLE)}}" for a, b in _WIDE_PAIRS) + "] AS cells FROM train)) WHERE r IS NOT NULL AND NOT isnan(r)",
        ["correlation", "absolute_correlation"]),
)(lambda s, d: profiling.correlation_pairs(_train(s, d), _WIDE))
register(
    "target_numeric",
    sql(["train_app"], "SELECT column_name, count(*) FILTER (y = 0) AS count_0, count(*) FILTER (y = 1) AS count_1, avg(value) FILTER (y = 0) AS mean_0, avg(value) FILTER (y = 1) AS mean_1, "
        "quantile_cont(value, 0.5) FILTER (y = 0) AS median_0, quantile_cont(value, 0.5) FILTER (y = 1) AS median_1, "
        "CASE WHEN min(value) <> max(value) AND min(y) <> max(y) THEN corr(value, y::DOUBLE) END AS point_biserial "
        f"FROM ({long_numbers('train_app', APP_NUMBERS, 'TARGET AS y')}) WHERE value IS NOT NULL GROUP BY column_name",
        ["mean_0", "mean_1", "median_0", "median_1", "point_biserial"]),
)(lambda s, d: profiling.target_numeric(_train_app(s, d), APP_NUMBERS))
_SUPPORT = "greatest(20, ceil((SELECT count(*) FROM train_app) * 0.001::DOUBLE))"
register(
    "target_missingness",
    sql(["train_app"], f"SELECT *, rate_missing - rate_observed AS rate_difference, least(missing_count, observed_count) >= {_SUPPORT} AS supported FROM (SELECT column_name, count(*) FILTER (value IS NULL) AS missing_count, count(value) AS observed_count, "
        f"avg(y) FILTER (value IS NULL) AS rate_missing, avg(y) FILTER (value IS NOT NULL) AS rate_observed FROM ({long_texts('train_app', APP_NUMBERS + APP_TEXT, 'TARGET AS y')}) GROUP BY column_name)", ["rate_missing", "rate_observed", "rate_difference"]),
)(lambda s, d: profiling.target_missingness(_train_app(s, d), APP_NUMBERS + APP_TEXT))
register(
    "target_category",
    sql(["long_levels", "train_app"], "SELECT column_name, level, sum(n)::BIGINT AS n, sum(positives) / sum(n)::DOUBLE AS target_rate, sum(positives) / sum(n)::DOUBLE - (SELECT avg(TARGET) FROM train_app) AS rate_difference, "
        f"sum(n) >= {_SUPPORT} AS supported "
        f"FROM (SELECT *, if(n < {_SUPPORT}, '[rare levels]', ifnull(value, '[missing]')) AS level FROM long_levels) GROUP BY column_name, level",
        ["target_rate", "rate_difference"]),
)(lambda s, d: profiling.target_category(_train_app(s, d), APP_TEXT))
register(
    "high_missing_columns",
    sql(["train_app"], "SELECT column_name, missing_count, missing_rate FROM (SELECT column_name, count(*) FILTER (value IS NULL) AS missing_count, count(*) FILTER (value IS NULL) / count(*)::DOUBLE AS missing_rate "
        f"FROM ({long_texts('train_app', APP_NUMBERS + APP_TEXT)}) GROUP BY column_name) WHERE missing_rate >= {profiling.HIGH_MISSING_SHARE}", ["missing_rate"]),
)(lambda s, d: profiling.high_missing(_train_app(s, d).select(*APP_NUMBERS, *APP_TEXT)))
register(
    "near_constant",
    sql(["train_app"], f"SELECT column_name, ifnull(value, '(missing)') AS dominant_value, n, n / total::DOUBLE AS rate FROM (SELECT *, sum(n) OVER (PARTITION BY column_name) AS total FROM (SELECT column_name, value, count(*) AS n FROM ({long_texts('train_app', ['FLAG_MOBIL', 'REGION_RATING_CLIENT', 'CNT_CHILDREN', *APP_TEXT])}) GROUP BY ALL)) WHERE n / total >= 0.99", ["rate"]),
)(lambda s, d: profiling.near_constant(_train_app(s, d), ["FLAG_MOBIL", "REGION_RATING_CLIENT", "CNT_CHILDREN", *APP_TEXT]))
register(
    "rare_categories",
    sql(["train_app"], f"SELECT column_name, value AS value_label, n, n / (SELECT count(*) FROM train_app)::DOUBLE AS rate FROM (SELECT column_name, value, count(*) AS n FROM ({long_texts('train_app', ['SK_ID_CURR', *APP_TEXT, 'CNT_CHILDREN', 'AMT_ANNUITY', 'HOUR_APPR_PROCESS_START'])}) WHERE value IS NOT NULL GROUP BY column_name, value) "
        "WHERE n <= greatest(2, ceil((SELECT count(*) FROM train_app) * 0.001::DOUBLE))", ["rate"]),
)(lambda s, d: profiling.rare_categories(_train_app(s, d), ["SK_ID_CURR", *APP_TEXT, "CNT_CHILDREN", "AMT_ANNUITY", "HOUR_APPR_PROCESS_START"]))
register(
    "known_values",
    sql(["train_app"], "SELECT observation, n, base, if(base = 0, 0, n / base::DOUBLE) AS rate FROM (SELECT 'DAYS_EMPLOYED_SENTINEL' AS observation, count(*) FILTER (DAYS_EMPLOYED = 365243) AS n, count(*) AS base FROM train_app UNION ALL "
        "SELECT 'CODE_GENDER_XNA', count(*) FILTER (CODE_GENDER = 'XNA'), count(*) FROM train_app UNION ALL SELECT 'NAME_FAMILY_STATUS_Unknown', count(*) FILTER (NAME_FAMILY_STATUS = 'Unknown'), count(*) FROM train_app UNION ALL "
        "SELECT 'OWN_CAR_AGE_MISSING_AMONG_OWNERS', count(*) FILTER (FLAG_OWN_CAR = 'Y' AND OWN_CAR_AGE IS NULL), count(*) FILTER (FLAG_OWN_CAR = 'Y') FROM train_app)", ["rate"]),
)(lambda s, d: profiling.known_values(_train_app(s, d)))

ob.cte("long_derived", ("train",), long_numbers("train", list(DERIVED_FEATURES), "TARGET AS y"))


def _family_sql() -> str:
    return (
        "CASE WHEN column_name LIKE '%\\_HAS\\_HISTORY' ESCAPE '\\' OR column_name LIKE '%\\_SENTINEL' ESCAPE '\\' OR column_name LIKE '%\\_NOT\\_APPLICABLE' ESCAPE '\\' OR column_name LIKE '%\\_MISSING' ESCAPE '\\' THEN 'binary_flag' "
        "WHEN contains(column_name, 'COUNT') THEN 'count' WHEN contains(column_name, 'RATIO') THEN 'ratio' WHEN contains(column_name, 'AMOUNT') OR contains(column_name, 'INCOME_PER') THEN 'amount' "
        "WHEN contains(column_name, 'DAYS') OR contains(column_name, 'AGE') OR contains(column_name, 'YEARS') THEN 'duration' ELSE 'continuous' END"
    )


register(
    "feature_profile",
    sql(["long_derived"], f"SELECT column_name, {_family_sql()} AS family, observed_count, row_count - observed_count AS missing_count, (row_count - observed_count) / row_count::DOUBLE AS missing_rate, unique_count, zero_count, "
        "ifnull(zero_count / nullif(observed_count, 0)::DOUBLE, 0) AS zero_rate, ifnull(modal_count / nullif(observed_count, 0)::DOUBLE, 0) AS modal_rate, mean, std, min, p1, q1, median, q3, p99, max, "
        "row_count > observed_count AS missing_indicator_candidate, coalesce(unique_count > 2 AND min >= 0 AND p99 > greatest(1, median * 10), false) AS log1p_candidate FROM "
        "(SELECT column_name, count(*) AS row_count, count(value) AS observed_count, count(DISTINCT value) AS unique_count, count(*) FILTER (value = 0) AS zero_count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, "
        "quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99 FROM long_derived GROUP BY column_name) "
        "LEFT JOIN (SELECT column_name, max(n) AS modal_count FROM (SELECT column_name, value, count(*) AS n FROM long_derived WHERE value IS NOT NULL GROUP BY ALL) GROUP BY column_name) USING (column_name)",
        ["missing_rate", "zero_rate", "modal_rate", "mean", "std", "min", "p1", "q1", "median", "q3", "p99", "max"], 4),
)(lambda s, d: rounded(profiling.feature_profile(_train(s, d), DERIVED_FEATURES), 4))
register(
    "feature_by_target",
    sql(["long_derived"], "SELECT column_name, y AS TARGET, count(*) AS row_count, count(value) AS observed_count, 1 - count(value) / count(*)::DOUBLE AS missing_rate, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM long_derived GROUP BY column_name, y",
        ["missing_rate", "mean", "median"], 4),
)(lambda s, d: rounded(profiling.feature_by_target(_train(s, d), DERIVED_FEATURES), 4))
register(
    "smd_ranking",
    sql(["long_derived"], "SELECT column_name, smd, row_number() OVER (ORDER BY round(abs(smd), 12) DESC, column_name)::INTEGER AS rank FROM (SELECT column_name, (avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0)) / nullif(stddev_samp(value), 0) AS smd FROM long_derived GROUP BY column_name) WHERE smd IS NOT NULL", ["smd"]),
)(lambda s, d: profiling.smd_ranking(_train(s, d), DERIVED_FEATURES))

# --- score evaluation ------------------------------------------------------
_EDGE = "cum_n - n < k AND k <= cum_n"
_TOP = "SELECT *, (k - (cum_n - n)) / n::DOUBLE AS w FROM"


def _grid(values: list[tuple[str, str]], name: str) -> str:
    """Curve rows joined to the capacity grid entry they contain."""
    rows = " UNION ALL ".join(f"SELECT *, {v} AS {name}, {k} AS k FROM curve" for v, k in values)
    return f"({_TOP} ({rows}) WHERE {_EDGE})"


register(
    "ranking_curve",
    sql(["curve"], "SELECT score, n, pos, neg, cum_n, cum_pos, cum_neg, tot_n, tot_pos FROM curve", ["score"]),
)(lambda s, d: _curve(s, d).select("score", "n", "pos", "neg", "cum_n", "cum_pos", "cum_neg", "tot_n", "tot_pos"))
register("binary_metrics", sql(["curve"], ob.metrics_sql("curve", [], 0.5, 0.1), ob.SCORE_METRIC_DOUBLES))(
    lambda s, d: metrics.binary_metrics(_curve(s, d))
)
register("threshold_metrics", sql(["curve"], ob.metrics_sql("curve", [], 0.9, 0.25), ob.SCORE_METRIC_DOUBLES))(
    lambda s, d: metrics.binary_metrics(_curve(s, d), threshold=0.9, top_fraction=0.25)
)
register("binary_metrics_by_group", sql(["doc_curve"], ob.metrics_sql("doc_curve", ["family"], 0.5, 0.1), ob.SCORE_METRIC_DOUBLES))(
    lambda s, d: metrics.evaluate(rolemap.document_scores(s, d), ["family"])
)
register(
    "score_contract",
    sql(["scores"], "SELECT count(*) AS row_count, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS bad_labels, count(*) FILTER (score IS NULL OR NOT isfinite(score)) AS non_finite_scores, "
        "count(*) FILTER (score NOT BETWEEN 0 AND 1) AS out_of_range_scores FROM scores"),
)(lambda s, d: metrics.score_violations(rolemap.scores(s, d)))
register(
    "roc_pr_points",
    sql(["curve"], "SELECT score AS threshold, cum_neg / tot_neg::DOUBLE AS false_positive_rate, cum_pos / tot_pos::DOUBLE AS true_positive_rate, cum_pos / cum_n::DOUBLE AS precision, cum_pos / tot_pos::DOUBLE AS recall FROM curve",
        ["threshold", "false_positive_rate", "true_positive_rate", "precision", "recall"]),
)(lambda s, d: metrics.roc_pr_points(_curve(s, d)))
_FRACTIONS = [(f"{f!r}::DOUBLE", f"greatest(1, ceil(tot_n::DOUBLE * {f!r}::DOUBLE))::BIGINT") for f in metrics.STRATEGY_FRACTIONS]
register(
    "topk_scenarios",
    sql(["curve"], "SELECT review_fraction, k AS selected_count, k / tot_n::DOUBLE AS actual_fraction, score AS cutoff_score, n AS boundary_tie_count, w AS boundary_selected_weight, hits AS true_positive_weight, hits / k AS precision, "
        "hits / tot_pos AS recall, hits / k / (tot_pos / tot_n::DOUBLE) AS lift, k - hits AS false_positive_weight, tot_pos - hits AS missed_positive_weight, k - ifnull(lag(k) OVER o, 0) AS incremental_rows, "
        f"hits - ifnull(lag(hits) OVER o, 0) AS incremental_positive_weight, (hits - ifnull(lag(hits) OVER o, 0)) / nullif(k - ifnull(lag(k) OVER o, 0), 0) AS incremental_precision FROM (SELECT *, cum_pos - pos + pos * w AS hits FROM {_grid(_FRACTIONS, 'review_fraction')}) WINDOW o AS (ORDER BY review_fraction)",
        ["review_fraction", "actual_fraction", "cutoff_score", "boundary_selected_weight", "true_positive_weight", "precision", "recall", "lift", "false_positive_weight", "missed_positive_weight", "incremental_positive_weight", "incremental_precision"]),
)(lambda s, d: metrics.topk_scenarios(_curve(s, d)))
_DECILES = [(f"{i}", f"ceil((tot_n * {i})::DOUBLE / 10)::BIGINT") for i in range(1, 11)]
register(
    "risk_deciles",
    sql(["curve"], "SELECT decile, cc AS customer_count, cc / tot_n::DOUBLE AS population_fraction, pw AS positive_weight, cc - pw AS negative_weight, ifnull(prev_cut, (SELECT max(score) FROM curve)) AS score_upper_bound, score AS score_lower_bound, "
        "sw / cc AS mean_score, pw / cc AS observed_rate, pw / cc / (tot_pos / tot_n::DOUBLE) AS lift, k AS cumulative_count, hits AS cumulative_positive_weight, hits / tot_pos AS cumulative_recall, n AS boundary_tie_count, w AS boundary_selected_weight FROM "
        "(SELECT *, k - ifnull(lag(k) OVER o, 0) AS cc, hits - ifnull(lag(hits) OVER o, 0) AS pw, ss - ifnull(lag(ss) OVER o, 0) AS sw, lag(score) OVER o AS prev_cut FROM "
        f"(SELECT *, cum_pos - pos + pos * w AS hits, cum_score - n * score + n * score * w AS ss FROM {_grid(_DECILES, 'decile')}) WINDOW o AS (ORDER BY decile))",
        ["population_fraction", "positive_weight", "negative_weight", "score_upper_bound", "score_lower_bound", "mean_score", "observed_rate", "lift", "cumulative_positive_weight", "cumulative_recall", "boundary_selected_weight"]),
)(lambda s, d: metrics.risk_deciles(_curve(s, d)))

_BINS, _EDGES = ob.calibration_sql("scores", [])
ob.cte("edges", ("scores",), _EDGES)
_BIN_DOUBLES = ["score_min", "score_max", "mean_score", "observed_rate", "absolute_gap", "weight"]
register("calibration_bins", sql(["edges"], _BINS, _BIN_DOUBLES))(lambda s, d: metrics.calibration_bins(_curve(s, d)))
_CALIBRATION = (
    "SELECT count(*) AS effective_bins, sum(customer_count)::BIGINT AS sample_count, sum(positive_count) / sum(customer_count)::DOUBLE AS prevalence, sum(weight * mean_score) AS mean_score, "
    "sum(weight * absolute_gap) AS expected_calibration_error, max(absolute_gap) AS maximum_calibration_error, (SELECT avg((score - label) * (score - label)) FROM scores) AS brier_score, "
    f"sum(weight * mean_score) - sum(positive_count) / sum(customer_count)::DOUBLE AS mean_probability_bias FROM ({_BINS})"
)
register(
    "calibration_summary",
    sql(["edges"], _CALIBRATION, ["prevalence", "mean_score", "expected_calibration_error", "maximum_calibration_error", "brier_score", "mean_probability_bias"]),
)(lambda s, d: metrics.calibration_summary(_curve(s, d)))
_CUT = "(SELECT max(score) FILTER (cum_n - n < ceil(tot_n::DOUBLE * {0}::DOUBLE) AND ceil(tot_n::DOUBLE * {0}::DOUBLE) <= cum_n) FROM curve)"
ob.cte("cuts", ("curve",), f"SELECT {_CUT.format(0.1)} AS high, {_CUT.format(0.3)} AS medium")
_LINK = ("(SELECT max(CASE WHEN band = 'high' THEN {0} END) OVER w {1} max(CASE WHEN band = 'medium' THEN {0} END) OVER w)")
register(
    "risk_bands",
    sql(["scores", "cuts"], "SELECT band, row_count, row_count / nn AS population_fraction, positive_count, positive_count / pp AS positive_share, mean_score, observed_rate, mean_score - observed_rate AS calibration_gap, observed_rate / (pp / nn) AS lift, "
        "score_min, score_max, high AS high_cutoff, medium AS medium_cutoff, oh > om AND om > ol AS observed_descends, sh > sm AND sm > sl AS score_descends, oh / nullif(ol, 0) AS high_low_ratio FROM (SELECT *, "
        + ", ".join(f"max(CASE WHEN band = '{b}' THEN {c} END) OVER () AS {a}{b[0]}" for a, c in (("o", "observed_rate"), ("s", "mean_score")) for b in ("high", "medium", "low"))
        + " FROM (SELECT CASE WHEN score >= high THEN 'high' WHEN score >= medium THEN 'medium' ELSE 'low' END AS band, count(*) AS row_count, (SELECT count(*) FROM scores)::DOUBLE AS nn, (SELECT sum(label) FROM scores)::DOUBLE AS pp, "
        "sum(label)::BIGINT AS positive_count, avg(score) AS mean_score, avg(label) AS observed_rate, min(score) AS score_min, max(score) AS score_max, any_value(high) AS high, any_value(medium) AS medium FROM scores, cuts GROUP BY 1))",
        ["population_fraction", "positive_share", "mean_score", "observed_rate", "calibration_gap", "lift", "score_min", "score_max", "high_cutoff", "medium_cutoff", "high_low_ratio"]),
)(lambda s, d: metrics.risk_bands(_curve(s, d)))
_CLIP = "greatest(0.000001::DOUBLE, least(0.999999::DOUBLE, score))"
register("logit_clip", sql(["scores"], f"SELECT id, ln({_CLIP} / (1 - {_CLIP})) AS logit FROM scores", ["logit"]))(
    lambda s, d: rolemap.scores(s, d).select("id", logit(F.col("score")).alias("logit"))
)
register("log_loss", sql(["scores"], f"SELECT avg(-if(label = 1, ln({_CLIP}), ln(1 - {_CLIP}))) AS log_loss FROM scores", ["log_loss"]))(
    lambda s, d: metrics.log_loss(rolemap.scores(s, d))
)
register(
    "score_summary",
    sql(["doc_scores"], "SELECT family, min(score) AS minimum, avg(score) AS mean, max(score) AS maximum, stddev_pop(score) AS std, quantile_cont(score, 0.5) AS median FROM doc_scores GROUP BY family", ["minimum", "mean", "maximum", "std", "median"]),
)(lambda s, d: models.score_summary(rolemap.document_scores(s, d), ["family"]))


@register(
    "metric_replay",
    sql(["scores"], "SELECT 'brier_score' AS metric, 'all' AS set_name, avg((score - label) * (score - label)) AS actual, avg((score - label) * (score - label)) + 0.01 AS expected FROM scores", ["actual", "expected"]),
)
def _(s, d):
    now = metrics.binary_metrics(_curve(s, d)).withColumn("set_name", F.lit("all"))
    recorded = now.withColumn("brier_score", F.col("brier_score") + 0.01)
    return metrics.replay_differences(now, recorded, ["set_name"], ["roc_auc", "pr_auc", "ks", "brier_score"])


# --- subgroups -------------------------------------------------------------
_GROUPS = {
    "financial_history_coverage": "CASE WHEN BUREAU_HAS_HISTORY = 1 AND INST_HAS_HISTORY = 1 THEN 'both_histories' WHEN INST_HAS_HISTORY = 1 THEN 'installments_only' WHEN BUREAU_HAS_HISTORY = 1 THEN 'bureau_only' ELSE 'neither_history' END",
    "external_score_coverage": "CASE APP_EXT_SOURCE_OBSERVED_COUNT WHEN 3 THEN 'three_scores' WHEN 2 THEN 'two_scores' ELSE 'zero_or_one_score' END",
    "age_band": "CASE WHEN APP_AGE_YEARS IS NULL THEN 'age_missing' WHEN APP_AGE_YEARS < 30 THEN 'under_30' WHEN APP_AGE_YEARS < 50 THEN 'age_30_to_49' ELSE 'age_50_plus' END",
    "gender_audit": "CASE CODE_GENDER WHEN 'F' THEN 'female_recorded' WHEN 'M' THEN 'male_recorded' ELSE 'other_or_unknown' END",
}
ob.cte(
    "groups", ("v3",),
    " UNION ALL ".join(
        f"SELECT '{f}' AS family, {e} AS group_name, SK_ID_CURR AS id, TARGET::INTEGER AS label, (SK_ID_CURR * 7919 % 1000)::DOUBLE / 1000::DOUBLE AS score FROM v3" for f, e in _GROUPS.items()
    ),
)
ob.curve_cte("group_curve", "groups", ("family", "group_name"))
_GBINS, _GEDGES = ob.calibration_sql("groups", ["family", "group_name"])
ob.cte("group_edges", ("groups",), _GEDGES)
ob.cte("group_metrics", ("group_curve",), ob.metrics_sql("group_curve", ["family", "group_name"], 0.9, 0.1))
ob.cte("all_metrics", ("curve",), ob.metrics_sql("curve", [], 0.9, 0.1))
ob.cte(
    "group_calibration", ("group_edges",),
    f"SELECT family, group_name, sum(weight * absolute_gap) AS ece FROM ({_GBINS.replace('edges AS e', 'group_edges AS e')}) GROUP BY family, group_name",
)
_SHOWN = {
    "positive_count": "m.positive_count", "negative_count": "m.negative_count", "positive_rate": "m.prevalence", "mean_score": "m.mean_score", "mean_bias": "m.mean_score - m.prevalence",
    "expected_calibration_error": "c.ece", "brier_score": "m.brier_score", "roc_auc": "m.roc_auc", "pr_auc": "m.pr_auc", "pr_auc_over_prevalence": "m.pr_auc / nullif(m.prevalence, 0)", "ks": "m.ks",
    "selected_count": "m.predicted_positive_count", "selection_rate": "m.predicted_positive_count / m.sample_count::DOUBLE", "true_positive": "m.true_positive", "false_positive": "m.false_positive",
    "recall": "m.recall", "precision": "m.precision", "top_recall": "m.top_recall", "delta_roc_auc": "m.roc_auc - a.roc_auc", "delta_brier": "m.brier_score - a.brier_score",
    "delta_recall": "m.recall - a.recall", "delta_selection_rate": "m.predicted_positive_count / m.sample_count::DOUBLE - a.predicted_positive_count / a.sample_count::DOUBLE",
}
ob.cte(
    "subgroups", ("group_metrics", "group_calibration", "all_metrics"),
    "SELECT *, CASE WHEN reliable THEN concat_ws(';', if(delta_roc_auc < -0.05, 'roc_auc_drop', NULL), if(delta_brier > 0.02, 'brier_increase', NULL), if(abs(mean_bias) > 0.03, 'absolute_calibration_bias', NULL), if(delta_recall < -0.10, 'global_cutoff_recall_drop', NULL)) ELSE '' END AS alerts FROM ("
    "SELECT m.family, m.group_name, m.sample_count AS row_count, if(m.sample_count >= 20, 'reported', 'suppressed_small_group') AS detail_status, m.sample_count >= 1000 AND m.positive_count >= 50 AND m.negative_count >= 50 AS reliable, "
    + ", ".join(f"if(m.sample_count >= 20, {e}, NULL) AS {n}" for n, e in _SHOWN.items())
    + " FROM group_metrics AS m JOIN group_calibration AS c ON m.family = c.family AND m.group_name = c.group_name, all_metrics AS a)",
)
_SUB_DOUBLES = [n for n in _SHOWN if n not in ("positive_count", "negative_count", "selected_count", "true_positive", "false_positive")]
register("subgroup_metrics", sql(["subgroups"], "SELECT * FROM subgroups", _SUB_DOUBLES))(
    lambda s, d: strategy.subgroup_metrics(_scored_mart(s, d), 0.9)
)
register(
    "subgroup_alerts",
    sql(["subgroups", "all_metrics"], " UNION ALL ".join(
        f"SELECT s.family, s.group_name, '{k}' AS alert, {v} AS observed_value, {o} AS overall_reference, {x} AS difference, {t}::DOUBLE AS trigger_threshold FROM subgroups AS s, all_metrics AS a WHERE list_contains(string_split(s.alerts, ';'), '{k}')"
        for k, v, o, x, t in (
            ("roc_auc_drop", "s.roc_auc", "a.roc_auc", "s.delta_roc_auc", -0.05), ("brier_increase", "s.brier_score", "a.brier_score", "s.delta_brier", 0.02),
            ("absolute_calibration_bias", "s.mean_bias", "0.0::DOUBLE", "s.mean_bias", 0.03), ("global_cutoff_recall_drop", "s.recall", "a.recall", "s.delta_recall", -0.10),
        )), ["observed_value", "overall_reference", "difference", "trigger_threshold"]),
)(lambda s, d: strategy.alert_rows(strategy.subgroup_metrics(_scored_mart(s, d), 0.9)))
register(
    "alert_review",
    sql(["subgroups"], "SELECT family, group_name, row_count, alerts, positive_rate * (1 - positive_rate) AS constant_brier, 1 - brier_score / nullif(positive_rate * (1 - positive_rate), 0) AS brier_skill, mean_bias, top_recall FROM subgroups WHERE detail_status = 'reported'",
        ["constant_brier", "brier_skill", "mean_bias", "top_recall"]),
)(lambda s, d: strategy.alert_review(strategy.subgroup_metrics(_scored_mart(s, d), 0.9)))
register(
    "subgroup_completeness",
    sql(["groups"], "SELECT family, count(*) AS row_count, count(*) FILTER (group_name IS NULL) AS unassigned, (SELECT count(*) FROM customer) AS total_rows FROM groups GROUP BY family"),
)(lambda s, d: strategy.completeness(_scored_mart(s, d)))
register(
    "audit_attribute_join",
    sql(["v3"], "SELECT SK_ID_CURR, SPLIT, CODE_GENDER FROM v3"),
)(lambda s, d: quality.attach_audit_attribute(_v3(s, d).select(ID, SPLIT), _app(s, d), "CODE_GENDER"))

# --- preprocessing ---------------------------------------------------------
_PREP = ["AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_FAM_MEMBERS", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "AMT_INCOME_TOTAL"]
_PREP_ROLES = FeatureRoles(tuple(_PREP), ("NAME_CONTRACT_TYPE", "CODE_GENDER", "ORGANIZATION_TYPE"))


def _fit_medians(s: SparkSession, d: str) -> tuple[dict[str, float], list[str]]:
    rows = {r["column_name"]: r for r in prep.column_medians(_train_app(s, d), _PREP).collect()}
    return {c: rows[c]["median"] or 0.0 for c in _PREP}, [c for c in _PREP if rows[c]["missing_count"] > 0]


@register(
    "column_medians",
    sql(["long_rows"], "SELECT column_name, count(value) AS observed_count, count(*) - count(value) AS missing_count, quantile_cont(value, 0.5) AS median FROM long_rows GROUP BY column_name", ["median"]),
)
def _(s, d):
    return prep.column_medians(_train_app(s, d), APP_NUMBERS)


@register(
    "impute_and_indicate",
    sql(["app", "train_app"], "SELECT SK_ID_CURR, " + ", ".join(f"ifnull({c}, (SELECT quantile_cont({c}, 0.5) FROM train_app)) AS {c}" for c in _PREP) + ", "
        + ", ".join(f"if({c} IS NULL, 1, 0)::DOUBLE AS missing_{c}" for c in _PREP[:-1]) + " FROM app", _PREP),
)
def _(s, d):
    medians, gaps = _fit_medians(s, d)
    return prep.impute(_app(s, d).select(ID, *_PREP), medians, gaps)


@register(
    "scale_no_center",
    sql(["app", "train_app"], "SELECT SK_ID_CURR, " + ", ".join(
        f"{c} / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM train_app) AS {c}" for c in ("AMT_INCOME_TOTAL", "AMT_CREDIT", "FLAG_MOBIL")) + " FROM app", ["AMT_INCOME_TOTAL", "AMT_CREDIT", "FLAG_MOBIL"]),
)
def _(s, d):
    names = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "FLAG_MOBIL"]
    scales = prep.population_scales(_train_app(s, d), names)
    return _app(s, d).select(ID, *[(F.col(c) / F.lit(scales[c])).alias(c) for c in names])


@register(
    "car_age_fill",
    sql(["v1"], "SELECT SK_ID_CURR, CASE WHEN OWN_CAR_AGE_NOT_APPLICABLE = 1 THEN 0 WHEN OWN_CAR_AGE_MISSING = 1 THEN (SELECT quantile_cont(OWN_CAR_AGE, 0.5) FROM v1 WHERE SPLIT = 'train') ELSE OWN_CAR_AGE END::DOUBLE AS OWN_CAR_AGE FROM v1", ["OWN_CAR_AGE"]),
)
def _(s, d):
    v1 = _v1(s, d)
    filled = prep.fill_car_age(v1, prep.owner_median(v1.where(F.col(SPLIT) == "train")))
    return filled.select(ID, "OWN_CAR_AGE")


@register(
    "level_shares",
    sql(["long_levels"], "SELECT column_name, ifnull(value, '__MISSING__') AS level, n, n / sum(n) OVER (PARTITION BY column_name) AS share, n / sum(n) OVER (PARTITION BY column_name) < 0.05 AND value IS NOT NULL AS is_rare FROM long_levels", ["share"]),
)
def _(s, d):
    return prep.level_shares(_train_app(s, d), APP_TEXT, 0.05)


@register(
    "rare_group",
    sql(["app", "train_app"], "SELECT a.SK_ID_CURR, CASE WHEN a.ORGANIZATION_TYPE IS NULL THEN '__MISSING__' WHEN t.n / (SELECT count(*) FROM train_app)::DOUBLE < 0.04 THEN '__RARE__' ELSE a.ORGANIZATION_TYPE END AS level FROM app AS a "
        "LEFT JOIN (SELECT ORGANIZATION_TYPE, count(*) AS n FROM train_app GROUP BY ALL) AS t ON t.ORGANIZATION_TYPE = a.ORGANIZATION_TYPE"),
)
def _(s, d):
    roles = FeatureRoles(("AMT_CREDIT",), ("ORGANIZATION_TYPE",))
    fitted = prep.fit(_train_app(s, d).select("AMT_CREDIT", "ORGANIZATION_TYPE"), roles, "tree", 0.04)
    return prep.group_levels(_app(s, d), fitted).select(ID, F.col("ORGANIZATION_TYPE").alias("level"))


def _design_sql() -> str:
    """Non-zero slots: imputed and scaled numbers, missing indicators, one-hot levels with rare ones pooled."""
    lead, parts = "SELECT SK_ID_CURR, TARGET, ", []
    for c in _PREP:
        filled = f"ifnull({c}, (SELECT quantile_cont({c}, 0.5) FROM train_app))"
        parts.append(f"{lead}'numeric__{c}' AS slot, {filled} / (SELECT coalesce(nullif(stddev_pop({filled}), 0), 1) FROM train_app) AS value FROM app")
        parts.append(f"{lead}'numeric__missingindicator_{c}', 1.0::DOUBLE FROM app WHERE {c} IS NULL AND (SELECT count(*) > count({c}) FROM train_app)")
    for c in _PREP_ROLES.categorical:
        level = f"ifnull({c}, '{prep.MISSING_LEVEL}')"
        shares = f"SELECT {level} AS level, count(*) / (SELECT count(*) FROM train_app)::DOUBLE AS share FROM train_app GROUP BY ALL"
        shown = f"CASE WHEN share < {prep.RARE_SHARE} AND level <> '{prep.MISSING_LEVEL}' THEN '{prep.RARE_LEVEL}' ELSE level END"
        parts.append(f"{lead}'categorical__{c}_' || {shown}, 1.0::DOUBLE FROM app JOIN ({shares}) AS l ON level = {level}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") AS slots WHERE value <> 0"


ob.cte("design", ("app", "train_app"), _design_sql())


def _design(s: SparkSession, d: str) -> tuple[DataFrame, prep.FittedPrep]:
    fitted = prep.fit(_train_app(s, d), _PREP_ROLES)
    return prep.design_long(prep.transform(_app(s, d), fitted, (ID, TARGET)), fitted.output_names, (ID, TARGET)), fitted


register("design_matrix", sql(["design"], "SELECT * FROM design", ["value"]))(lambda s, d: _design(s, d)[0])


@register(
    "slot_importance",
    sql(["design"], "SELECT feature, mean_abs, mean_signed, mean_abs / sum(mean_abs) OVER () AS share, row_number() OVER (ORDER BY mean_abs DESC, feature)::INTEGER AS rank FROM ("
        "SELECT slot AS feature, (sum(abs(b * (value - m))) + (n - count(*)) * abs(b * m)) / n AS mean_abs, (sum(b * (value - m)) - (n - count(*)) * b * m) / n AS mean_signed FROM "
        "(SELECT *, (SELECT count(*) FROM app)::DOUBLE AS n, 0.1 * length(slot) AS b, sum(value) OVER (PARTITION BY slot) / (SELECT count(*) FROM app) AS m FROM design) GROUP BY slot, n, b, m)",
        ["mean_abs", "mean_signed", "share"]),
)
def _(s, d):
    """Slot-level importance of a linear model whose coefficients follow from the slots' names."""
    long, _fitted = _design(s, d)
    long, n = cut_lineage(long), _app(s, d).count()
    weights = attribution.slot_means(long, n).withColumn("coefficient", F.length("slot") * F.lit(0.1))
    return attribution.slot_importance(long, weights, n)


@register("design_finite", sql(["app"], "SELECT count(*) AS row_count, count(*) FILTER (SK_ID_CURR % 103 = 0) AS non_finite_rows FROM app"))
def _(s, d):
    """Rows with an infinite income, which no imputation mends, are counted in the assembled design."""
    train, app = _train_app(s, d), _app(s, d)
    infinite = F.when(F.col(ID) % 103 == 0, F.lit(float("inf"))).otherwise(F.col("AMT_INCOME_TOTAL"))
    return prep.non_finite_rows(prep.transform(app.withColumn("AMT_INCOME_TOTAL", infinite), prep.fit(train, _PREP_ROLES), (ID,)))


# --- models ----------------------------------------------------------------
def _model_roles(s: SparkSession, d: str) -> dict[str, FeatureRoles]:
    """All model features of each mart version; only the schemas are looked at."""
    return {k: resolve_roles(mart(s, d)) for k, mart in (("v1", _v1), ("v2", _v2), ("v3", _v3))}


def _parts(s: SparkSession, d: str) -> tuple[dict[str, FeatureRoles], DataFrame, DataFrame]:
    """The roles by version, training and validation rows of the widest mart, which opens with the others' columns."""
    roles = _model_roles(s, d)
    rows = cut_lineage(_v3(s, d).select(ID, TARGET, SPLIT, *roles["v3"].features))
    return roles, rows.where(F.col(SPLIT) == "train"), rows.where(F.col(SPLIT) == "validation")


def _sealed_world(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Scores of both model parts, some customers in the wrong one, in both or of the sealed part."""
    rows = _split(s, d)
    k, part = F.col(ID), F.col(SPLIT)
    return {
        "train": rows.where((part == "train") | ((part == "validation") & (k % 37 == 0))),
        "validation": rows.where(((part == "validation") & (k % 41 != 0)) | ((part == "test") & (k % 43 == 0))).withColumn(
            TARGET, F.when(k % 47 == 0, 1 - F.col(TARGET)).otherwise(F.col(TARGET))),
    }


_SEALED = (
    "WITH t AS (SELECT * FROM split WHERE SPLIT = 'train' OR (SPLIT = 'validation' AND SK_ID_CURR % 37 = 0)), "
    "v AS (SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 47 = 0 THEN 1 - TARGET ELSE TARGET END AS TARGET, SPLIT FROM split WHERE (SPLIT = 'validation' AND SK_ID_CURR % 41 <> 0) OR (SPLIT = 'test' AND SK_ID_CURR % 43 = 0)), "
    "j AS (SELECT s.TARGET AS y, s.SPLIT AS part, t.SK_ID_CURR IS NOT NULL AS in_t, v.SK_ID_CURR IS NOT NULL AS in_v, t.TARGET AS ty, v.TARGET AS vy FROM split AS s LEFT JOIN t USING (SK_ID_CURR) LEFT JOIN v USING (SK_ID_CURR)) "
    "SELECT 'shared_ids' AS check_name, count(*) FILTER (in_t AND in_v) AS value FROM j "
    "UNION ALL SELECT 'sealed_ids', count(*) FILTER (part = 'test' AND (in_t OR in_v)) FROM j "
    "UNION ALL SELECT 'unknown_ids', 0 + count(*) FILTER (part IS NULL) FROM j "
    "UNION ALL SELECT 'label_changes', count(*) FILTER ((in_t AND ty <> y) OR (in_v AND vy <> y)) FROM j "
    "UNION ALL SELECT 'misplaced_in_train', count(*) FILTER (in_t AND part <> 'train') FROM j "
    "UNION ALL SELECT 'absent_from_train', count(*) FILTER (NOT in_t AND part = 'train') FROM j "
    "UNION ALL SELECT 'misplaced_in_validation', count(*) FILTER (in_v AND part <> 'validation') FROM j "
    "UNION ALL SELECT 'absent_from_validation', count(*) FILTER (NOT in_v AND part = 'validation') FROM j"
)
register("sealed_parts", sql(["split"], "SELECT check_name, value FROM (" + _SEALED + ")"))(lambda s, d: splits.part_reconciliation(_sealed_world(s, d), _split(s, d)))


@register(
    "version_alignment",
    sql(["v3"], "SELECT q.pair, (SELECT count(*) FROM v1) AS row_count, 0::BIGINT + CASE q.pair WHEN 'v1_v2' THEN (SELECT count(*) FROM v1 FULL JOIN v2 USING (SK_ID_CURR) WHERE v1.SPLIT IS NULL OR v2.SPLIT IS NULL) ELSE (SELECT count(*) FROM v2 FULL JOIN v3 USING (SK_ID_CURR) WHERE v2.SPLIT IS NULL OR v3.SPLIT IS NULL) END AS id_differences, "
        "CASE q.pair WHEN 'v1_v2' THEN (SELECT count(*) FROM v1 JOIN v2 USING (SK_ID_CURR) WHERE v1.TARGET <> v2.TARGET OR v1.SPLIT <> v2.SPLIT) ELSE (SELECT count(*) FROM v2 JOIN v3 USING (SK_ID_CURR) WHERE v2.TARGET <> v3.TARGET OR v2.SPLIT <> v3.SPLIT) END AS value_differences FROM (VALUES ('v1_v2'), ('v2_v3')) AS q(pair)"),
)
def _(s, d):
    return splits.version_alignment(_chained(s, d))


@register("sealed_scores", sql(["split"], "SELECT SK_ID_CURR, TARGET, SPLIT, CAST((SK_ID_CURR * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM split WHERE SPLIT IN ('train', 'validation')", ["score"]))
def _(s, d):
    """Scores of the model parts; a row of the sealed part would stop the job."""
    rows = _split(s, d).where(F.col(SPLIT) != "test")
    return splits.sealed(rows.withColumn("score", (F.col(ID) * 7919 % 1000).cast("double") / 1000.0))


register(
    "class_distribution",
    sql(["split"], "SELECT count(*) AS row_count, count(*) FILTER (TARGET = 0) AS negatives, count(*) FILTER (TARGET = 1) AS positives, avg(TARGET) AS positive_rate FROM split WHERE SPLIT = 'train'", ["positive_rate"]),
)(lambda s, d: models.class_distribution(_split(s, d).where(F.col(SPLIT) == "train")))


@register(
    "class_weights",
    sql(["split"], "SELECT SK_ID_CURR, (SELECT count(*) FROM split WHERE SPLIT = 'train') / (2.0::DOUBLE * (SELECT count(*) FROM split AS o WHERE o.SPLIT = 'train' AND o.TARGET = split.TARGET)) AS weight FROM split WHERE SPLIT = 'train'", ["weight"]),
)
def _(s, d):
    train = _split(s, d).where(F.col(SPLIT) == "train")
    w = models.balanced_weights(train)
    return train.select(ID, F.when(F.col(TARGET) == 1, F.lit(w[1])).otherwise(F.lit(w[0])).alias("weight"))


@register(
    "prior_scores",
    sql(["split"], "SELECT SK_ID_CURR, (SELECT avg(TARGET) FROM split WHERE SPLIT = 'train') AS score FROM split WHERE SPLIT = 'validation'", ["score"]),
)
def _(s, d):
    rows = _split(s, d)
    return models.prior_scores(rows.where(F.col(SPLIT) == "train"), rows.where(F.col(SPLIT) == "validation")).select(ID, "score")


@register("model_comparison")
def _(s, d):
    roles, train, validation = _parts(s, d)
    experiments = [models.Experiment(f"logistic_{k}", r, "linear", models.logistic()) for k, r in roles.items()]
    experiments.append(models.Experiment("forest_v3", roles["v3"], "tree", models.forest()))
    experiments += [models.Experiment(f"boosting_{k}", r, "tree", models.boosting()) for k, r in roles.items()]
    return models.compare_experiments(experiments, train, validation)


@register("logistic_oof")
def _(s, d):
    roles, train, _ = _parts(s, d)
    return models.out_of_fold(train, roles["v3"], {"logistic": models.logistic()}, 3, models.TUNING_SEED)


@register("gbt_scores")
def _(s, d):
    roles, train, validation = _parts(s, d)
    spec = models.Experiment("boosting", roles["v3"], "tree", models.boosting())
    return models.run_experiment(spec, train, validation)


@register("boosting_candidates")
def _(s, d):
    """Out-of-fold comparison of the boosting candidates under the selection guards."""
    roles, train, _ = _parts(s, d)
    fitters = {k: models.boosting(**options) for k, (_, options) in models.BOOSTING_CANDIDATES.items()}
    oof = models.out_of_fold(train, roles["v3"], fitters, models.TUNING_FOLDS, models.TUNING_SEED, "tree")
    complexity = F.create_map(*[F.lit(x) for k, (o, _) in models.BOOSTING_CANDIDATES.items() for x in (k, o)])
    scored = models.labelled(oof).withColumn("complexity", complexity[F.col("candidate")])
    return selection.candidate_checks(metrics.evaluate(scored, ["candidate", "complexity", "fold"]))


@register("source_ablation")
def _(s, d):
    roles, train, _ = _parts(s, d)
    table = models.ablation(train, roles["v3"], models.logistic(), 3)
    return selection.metric_deltas(table, "candidate", "full", ["roc_auc", "pr_auc", "brier_score"])


def _informative(s: SparkSession, d: str) -> DataFrame:
    """A score that orders the classes: half balance signal, half key noise."""
    return rolemap.table(s, d, "customer").selectExpr(
        "c_custkey AS id", "CAST(c_acctbal < 0 AS INT) AS label",
        "0.02D + CASE WHEN c_acctbal < 1500 THEN 0.2D ELSE 0D END + CAST((c_custkey * 7919) % 100 AS DOUBLE) / 1000D AS score",
    )


@register("crossfit_calibration")
def _(s, d):
    return models.crossfit_calibration(_informative(s, d)).select("id", "label", "fold", "method", "score")


@register("calibration_selection")
def _(s, d):
    fitted = models.crossfit_calibration(_informative(s, d))
    folds = fitted.groupBy("method", "fold").agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier_score"))
    totals = fitted.groupBy("method").agg(
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier_score"),
        F.avg(log_loss_term(F.col("label"), F.col("score"))).alias("log_loss"),
    )
    return selection.calibration_checks(folds, totals)


# least squares under the order: at each score the largest, over starts, of the smallest mean over ends of a block
ob.cte("fit_rows", (), "SELECT CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000 AS score, CAST(c_acctbal < 0 AS INT) AS label FROM customer WHERE c_custkey % 3 <> 0")
ob.cte("fit_scores", ("fit_rows",), "SELECT score, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY score) AS i FROM fit_rows GROUP BY score")
ob.cte("fit_sums", ("fit_scores",), "SELECT i, score, w, sum(y) OVER (ORDER BY i) AS sy, sum(w) OVER (ORDER BY i) AS sw, y FROM fit_scores")
ob.cte("fit_blocks", ("fit_sums",), "SELECT a.i AS j, b.i AS k, (b.sy - a.sy + a.y) / (b.sw - a.sw + a.w) AS m FROM fit_sums AS a JOIN fit_sums AS b ON a.i <= b.i")
ob.cte("fit_least", ("fit_blocks",), "SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM fit_blocks")
ob.cte("fit_most", ("fit_least",), "SELECT j, k, max(m) OVER (PARTITION BY k ORDER BY j) AS m FROM fit_least")
ob.cte("fit_values", ("fit_most", "fit_sums"), "SELECT score, w, round(m, 12) AS value FROM fit_most JOIN fit_sums ON fit_sums.i = k WHERE j = k")
ob.cte("fit_pools", ("fit_values",), "SELECT min(score) AS low, max(score) AS high, value, sum(w) AS weight FROM fit_values GROUP BY value")
ob.cte("fit_next", ("fit_pools",), "SELECT *, lead(low) OVER (ORDER BY low) AS next_low, lead(value) OVER (ORDER BY low) AS next_value, lag(low) OVER (ORDER BY low) IS NULL AS opens FROM fit_pools")


def _fitted_pools(s: SparkSession, d: str) -> DataFrame:
    return isotonic.isotonic_pools(rolemap.scores(s, d).where("id % 3 <> 0"))


register("isotonic_pools", sql(["fit_pools"], "SELECT * FROM fit_pools", ["low", "high", "value", "weight"]))(_fitted_pools)
_CALIBRATED_POLICY = {"medium_cutoff": 0.08, "high_cutoff": 0.12, "review_cutoff": 0.12}
register(
    "calibrated_batch",
    sql(["fit_next"], "SELECT id, p AS probability, CASE WHEN p >= 0.12 THEN 'high' WHEN p >= 0.08 THEN 'medium' ELSE 'low' END AS risk_band, p >= 0.12 AS priority_review FROM ("
        "SELECT id, round(CASE WHEN score > high AND next_low IS NOT NULL THEN value + (score - high) / (next_low - high) * (next_value - value) ELSE value END, 9) AS p FROM "
        "(SELECT c_custkey AS id, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM customer) AS x JOIN fit_next ON (score >= low OR opens) AND (next_low IS NULL OR score < next_low))",
        ["probability"]),
)(lambda s, d: records.apply_policy(
    # rounded before the cut-offs, as sums of another order differ in the last digits
    models.final_calibrator(rolemap.scores(s, d).where("id % 3 <> 0"), "isotonic")(rolemap.scores(s, d)).withColumn("score", F.round("score", 9)),
    _CALIBRATED_POLICY).select("id", F.col("score").alias("probability"), "risk_band", "priority_review"))

# Three score variants of each customer, evaluated by fold: the input of the selection rules.
_VARIANTS = {"baseline": (0, 7919, 0.0), "simple": (1, 104729, 0.05), "complex": (2, 31, 0.06)}


def _variants(s: SparkSession, d: str) -> DataFrame:
    customers = rolemap.table(s, d, "customer").selectExpr("c_custkey AS id", "CAST(c_acctbal < 0 AS INT) AS label", "c_acctbal")
    fold = splits.stratified_folds(customers, 3, 42, "id", "label").select("id", "fold")
    cells = [
        F.struct(
            F.lit(k).alias("candidate"), F.lit(o).alias("complexity"),
            ((F.col("id") * m % 1000).cast("double") / 2000.0 + F.when(F.col("c_acctbal") < 2000, F.lit(b)).otherwise(0.0)).alias("score"),
        )
        for k, (o, m, b) in _VARIANTS.items()
    ]
    return customers.join(fold, "id").select("id", "label", "fold", F.inline(F.array(*cells)))


ob.cte(
    "folded", (),
    "SELECT id, label, c_acctbal, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || id), id) - 1) % 3 + 1)::INTEGER AS fold "
    "FROM (SELECT c_custkey AS id, (c_acctbal < 0)::INTEGER AS label, c_acctbal FROM customer)",
)
ob.cte(
    "variants", ("folded",),
    " UNION ALL ".join(
        f"SELECT id, label, fold, '{k}' AS candidate, {o} AS complexity, (id * {m} % 1000)::DOUBLE / 2000::DOUBLE + if(c_acctbal < 2000, {b!r}, 0.0)::DOUBLE AS score FROM folded" for k, (o, m, b) in _VARIANTS.items()
    ),
)
ob.curve_cte("variant_curve", "variants", ("candidate", "complexity", "fold"))
ob.cte("fold_metrics", ("variant_curve",), ob.metrics_sql("variant_curve", ["candidate", "complexity", "fold"], 0.5, 0.1))


def _fold_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(_variants(s, d), ["candidate", "complexity", "fold"])


register(
    "fold_aggregate",
    sql(["fold_metrics"], " UNION ALL ".join(
        f"SELECT candidate, '{m}' AS metric, avg({m}) AS mean, stddev_pop({m}) AS std, min({m}) AS minimum, max({m}) AS maximum FROM fold_metrics GROUP BY candidate" for m in selection.FOLD_METRICS
    ), ["mean", "std", "minimum", "maximum"]),
)(lambda s, d: selection.fold_aggregate(_fold_metrics(s, d), ["candidate"]))
_DELTA = "avg({0}) - (SELECT avg({0}) FROM fold_metrics WHERE candidate = 'baseline')"
register(
    "candidate_selection",
    sql(["fold_metrics"], "SELECT candidate, complexity, pr_auc, pr_auc_delta, roc_auc_delta, recall_delta, winning_folds, eligible, CASE WHEN bool_or(near) OVER () THEN near AND row_number() OVER (ORDER BY near DESC, complexity, pr_auc DESC, candidate) = 1 ELSE candidate = 'baseline' END AS selected FROM "
        "(SELECT *, eligible AND max(if(eligible, pr_auc, NULL)) OVER () - pr_auc <= 0.0005 AS near FROM (SELECT *, candidate <> 'baseline' AND pr_auc_delta >= 0.001 AND winning_folds >= 2 AND roc_auc_delta >= -0.001 AND recall_delta >= -0.005 AS eligible FROM "
        f"(SELECT f.candidate, any_value(complexity) AS complexity, avg(pr_auc) AS pr_auc, {_DELTA.format('pr_auc')} AS pr_auc_delta, {_DELTA.format('roc_auc')} AS roc_auc_delta, {_DELTA.format('top_recall')} AS recall_delta, "
        "if(f.candidate = 'baseline', NULL, count(*) FILTER (pr_auc > base)) AS winning_folds FROM fold_metrics AS f JOIN (SELECT fold, pr_auc AS base FROM fold_metrics WHERE candidate = 'baseline') AS b USING (fold) GROUP BY f.candidate)))",
        ["pr_auc", "pr_auc_delta", "roc_auc_delta", "recall_delta"]),
)(lambda s, d: selection.candidate_checks(_fold_metrics(s, d)))
ob.curve_cte("model_curve", "variants", ("candidate",))
ob.cte("model_metrics", ("model_curve",), ob.metrics_sql("model_curve", ["candidate"], 0.5, 0.1))
register(
    "metric_deltas",
    sql(["model_metrics"], "SELECT 'baseline_minus_' || m.candidate AS comparison, " + ", ".join(f"b.{m} - m.{m} AS delta_{m}" for m in ("roc_auc", "pr_auc", "brier_score")) + " FROM model_metrics AS m, model_metrics AS b WHERE b.candidate = 'baseline' AND m.candidate <> 'baseline'",
        ["delta_roc_auc", "delta_pr_auc", "delta_brier_score"]),
)(lambda s, d: selection.metric_deltas(metrics.evaluate(_variants(s, d), ["candidate"]), "candidate", "baseline", ["roc_auc", "pr_auc", "brier_score"]))
_DELTAS = ", ".join(f"x.{m} - y.{m} AS delta_{m}" for m in ("roc_auc", "pr_auc", "brier_score"))
register(
    "experiment_deltas",
    sql(["fold_metrics"], f"SELECT 'more_data' AS kind, x.candidate AS subject, x.fold || '_minus_' || y.fold AS comparison, {_DELTAS} FROM fold_metrics AS x JOIN fold_metrics AS y ON x.candidate = y.candidate AND x.fold = y.fold + 1 "
        f"UNION ALL SELECT 'other_model', x.fold::VARCHAR, x.candidate || '_minus_' || y.candidate, {_DELTAS} FROM fold_metrics AS x JOIN fold_metrics AS y ON x.fold = y.fold AND y.candidate = 'baseline' AND x.candidate <> 'baseline'",
        ["delta_roc_auc", "delta_pr_auc", "delta_brier_score"]),
)(lambda s, d: selection.experiment_deltas(_fold_metrics(s, d), "candidate", "fold", [1, 2, 3], "baseline", ["roc_auc", "pr_auc", "brier_score"]))
register(
    "model_ranking",
    sql(["model_metrics"], "SELECT candidate, pr_auc, row_number() OVER (ORDER BY pr_auc DESC, candidate)::INTEGER AS rank FROM model_metrics", ["pr_auc"]),
)(lambda s, d: selection.rank_models(metrics.evaluate(_variants(s, d), ["candidate"]).select("candidate", "pr_auc"), "candidate"))
register(
    "best_per_metric",
    sql(["model_metrics"], " UNION ALL ".join(
        f"(SELECT candidate, '{m}' AS metric, {m} AS value FROM model_metrics ORDER BY {m} {o}, candidate LIMIT 1)" for m, o in (("roc_auc", "DESC"), ("pr_auc", "DESC"), ("ks", "DESC"), ("brier_score", "ASC"))
    ), ["value"]),
)(lambda s, d: selection.best_per_metric(metrics.evaluate(_variants(s, d), ["candidate"]), "candidate", ["roc_auc", "pr_auc", "ks"], ["brier_score"]))

# --- attribution -----------------------------------------------------------
ob.cte(
    "attr", ("v3",),
    " UNION ALL ".join(
        f"SELECT SK_ID_CURR AS id, '{f}' AS feature, {f}::DOUBLE AS value, ifnull(({f}::DOUBLE - {MEANS[f]!r}::DOUBLE) * {b!r}::DOUBLE, 0.0) AS attribution FROM v3" for f, b in COEFFICIENTS.items()
    ),
)
ob.cte(
    "reviewed", ("scores",),
    "SELECT *, CASE WHEN hit AND label = 1 THEN 'captured_positive' WHEN label = 1 THEN 'missed_positive' WHEN hit THEN 'reviewed_negative' ELSE 'not_reviewed_negative' END AS error_group, min(if(hit, score, NULL)) OVER () AS cutoff_score "
    "FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) <= greatest(1, ceil(count(*) OVER () * 0.1::DOUBLE)) AS hit FROM scores)",
)


def _attr(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _scored_mart(s, d)
    return rows, attribution.linear_attribution(rows, COEFFICIENTS, MEANS)


def _with_values(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _scored_mart(s, d)
    return rows, attribution.linear_attribution(rows, COEFFICIENTS, MEANS, values=True)


register("linear_attribution", sql(["attr"], "SELECT id, feature, attribution FROM attr", ["attribution"]))(lambda s, d: _attr(s, d)[1])
_SLOT_GROUP = "CASE WHEN starts_with(feature, 'BUREAU_') THEN 'bureau' WHEN starts_with(feature, 'INST_') THEN 'installments' ELSE 'application' END"


def _slots(s: SparkSession) -> DataFrame:
    rows = [(f, attribution.source_group(f), "numeric_value") for f in COEFFICIENTS]
    return attribution.slot_table(s, rows)


register(
    "attribution_rollup",
    sql(["attr"], f"SELECT id, {_SLOT_GROUP} AS feature, sum(attribution) AS attribution FROM attr GROUP BY 1, 2", ["attribution"]),
)(lambda s, d: attribution.roll_up(_attr(s, d)[1], _slots(s)))
register("rollup_preserves_sums", sql(["attr"], f"SELECT max(abs(a.s - b.s)) <= 1e-10 AS preserved FROM (SELECT id, sum(attribution) AS s FROM attr GROUP BY id) AS a JOIN (SELECT id, sum(g) AS s FROM (SELECT id, {_SLOT_GROUP} AS f, sum(attribution) AS g FROM attr GROUP BY 1, 2) GROUP BY id) AS b USING (id)"))(
    lambda s, d: attribution.roll_up_gap((a := _attr(s, d)[1]), attribution.roll_up(a, _slots(s))).select(
        (F.col("largest_gap") <= attribution.ROLL_UP_TOLERANCE).alias("preserved")
    )
)
_IMPORTANCE = "SELECT feature, mean_abs, mean_signed, mean_abs / sum(mean_abs) OVER () AS share, row_number() OVER (ORDER BY mean_abs DESC, feature)::INTEGER AS rank FROM (SELECT feature, avg(abs(attribution)) AS mean_abs, avg(attribution) AS mean_signed FROM attr GROUP BY feature)"
register("attribution_importance", sql(["attr"], _IMPORTANCE, ["mean_abs", "mean_signed", "share"]))(lambda s, d: attribution.importance(_attr(s, d)[1]))
register(
    "group_importance",
    sql(["attr"], f"SELECT {_SLOT_GROUP} AS source_group, count(*) AS feature_count, sum(mean_abs) AS summed_mean_abs, sum(share) AS share FROM ({_IMPORTANCE}) GROUP BY 1", ["summed_mean_abs", "share"]),
)(lambda s, d: attribution.group_importance(_attr(s, d)[1], _slots(s).select("feature", F.col("source_feature").alias("source_group"))))
ob.cte("known_attr", ("attr",), "SELECT * FROM attr WHERE value IS NOT NULL")
register(
    "attribution_direction",
    sql(["attr", "known_attr"], "SELECT feature, observed_rows, missing_rows, rho AS spearman, top_minus_bottom, CASE WHEN rho >= 0.1 THEN 'higher_values_tend_to_raise_risk_score' WHEN rho <= -0.1 THEN 'higher_values_tend_to_lower_risk_score' ELSE 'weak_or_non_monotonic_relationship' END AS direction FROM "
        "(SELECT feature, count(value) AS observed_rows, count(*) - count(value) AS missing_rows FROM attr GROUP BY feature) JOIN "
        "(SELECT feature, corr(rx, ry) AS rho FROM (SELECT feature, avg(px) OVER (PARTITION BY feature, value) AS rx, avg(py) OVER (PARTITION BY feature, attribution) AS ry FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) AS px, row_number() OVER (PARTITION BY feature ORDER BY attribution) AS py FROM known_attr)) GROUP BY feature) USING (feature) JOIN "
        "(SELECT feature, avg(attribution) FILTER (value >= hi) - avg(attribution) FILTER (value <= lo) AS top_minus_bottom FROM known_attr JOIN (SELECT feature, quantile_cont(value, 0.2) AS lo, quantile_cont(value, 0.8) AS hi FROM known_attr GROUP BY feature) USING (feature) GROUP BY feature) USING (feature)",
        ["spearman", "top_minus_bottom"]),
)(lambda s, d: attribution.direction(_with_values(s, d)[1]))
register("exact_top_k", sql(["reviewed"], "SELECT id, label, score, hit AS reviewed, cutoff_score, error_group FROM reviewed", ["score", "cutoff_score"]))(
    lambda s, d: attribution.error_groups(rolemap.scores(s, d))
)
register(
    "error_group_summary",
    sql(["reviewed"], "SELECT error_group, count(*) AS row_count, avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score FROM reviewed GROUP BY error_group", ["mean_score", "median_score"]),
)(lambda s, d: attribution.error_group_summary(attribution.error_groups(rolemap.scores(s, d))))


def _grouped(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, attributions = _attr(s, d)
    return attribution.error_groups(rows.select("id", "label", "score")), attributions


register(
    "error_group_features",
    sql(["reviewed", "attr"], "SELECT *, row_number() OVER (PARTITION BY error_group ORDER BY mean_abs DESC, feature)::INTEGER AS rank FROM (SELECT error_group, feature, avg(abs(attribution)) AS mean_abs, avg(attribution) AS mean_signed FROM attr JOIN reviewed USING (id) GROUP BY ALL)", ["mean_abs", "mean_signed"]),
)(lambda s, d: attribution.error_group_features(*_grouped(s, d)))
register(
    "captured_minus_missed",
    sql(["reviewed", "attr"], "SELECT *, row_number() OVER (ORDER BY abs(difference) DESC, feature)::INTEGER AS rank FROM (SELECT *, captured_mean - missed_mean AS difference FROM (SELECT feature, avg(attribution) FILTER (error_group = 'captured_positive') AS captured_mean, "
        "avg(attribution) FILTER (error_group = 'missed_positive') AS missed_mean FROM attr JOIN reviewed USING (id) GROUP BY feature))", ["captured_mean", "missed_mean", "difference"]),
)(lambda s, d: attribution.captured_minus_missed(*_grouped(s, d)))
@register(
    "representative_cases",
    sql(["reviewed", "attr"], "SELECT error_group, label, score, cutoff_score, reconstructed_log_odds, rk::INTEGER AS rank, feature, value AS feature_value, attribution, if(attribution > 0, 'raises_risk_score', 'lowers_risk_score') AS effect FROM (SELECT *, -2.4 + sum(attribution) OVER (PARTITION BY error_group) AS reconstructed_log_odds, "
        "row_number() OVER (PARTITION BY error_group ORDER BY abs(attribution) DESC, feature) AS rk FROM attr JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY error_group ORDER BY if(error_group = 'not_reviewed_negative', score, -score), id) AS pick FROM reviewed) WHERE pick = 1) USING (id))",
        ["score", "cutoff_score", "reconstructed_log_odds", "feature_value", "attribution"]),
)
def _(s, d):
    rows, attributions = _with_values(s, d)
    return attribution.representative_cases(attribution.error_groups(rows.select("id", "label", "score")), attributions, BASE_VALUE)




@register(
    "attribution_additivity",
    sql(["attr", "v3"], f"SELECT max(abs({BASE_VALUE!r} + a.s - r.raw)) <= 1e-5 AS holds FROM (SELECT id, sum(attribution) AS s FROM attr GROUP BY id) AS a JOIN (SELECT SK_ID_CURR AS id, {BASE_VALUE!r} + "
        + " + ".join(f"ifnull({f}::DOUBLE - {MEANS[f]!r}, 0) * {b!r}" for f, b in COEFFICIENTS.items()) + " AS raw FROM v3) AS r USING (id)"),
)
def _(s, d):
    rows, attributions = _attr(s, d)
    raw = F.lit(BASE_VALUE)
    for f, b in COEFFICIENTS.items():
        raw = raw + F.coalesce(F.col(f).cast("double") - F.lit(MEANS[f]), F.lit(0.0)) * F.lit(b)
    return attribution.additivity(attributions, rows.withColumn("raw_score", raw), BASE_VALUE).select("holds")


@register("logistic_attribution")
def _(s, d):
    """Exact attribution of a fitted logistic model, rolled up from vector slots to features."""
    roles, train, validation = _parts(s, d)
    fitted = prep.fit(train, roles["v3"])
    design = cut_lineage(prep.transform(train, fitted, (ID, TARGET)))
    model = models.logistic()(design)
    held = prep.transform(validation, fitted, (ID, TARGET))
    slots = attribution.slot_table(s, fitted.slot_sources)
    raw, _base = attribution.model_attribution(held, model, fitted.output_names, design, ID)
    return attribution.importance(attribution.roll_up(raw, slots, ID))


# --- record contract -------------------------------------------------------
_FIELDS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_EMPLOYED", "DAYS_EMPLOYED_SENTINEL", "HOUR_APPR_PROCESS_START", "CNT_FAM_MEMBERS", "FLAG_MOBIL", "OWN_CAR_AGE", "OWN_CAR_AGE_NOT_APPLICABLE", "OWN_CAR_AGE_MISSING",
           "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "APP_EXT_SOURCE_OBSERVED_COUNT", "APP_EXT_SOURCE_MEAN", "BUREAU_HAS_HISTORY", "BUREAU_RECORD_COUNT", "BUREAU_ACTIVE_RATIO", "INST_HAS_HISTORY", "INST_SCHEDULE_COUNT", "INST_LATE_RATIO"]
_BREAK = {
    "AMT_CREDIT": ("AMT_CREDIT - 60000", "DOUBLE"),
    "DAYS_EMPLOYED": ("CASE WHEN SK_ID_CURR % 77 = 0 THEN 365243 ELSE DAYS_EMPLOYED END", "DOUBLE"),
    "CNT_FAM_MEMBERS": ("CASE WHEN SK_ID_CURR % 51 = 0 THEN CNT_FAM_MEMBERS + 0.5 ELSE CNT_FAM_MEMBERS END", "DOUBLE"),
    "OWN_CAR_AGE": ("CASE WHEN SK_ID_CURR % 61 = 0 THEN 3 ELSE OWN_CAR_AGE END", "DOUBLE"),
    "APP_EXT_SOURCE_MEAN": ("CASE WHEN SK_ID_CURR % 59 = 0 THEN 0.5 ELSE APP_EXT_SOURCE_MEAN END", "DOUBLE"),
    "BUREAU_RECORD_COUNT": ("CASE WHEN SK_ID_CURR % 67 = 0 THEN NULL WHEN SK_ID_CURR % 71 = 0 THEN 0 ELSE BUREAU_RECORD_COUNT END", "BIGINT"),
    "INST_LATE_RATIO": ("CASE WHEN SK_ID_CURR % 20 = 0 THEN 0.25 ELSE INST_LATE_RATIO END", "DOUBLE"),
}
_TEXT_BREAK = "CASE WHEN SK_ID_CURR % 41 = 0 THEN '  ' WHEN SK_ID_CURR % 43 = 0 THEN '__RARE__' ELSE NAME_CONTRACT_TYPE END"
_RECORD_ID = "CASE WHEN SK_ID_CURR % 101 = 0 THEN ' ' WHEN SK_ID_CURR % 97 = 1 THEN 'twin' ELSE 'r' || SK_ID_CURR END"


def _record_columns() -> list[str]:
    out = [f"{_RECORD_ID} AS record_id", "FLAG_OWN_CAR", f"{_TEXT_BREAK} AS NAME_CONTRACT_TYPE"]
    for f in _FIELDS:
        expression, kind = _BREAK.get(f, (f, None))
        out.append(f"CAST({expression} AS {kind}) AS {f}" if kind else f)
    return out


def _records(s: SparkSession, d: str) -> DataFrame:
    return cut_lineage(_v3(s, d).selectExpr(*_record_columns()))


def _specs() -> list[records.FieldSpec]:
    return records.field_specs(_FIELDS, ["FLAG_OWN_CAR", "NAME_CONTRACT_TYPE"])


ob.cte("records", ("v3",), "SELECT " + ", ".join(_record_columns()) + " FROM v3")


def _field_sql(spec: records.FieldSpec) -> str:
    c = spec.name
    if spec.kind == "string":
        return f"CASE WHEN trim({c}) = '' OR {c} IN ('__MISSING__', '__RARE__') THEN 'CATEGORY_VALUE' END"
    gone = "'NULL_NOT_ALLOWED'" if not spec.nullable else "NULL"
    whole = f" WHEN {c} <> floor({c}) THEN 'INTEGER_REQUIRED'" if spec.kind == "integer" else ""
    return f"CASE WHEN {c} IS NULL THEN {gone} WHEN NOT {c}::DOUBLE BETWEEN {spec.minimum!r}::DOUBLE AND {spec.maximum!r}::DOUBLE THEN 'NUMERIC_RANGE'{whole} END"


_OWN_SQL = {s.name: _field_sql(s) for s in _specs()}
_MEAN_SQL = "list_avg(list_filter([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3], lambda x: x IS NOT NULL))"
_CROSS_SQL = [
    ("CAR_AGE_FLAGS", None, "OWN_CAR_AGE_NOT_APPLICABLE + OWN_CAR_AGE_MISSING + if(OWN_CAR_AGE IS NULL, 0, 1) <> 1"),
    ("CAR_OWNERSHIP_FLAGS", None, "(OWN_CAR_AGE_NOT_APPLICABLE = 1 AND FLAG_OWN_CAR <> 'N') OR (OWN_CAR_AGE_MISSING = 1 AND FLAG_OWN_CAR <> 'Y')"),
    ("EMPLOYMENT_SENTINEL", None, "DAYS_EMPLOYED = 365243 OR (DAYS_EMPLOYED_SENTINEL = 1 AND DAYS_EMPLOYED IS NOT NULL)"),
    ("EXTERNAL_SCORE_SUMMARY", None, f"APP_EXT_SOURCE_OBSERVED_COUNT <> list_count([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3]) OR ({_MEAN_SQL} IS NULL) <> (APP_EXT_SOURCE_MEAN IS NULL) OR abs({_MEAN_SQL} - APP_EXT_SOURCE_MEAN) > greatest(1e-6 * greatest(abs({_MEAN_SQL}), abs(APP_EXT_SOURCE_MEAN)), 1e-8)"),
    ("HISTORY_FLAG_COUNT", "BUREAU_RECORD_COUNT", "BUREAU_HAS_HISTORY <> if(BUREAU_RECORD_COUNT > 0, 1, 0)"),
    ("ABSENT_HISTORY_VALUES", "BUREAU_RECORD_COUNT", "BUREAU_HAS_HISTORY = 0 AND BUREAU_RECORD_COUNT <> 0"),
    ("ABSENT_HISTORY_VALUES", "BUREAU_ACTIVE_RATIO", "BUREAU_HAS_HISTORY = 0 AND BUREAU_ACTIVE_RATIO IS NOT NULL"),
    ("HISTORY_FLAG_COUNT", "INST_SCHEDULE_COUNT", "INST_HAS_HISTORY <> if(INST_SCHEDULE_COUNT > 0, 1, 0)"),
    ("ABSENT_HISTORY_VALUES", "INST_SCHEDULE_COUNT", "INST_HAS_HISTORY = 0 AND INST_SCHEDULE_COUNT <> 0"),
    ("ABSENT_HISTORY_VALUES", "INST_LATE_RATIO", "INST_HAS_HISTORY = 0 AND INST_LATE_RATIO IS NOT NULL"),
]
ob.cte("checked", ("records",), "SELECT *, trim(record_id) <> '' AND " + " AND ".join(f"({e}) IS NULL" for e in _OWN_SQL.values()) + " AS clean FROM records")
register(
    "record_errors",
    sql(["checked"], "SELECT code, field, count(*) AS row_count FROM (SELECT 'RECORD_ID' AS code, NULL::VARCHAR AS field FROM checked WHERE trim(record_id) = '' UNION ALL "
        "SELECT 'DUPLICATE_RECORD_ID', NULL FROM checked WHERE record_id IN (SELECT record_id FROM checked GROUP BY 1 HAVING count(*) > 1) UNION ALL "
        + " UNION ALL ".join(f"SELECT {e}, '{f}' FROM checked" for f, e in _OWN_SQL.items()) + " UNION ALL "
        + " UNION ALL ".join(f"SELECT '{c}', {repr(f) if f else 'NULL'} FROM checked WHERE clean AND ({e})" for c, f, e in _CROSS_SQL) + ") WHERE code IS NOT NULL GROUP BY code, field"),
)(lambda s, d: records.error_counts(records.validate_records(_records(s, d), _specs())))
_LEVELS = {"NAME_CONTRACT_TYPE": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]}
register(
    "record_warnings",
    sql(["records"], "SELECT record_id, count(*) AS row_count, sum(" + " + ".join(f"if({f} IS NULL, 1, 0)" for f in _FIELDS) + ")::BIGINT AS missing_values, count(*) FILTER (NAME_CONTRACT_TYPE NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')) AS unknown_rows FROM records GROUP BY record_id"),
)(
    lambda s, d: _records(s, d).select("record_id", *records.record_warnings(_FIELDS, _LEVELS)).groupBy("record_id").agg(
        F.count("*").alias("row_count"), F.sum("missing_values").alias("missing_values"), F.count_if(F.col("unknown_categories") != "").alias("unknown_rows")
    )
)
_POLICY = {"medium_cutoff": 0.7, "high_cutoff": 0.9, "review_cutoff": 0.9}
register(
    "scored_policy",
    sql(["scores"], "SELECT id, score, CASE WHEN score >= 0.9::DOUBLE THEN 'high' WHEN score >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS risk_band, score >= 0.9::DOUBLE AS priority_review FROM scores", ["score"]),
)(lambda s, d: records.apply_policy(rolemap.scores(s, d).select("id", "score"), _POLICY))


@register("batch_scoring")
def _(s, d):
    """Validate, score with a fitted model, apply the policy; only valid rows are scored."""
    from riskgrain.plans.build import score_batch

    roles, train, validation = _parts(s, d)
    fitted = prep.fit(train, roles["v3"])
    model = models.logistic()(cut_lineage(prep.transform(train, fitted, (ID, TARGET))))
    batch = validation.withColumn("record_id", F.concat(F.lit("r"), F.col(ID)))
    names = list(roles["v3"].features)

    def scorer(valid: DataFrame) -> DataFrame:
        return models.score(model, prep.transform(valid, fitted, ("record_id", *names)), ("record_id", *names))

    specs = records.field_specs(roles["v3"].numeric, roles["v3"].categorical)
    return score_batch(batch, specs, scorer, {"medium_cutoff": 0.08, "high_cutoff": 0.12}, strict=False)


# --- streaming -------------------------------------------------------------
_EVENT_SPECS = [records.FieldSpec("AMT_CREDIT", minimum=0.0), records.FieldSpec("EVENT_KIND", "string")]
_EVENT_VALUE = "value - 10"


def _streamed(s: SparkSession, d: str, copies: int = 1) -> DataFrame:
    """The record contract and policy over a file stream, written out by the stream and read back.

    Each event comes ``copies`` times, a minute apart; ids repeated inside the watermark are dropped.
    """
    events = s.readStream.schema("event_id bigint, event_type string, value double, ts timestamp").parquet(f"{d}/events*.parquet")
    events = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("ts", F.expr("ts + make_dt_interval(0, 0, copy)"))
    batch = events.selectExpr("CAST(event_id AS STRING) AS record_id", f"{_EVENT_VALUE} AS AMT_CREDIT", "event_type AS EVENT_KIND", "value", "ts")

    def scorer(rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", (F.col("value") - 10) / (F.col("value") + 10))

    out = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    scored = score_stream(batch, _EVENT_SPECS, scorer, {"medium_cutoff": 0.3, "high_cutoff": 0.6}, event_time="ts")
    query = scored.writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(scored.schema).parquet(f"{out}/rows")


@register(
    "stream_policy",
    "SELECT event_id::VARCHAR AS record_id, if(value - 10 < 0, 'NUMERIC_RANGE', '') AS error_codes, if(value - 10 >= 0, round((value - 10) / (value + 10), 6) + 0.0::DOUBLE, NULL) AS probability, "
    "CASE WHEN value - 10 >= 0 THEN CASE WHEN (value - 10) / (value + 10) >= 0.6::DOUBLE THEN 'high' WHEN (value - 10) / (value + 10) >= 0.3::DOUBLE THEN 'medium' ELSE 'low' END END AS risk_band, "
    "CASE WHEN value - 10 >= 0 THEN (value - 10) / (value + 10) >= 0.6::DOUBLE END AS priority_review FROM events",
)
def _(s, d):
    return _streamed(s, d)


# the same records although each id comes three times
register("stream_repeats", ORACLES["stream_policy"])(lambda s, d: _streamed(s, d, 3))
