"""Building blocks of the comparison SQL: named CTEs over the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from riskgrain.sources import rolemap

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: Sequence[str], body: str) -> None:
    CTES[name] = (tuple(needs), body)


def sql(needs: Sequence[str], final: str, doubles: Sequence[str] = (), digits: int = 6) -> str:
    """``WITH`` the needed CTEs, then ``final`` with its double columns rounded."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in CTES[name][0]:
            visit(dep)
        done.append(name)

    for n in needs:
        visit(n)
    if doubles:
        swaps = ", ".join(f"round({d}, {digits}) + 0.0::DOUBLE AS {d}" for d in doubles)
        final = f"SELECT * REPLACE ({swaps}) FROM ({final}) AS rounded_rows"
    if not done:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + final


def _duck_list(columns: dict[str, str]) -> list[str]:
    out = []
    for name, expression in columns.items():
        for source in ("o_orderdate", "l_shipdate"):
            expression = expression.replace(
                f"date_diff_days({source})",
                f"date_diff('day', DATE '{rolemap.ANCHOR_DATE}', CAST({source} AS DATE))",
            )
        out.append(rolemap.typed(name, expression, "DOUBLE"))
    return out


def _duck(columns: dict[str, str]) -> str:
    return ", ".join(_duck_list(columns))


def union_cells(source: str, columns: Sequence[str], make) -> str:
    """UNION ALL of one SELECT per column; ``make(column)`` gives the select list."""
    return " UNION ALL ".join(f"SELECT {make(c)} FROM {source}" for c in columns)


def long_numbers(source: str, columns: Sequence[str], carry: str = "") -> str:
    lead = f"{carry}, " if carry else ""
    return union_cells(source, columns, lambda c: f"{lead}'{c}' AS column_name, CAST({c} AS DOUBLE) AS value")


def long_texts(source: str, columns: Sequence[str], carry: str = "") -> str:
    lead = f"{carry}, " if carry else ""
    return union_cells(source, columns, lambda c: f"{lead}'{c}' AS column_name, CAST({c} AS VARCHAR) AS value")


# --- roles -----------------------------------------------------------------
cte(
    "app", (),
    f"SELECT {_duck(rolemap.APPLICATION_SQL)} FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
cte("bureau", (), f"SELECT {_duck(rolemap.BUREAU_SQL)} FROM orders")
cte("inst", (), f"SELECT {_duck(rolemap.INSTALLMENTS_SQL)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


# --- raw tables as text ----------------------------------------------------
_RAW_FROM = {
    "application": "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "bureau": "orders",
    "installments": "lineitem JOIN orders ON l_orderkey = o_orderkey",
}
for _name, _from in _RAW_FROM.items():
    _when, _rewritten = rolemap.REPEATED[_name]
    _plain = ", ".join(rolemap.raw_columns(_name, _duck_list(rolemap.RAW[_name]), "VARCHAR"))
    cte(
        f"raw_{_name}", (),
        f"WITH r AS (SELECT {_plain}, {_when} AS again FROM {_from}) SELECT * EXCLUDE again FROM r "
        f"UNION ALL SELECT * EXCLUDE again REPLACE ({_rewritten} || '.0' AS {_rewritten}) FROM r WHERE again",
    )


# --- split -----------------------------------------------------------------
def split_cte(name: str, seed: int, shares: Sequence[tuple[str, float]]) -> None:
    """Hamilton shares, cumulative class limits and the ranked assignment."""
    values = ", ".join(f"({i}, '{n}', {w!r}::DOUBLE)" for i, (n, w) in enumerate(shares))
    cte(f"{name}_tot", ("app",), "SELECT count(*)::DOUBLE AS n, sum(TARGET)::DOUBLE AS p FROM app")
    cte(
        f"{name}_size", (f"{name}_tot",),
        "SELECT i, part, n, p, whole + CASE WHEN row_number() OVER (ORDER BY frac DESC, i) <= n - sum(whole) OVER () "
        "THEN 1 ELSE 0 END AS part_size FROM (SELECT i, part, n, p, floor(w * n) AS whole, w * n - floor(w * n) AS frac "
        f"FROM (VALUES {values}) AS s(i, part, w), {name}_tot)",
    )
    cte(
        f"{name}_class", (f"{name}_size",),
        "SELECT i, part, part_size, whole + CASE WHEN row_number() OVER (ORDER BY frac DESC, i) <= p - sum(whole) OVER () "
        "THEN 1 ELSE 0 END AS ones FROM (SELECT *, floor(part_size / n * p) AS whole, "
        f"part_size / n * p - floor(part_size / n * p) AS frac FROM {name}_size)",
    )
    cte(
        f"{name}_limit", (f"{name}_class",),
        "SELECT t, part, sum(k) OVER (PARTITION BY t ORDER BY i) - k AS after_rank, sum(k) OVER (PARTITION BY t ORDER BY i) AS to_rank "
        f"FROM (SELECT 1 AS t, i, part, ones AS k FROM {name}_class UNION ALL SELECT 0, i, part, part_size - ones FROM {name}_class)",
    )
    cte(
        name, ("app", f"{name}_limit"),
        "SELECT r.SK_ID_CURR, r.TARGET, l.part AS SPLIT FROM (SELECT SK_ID_CURR, TARGET, row_number() OVER "
        f"(PARTITION BY TARGET ORDER BY sha256('{seed}:' || SK_ID_CURR), SK_ID_CURR) AS rk FROM app) AS r "
        f"JOIN {name}_limit AS l ON l.t = r.TARGET AND r.rk > l.after_rank AND r.rk <= l.to_rank",
    )


split_cte("split", 42, (("train", 0.70), ("validation", 0.15), ("test", 0.15)))
split_cte("hold", 7, (("fit", 0.9), ("holdout", 0.1)))

# --- V1 --------------------------------------------------------------------
_SEEN = " + ".join(f"(CASE WHEN EXT_SOURCE_{i} IS NULL THEN 0 ELSE 1 END)" for i in (1, 2, 3))
_WORK = "DAYS_EMPLOYED < 0"


def _if_positive(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


V1_SQL = {
    "DAYS_EMPLOYED": "CASE WHEN DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED::DOUBLE END",
    "DAYS_EMPLOYED_SENTINEL": "CASE WHEN DAYS_EMPLOYED IS NOT NULL THEN if(DAYS_EMPLOYED = 365243, 1, 0) END::TINYINT",
    "OWN_CAR_AGE_NOT_APPLICABLE": "if(FLAG_OWN_CAR = 'N' AND OWN_CAR_AGE IS NULL, 1, 0)::TINYINT",
    "OWN_CAR_AGE_MISSING": "if(FLAG_OWN_CAR = 'Y' AND OWN_CAR_AGE IS NULL, 1, 0)::TINYINT",
    "APP_CREDIT_INCOME_RATIO": _if_positive("AMT_CREDIT", "AMT_INCOME_TOTAL"),
    "APP_ANNUITY_INCOME_RATIO": _if_positive("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "APP_CREDIT_ANNUITY_RATIO": _if_positive("AMT_CREDIT", "AMT_ANNUITY"),
    "APP_CREDIT_GOODS_RATIO": _if_positive("AMT_GOODS_PRICE", "AMT_CREDIT"),
    "APP_INCOME_PER_FAMILY_MEMBER": _if_positive("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "APP_AGE_YEARS": "CASE WHEN DAYS_BIRTH < 0 THEN DAYS_BIRTH::DOUBLE / -365.25::DOUBLE END",
    "APP_EMPLOYED_YEARS": f"CASE WHEN {_WORK} THEN DAYS_EMPLOYED::DOUBLE / -365.25::DOUBLE END",
    "APP_EMPLOYED_AGE_RATIO": f"CASE WHEN {_WORK} AND DAYS_BIRTH < 0 THEN DAYS_EMPLOYED::DOUBLE / DAYS_BIRTH::DOUBLE END",
    "APP_EXT_SOURCE_OBSERVED_COUNT": f"({_SEEN})::TINYINT",
    "APP_EXT_SOURCE_MEAN": f"(ifnull(EXT_SOURCE_1, 0) + ifnull(EXT_SOURCE_2, 0) + ifnull(EXT_SOURCE_3, 0)) / nullif({_SEEN}, 0)",
}
_KEPT = [c for c in rolemap.APPLICATION_SQL if c not in ("SK_ID_CURR", "TARGET", "DAYS_EMPLOYED")]
cte(
    "v1", ("app", "split"),
    "SELECT a.SK_ID_CURR, a.TARGET::TINYINT AS TARGET, s.SPLIT, " + ", ".join(f"a.{c}" for c in _KEPT) + ", "
    + ", ".join(f"{e.replace('DAYS_EMPLOYED', 'a.DAYS_EMPLOYED')} AS {n}" for n, e in V1_SQL.items())
    + " FROM app AS a JOIN split AS s USING (SK_ID_CURR) WHERE a.TARGET = s.TARGET",
)
V1_DOUBLES = [c for c in _KEPT if c in rolemap.DOUBLES] + [
    n for n in V1_SQL if n == "DAYS_EMPLOYED" or (n.startswith("APP_") and not n.endswith("_COUNT"))
]

# --- V2 --------------------------------------------------------------------
_M = "CREDIT_CURRENCY = 'currency 1'"
_LATE = "(CREDIT_DAY_OVERDUE > 0 OR AMT_CREDIT_SUM_OVERDUE > 0)"
_BOTH = f"{_M} AND AMT_CREDIT_SUM IS NOT NULL AND AMT_CREDIT_SUM_DEBT IS NOT NULL"


def _n(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)::BIGINT"


def _of(function: str, value: str, condition: str = _M) -> str:
    return f"{function}(CASE WHEN {condition} THEN {value} END)"


BUREAU_AGG = {
    "RECORD_COUNT": "count(*)",
    "LOAN_COUNT": "count(DISTINCT SK_ID_BUREAU)",
    "ACTIVE_COUNT": _n("CREDIT_ACTIVE = 'Active'"),
    "CLOSED_COUNT": _n("CREDIT_ACTIVE = 'Closed'"),
    "SOLD_COUNT": _n("CREDIT_ACTIVE = 'Sold'"),
    "BAD_DEBT_COUNT": _n("CREDIT_ACTIVE = 'Bad debt'"),
    "CREDIT_TYPE_COUNT": "count(DISTINCT CREDIT_TYPE)",
    "NON_PRIMARY_CURRENCY_COUNT": _n("CREDIT_CURRENCY IS NOT NULL AND NOT " + _M),
    "OVERDUE_LOAN_COUNT": _n(_LATE),
    "ACTIVE_RATIO": _n("CREDIT_ACTIVE = 'Active'") + " / count(*)::DOUBLE",
    "OVERDUE_LOAN_RATIO": _n(_LATE) + " / count(*)::DOUBLE",
    "DAYS_CREDIT_MEAN": "avg(DAYS_CREDIT)",
    "DAYS_CREDIT_MIN": "min(DAYS_CREDIT)::DOUBLE",
    "DAYS_CREDIT_MAX": "max(DAYS_CREDIT)::DOUBLE",
    "DAYS_SINCE_RECENT_CREDIT": "-(max(DAYS_CREDIT)::DOUBLE)",
    "DAYS_OVERDUE_MEAN": "avg(CREDIT_DAY_OVERDUE)",
    "DAYS_OVERDUE_MAX": "max(CREDIT_DAY_OVERDUE)::DOUBLE",
    "PROLONG_COUNT_SUM": "sum(CNT_CREDIT_PROLONG)::DOUBLE",
    "CREDIT_AMOUNT_OBSERVED_COUNT": _of("count", "AMT_CREDIT_SUM"),
    "CREDIT_AMOUNT_SUM": _of("sum", "AMT_CREDIT_SUM"),
    "CREDIT_AMOUNT_MEAN": _of("avg", "AMT_CREDIT_SUM"),
    "CREDIT_AMOUNT_MAX": _of("max", "AMT_CREDIT_SUM"),
    "DEBT_OBSERVED_COUNT": _of("count", "AMT_CREDIT_SUM_DEBT"),
    "DEBT_SUM": _of("sum", "AMT_CREDIT_SUM_DEBT"),
    "DEBT_MEAN": _of("avg", "AMT_CREDIT_SUM_DEBT"),
    "DEBT_MAX": _of("max", "AMT_CREDIT_SUM_DEBT"),
    "OVERDUE_AMOUNT_SUM": _of("sum", "AMT_CREDIT_SUM_OVERDUE"),
    "OVERDUE_AMOUNT_MAX": _of("max", "AMT_CREDIT_SUM_OVERDUE"),
    "MAX_OVERDUE_OBSERVED_COUNT": _of("count", "AMT_CREDIT_MAX_OVERDUE"),
    "MAX_OVERDUE_AMOUNT": _of("max", "AMT_CREDIT_MAX_OVERDUE"),
    "ACTIVE_CREDIT_SUM": _of("sum", "AMT_CREDIT_SUM", f"{_M} AND CREDIT_ACTIVE = 'Active'"),
    "ACTIVE_DEBT_SUM": _of("sum", "AMT_CREDIT_SUM_DEBT", f"{_M} AND CREDIT_ACTIVE = 'Active'"),
    "DEBT_CREDIT_RATIO": _of("sum", "AMT_CREDIT_SUM_DEBT", _BOTH) + " / nullif(" + _of("sum", "AMT_CREDIT_SUM", _BOTH) + ", 0)",
    "ANNUITY_OBSERVED_COUNT": _of("count", "AMT_ANNUITY"),
    "ANNUITY_SUM": _of("sum", "AMT_ANNUITY"),
    "ANNUITY_MEAN": _of("avg", "AMT_ANNUITY"),
}
cte(
    "bagg", ("bureau", "app"),
    "SELECT SK_ID_CURR, " + ", ".join(f"{e} AS BUREAU_{n}" for n, e in BUREAU_AGG.items())
    + " FROM bureau WHERE DAYS_CREDIT_UPDATE <= 0 AND SK_ID_CURR IN (SELECT SK_ID_CURR FROM app) GROUP BY SK_ID_CURR",
)


def attached(alias: str, agg: dict[str, str], prefix: str) -> list[str]:
    out = [f"if({alias}.SK_ID_CURR IS NULL, 0, 1)::TINYINT AS {prefix}HAS_HISTORY"]
    for n in agg:
        name = prefix + n
        zero = n.endswith("_COUNT") or name == "BUREAU_PROLONG_COUNT_SUM"
        out.append(f"ifnull({alias}.{name}, 0) AS {name}" if zero else f"{alias}.{name}")
    return out


BUREAU_DOUBLES = [f"BUREAU_{n}" for n in BUREAU_AGG if not n.endswith("_COUNT")]
cte(
    "v2", ("v1", "bagg"),
    "SELECT v1.*, " + ", ".join(attached("h", BUREAU_AGG, "BUREAU_"))
    + " FROM v1 LEFT JOIN bagg AS h ON h.SK_ID_CURR = v1.SK_ID_CURR",
)

# --- V3 --------------------------------------------------------------------
_GONE = "DAYS_ENTRY_PAYMENT IS NULL OR AMT_PAYMENT IS NULL"
cte(
    "lvl0", ("inst",),
    "SELECT SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER, min(DAYS_INSTALMENT) AS DAYS_DUE, "
    "max(DAYS_ENTRY_PAYMENT) AS paid_day, max(AMT_INSTALMENT::DECIMAL(38,6)) AS SCHEDULED_AMOUNT, "
    "sum(AMT_PAYMENT::DECIMAL(38,6)) AS paid, count(*) AS PAYMENT_EVENT_COUNT, "
    f"{_n(_GONE)} AS MISSING_PAYMENT_EVENT_COUNT FROM inst GROUP BY ALL",
)
cte(
    "lvl", ("lvl0",),
    "SELECT *, if(ok, paid_day, NULL) AS DAYS_PAID_LAST, if(ok, paid, NULL) AS PAID_AMOUNT, "
    "CASE WHEN ok AND paid_day IS NOT NULL THEN CASE WHEN paid_day > DAYS_DUE THEN paid_day - DAYS_DUE ELSE 0.0::DOUBLE END END AS DAYS_LATE, "
    "CASE WHEN ok AND SCHEDULED_AMOUNT IS NOT NULL THEN CASE WHEN SCHEDULED_AMOUNT > paid THEN SCHEDULED_AMOUNT - paid ELSE 0 END END::DECIMAL(38,6) AS PAYMENT_GAP, "
    "CASE WHEN ok AND SCHEDULED_AMOUNT > 0 THEN paid::DOUBLE / SCHEDULED_AMOUNT::DOUBLE END AS PAYMENT_RATIO, "
    "CASE WHEN ok AND SCHEDULED_AMOUNT > 0 THEN if(SCHEDULED_AMOUNT - paid > 0.01, 1, 0) END::TINYINT AS IS_UNDERPAID "
    "FROM (SELECT *, MISSING_PAYMENT_EVENT_COUNT = 0 AS ok FROM lvl0)",
)
_D = "DAYS_LATE > 0"
INST_AGG = {
    "SCHEDULE_COUNT": "count(*)",
    "PREV_LOAN_COUNT": "count(DISTINCT SK_ID_PREV)",
    "PAYMENT_EVENT_COUNT": "sum(PAYMENT_EVENT_COUNT)::BIGINT",
    "PAYMENT_DATE_OBSERVED_SCHEDULE_COUNT": "count(DAYS_PAID_LAST)",
    "PAYMENT_AMOUNT_OBSERVED_SCHEDULE_COUNT": "count(PAID_AMOUNT)",
    "MISSING_PAYMENT_SCHEDULE_COUNT": _n("NOT ok"),
    "MISSING_PAYMENT_RATIO": _n("NOT ok") + " / count(*)::DOUBLE",
    "LATE_SCHEDULE_COUNT": _n(_D),
    "LATE_RATIO": _n(_D) + " / nullif(count(DAYS_LATE), 0)::DOUBLE",
    "DAYS_LATE_MEAN": "avg(DAYS_LATE)",
    "DAYS_LATE_MAX": "max(DAYS_LATE)",
    "DAYS_LATE_SUM": "sum(DAYS_LATE)",
    "UNDERPAID_SCHEDULE_COUNT": _n("IS_UNDERPAID = 1"),
    "UNDERPAID_RATIO": _n("IS_UNDERPAID = 1") + " / nullif(count(IS_UNDERPAID), 0)::DOUBLE",
    "SCHEDULED_AMOUNT_SUM": "sum(SCHEDULED_AMOUNT)::DOUBLE",
    "PAID_AMOUNT_SUM": "sum(PAID_AMOUNT)::DOUBLE",
    "PAYMENT_GAP_SUM": "sum(PAYMENT_GAP)::DOUBLE",
    "PAYMENT_GAP_MAX": "max(PAYMENT_GAP)::DOUBLE",
    "PAYMENT_RATIO": "sum(PAID_AMOUNT)::DOUBLE / nullif(" + _of("sum", "SCHEDULED_AMOUNT", "PAID_AMOUNT IS NOT NULL") + ", 0)::DOUBLE",
    "DAYS_SINCE_RECENT_DUE": "-max(DAYS_DUE)",
    "OLDEST_DUE_AGE_DAYS": "-min(DAYS_DUE)",
    "HISTORY_SPAN_DAYS": "max(DAYS_DUE) - min(DAYS_DUE)",
}
for _w in (365, 730):
    _r = f"DAYS_DUE >= -{_w}"
    INST_AGG[f"LAST_{_w}_SCHEDULE_COUNT"] = _n(_r)
    INST_AGG[f"LAST_{_w}_LATE_COUNT"] = _n(f"{_r} AND {_D}")
    INST_AGG[f"LAST_{_w}_LATE_RATIO"] = _n(f"{_r} AND {_D}") + " / nullif(" + _n(f"{_r} AND DAYS_PAID_LAST IS NOT NULL") + ", 0)::DOUBLE"
INST_DOUBLES = [f"INST_{n}" for n in INST_AGG if not n.endswith("_COUNT")]
cte(
    "iagg", ("lvl", "app"),
    "SELECT SK_ID_CURR, " + ", ".join(f"{e} AS INST_{n}" for n, e in INST_AGG.items())
    + " FROM lvl WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM app) GROUP BY SK_ID_CURR",
)
cte(
    "v3", ("v2", "iagg"),
    "SELECT v2.*, " + ", ".join(attached("h", INST_AGG, "INST_"))
    + " FROM v2 LEFT JOIN iagg AS h ON h.SK_ID_CURR = v2.SK_ID_CURR",
)
cte("train_app", ("app", "split"), "SELECT app.* FROM app JOIN split USING (SK_ID_CURR) WHERE SPLIT = 'train'")
cte("train", ("v3",), "SELECT * FROM v3 WHERE SPLIT = 'train'")

# --- scores ----------------------------------------------------------------
cte(
    "scores", (),
    "SELECT c_custkey AS id, (c_acctbal < 0)::INTEGER AS label, ((c_custkey * 7919) % 1000)::DOUBLE / 1000::DOUBLE AS score FROM customer",
)
cte(
    "doc_scores", (),
    "SELECT l.doc_id AS id, d.lang AS family, l.quality::INTEGER AS label, d.n_chars::DOUBLE / (d.n_chars::DOUBLE + 1000::DOUBLE) AS score "
    "FROM labels AS l JOIN documents AS d ON d.doc_id = l.doc_id",
)


def curve_cte(name: str, source: str, keys: Sequence[str] = ()) -> None:
    """Score curve of a score CTE: running counts by descending score."""
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    down = f"OVER ({part}ORDER BY score DESC)"
    whole = f"OVER ({part.strip()})"
    cte(
        name, (source,),
        f"SELECT *, n - pos AS neg, cum_n - cum_pos AS cum_neg, tot_n - tot_pos AS tot_neg FROM (SELECT *, "
        f"(sum(n) {down})::BIGINT AS cum_n, (sum(pos) {down})::BIGINT AS cum_pos, sum(n * score) {down} AS cum_score, "
        f"(sum(n) {whole})::BIGINT AS tot_n, (sum(pos) {whole})::BIGINT AS tot_pos "
        f"FROM (SELECT {k}score, count(*) AS n, sum(label)::BIGINT AS pos FROM {source} GROUP BY {k}score))",
    )


curve_cte("curve", "scores")
curve_cte("doc_curve", "doc_scores", ("family",))

SCORE_METRIC_DOUBLES = [
    "prevalence", "roc_auc", "pr_auc", "ks", "ks_threshold", "gini", "brier_score", "mean_score", "threshold", "recall",
    "precision", "f1", "actual_fraction", "cutoff_score", "boundary_selected_weight", "true_positive_weight",
    "top_precision", "top_recall", "top_lift",
]


def metrics_sql(curve: str, keys: Sequence[str], threshold: float, fraction: float) -> str:
    """All binary metrics over a curve CTE."""
    k = "".join(f"{x}, " for x in keys)
    kk = f"greatest(1, ceil(tot_n::DOUBLE * {fraction!r}::DOUBLE))::BIGINT"
    edge = f"cum_n - n < {kk} AND {kk} <= cum_n"
    w = f"({kk} - (cum_n - n))::DOUBLE / n"
    return (
        f"SELECT {k}sample_count, positive_count, negative_count, positive_count / sample_count::DOUBLE AS prevalence, "
        "if(two, auc, NULL) AS roc_auc, if(two, ap, NULL) AS pr_auc, if(two, gap, NULL) AS ks, if(two, gap_at, NULL) AS ks_threshold, "
        "if(two, 2 * auc - 1, NULL) AS gini, brier_score, mean_score, "
        f"{threshold!r}::DOUBLE AS threshold, negative_count - fp AS true_negative, fp AS false_positive, positive_count - tp AS false_negative, "
        "tp AS true_positive, tp + fp AS predicted_positive_count, tp / nullif(positive_count, 0)::DOUBLE AS recall, "
        "tp / nullif(tp + fp, 0)::DOUBLE AS precision, 2 * tp / nullif(tp + fp + positive_count, 0)::DOUBLE AS f1, k, "
        "k / sample_count::DOUBLE AS actual_fraction, cutoff_score, boundary_tie_count, boundary_selected_weight, true_positive_weight, "
        "true_positive_weight / k AS top_precision, true_positive_weight / nullif(positive_count, 0) AS top_recall, "
        "true_positive_weight / k / nullif(positive_count / sample_count::DOUBLE, 0) AS top_lift, "
        "concat_ws(';', if(two, NULL, 'single_class_discrimination_undefined'), if(positive_count = 0, 'no_positive_class', NULL), "
        "if(tp + fp = 0, 'no_predicted_positives', NULL), if(tp + fp + positive_count = 0, 'f1_undefined', NULL)) AS warnings "
        f"FROM (SELECT {k}max(tot_n) AS sample_count, max(tot_pos) AS positive_count, max(tot_neg) AS negative_count, "
        "max(tot_pos) > 0 AND max(tot_neg) > 0 AS two, "
        "sum(pos * ((tot_neg - cum_neg) + neg / 2.0::DOUBLE)) / nullif(max(tot_pos)::DOUBLE * max(tot_neg), 0) AS auc, "
        "sum(pos * (cum_pos / cum_n::DOUBLE)) / nullif(max(tot_pos), 0) AS ap, "
        "max(cum_pos / nullif(tot_pos, 0)::DOUBLE - cum_neg / nullif(tot_neg, 0)::DOUBLE) AS gap, "
        "arg_max(score, (cum_pos / nullif(tot_pos, 0)::DOUBLE - cum_neg / nullif(tot_neg, 0)::DOUBLE, score)) AS gap_at, "
        "sum(pos * (1 - score) * (1 - score) + neg * score * score) / max(tot_n) AS brier_score, "
        "sum(n * score) / max(tot_n) AS mean_score, "
        f"sum(if(score >= {threshold!r}::DOUBLE, pos, 0))::BIGINT AS tp, sum(if(score >= {threshold!r}::DOUBLE, neg, 0))::BIGINT AS fp, "
        f"max({kk}) AS k, max(if({edge}, score, NULL)) AS cutoff_score, max(if({edge}, n, NULL)) AS boundary_tie_count, "
        f"max(if({edge}, {w}, NULL)) AS boundary_selected_weight, "
        f"max(if({edge}, cum_pos - pos + pos * ({w}), NULL)) AS true_positive_weight "
        f"FROM {curve} {'GROUP BY ' + ', '.join(keys) if keys else ''})"
    )


def calibration_sql(source: str, keys: Sequence[str], bins: int = 10) -> str:
    """Quantile bins by explicit ranks, so that both engines interpolate alike."""
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    on = " AND ".join(f"e.{x} = s.{x}" for x in keys) or "true"
    step = 1.0 / bins
    probs = ", ".join(f"({min(1.0, i * step)!r}::DOUBLE)" for i in range(1, bins))
    return (
        "SELECT " + k + "row_number() OVER (" + part + "ORDER BY raw_bin)::INTEGER AS bin, customer_count, positive_count, score_min, score_max, "
        "mean_score, observed_rate, abs(observed_rate - mean_score) AS absolute_gap, customer_count / total::DOUBLE AS weight FROM ("
        f"SELECT {k}raw_bin, any_value(total) AS total, count(*) AS customer_count, sum(label)::BIGINT AS positive_count, min(score) AS score_min, "
        "max(score) AS score_max, sum(score) / count(*) AS mean_score, sum(label) / count(*)::DOUBLE AS observed_rate FROM ("
        f"SELECT s.*, count(*) OVER ({part.replace('BY ', 'BY ').strip()}) AS total, ifnull((SELECT count(*) FROM edges AS e WHERE {on} AND e.edge <= s.score "
        f"AND e.edge > e.lowest AND e.edge < e.highest), 0) AS raw_bin FROM {source} AS s) GROUP BY {k}raw_bin)"
    ), (
        "SELECT DISTINCT " + k + "edge, lowest, highest FROM (SELECT " + k + "p, "
        "max(if(r = floor(h), score, NULL)) + (max(if(r = ceil(h), score, NULL)) - max(if(r = floor(h), score, NULL))) * max(h - floor(h)) AS edge, "
        "any_value(lowest) AS lowest, any_value(highest) AS highest FROM (SELECT " + k + "score, p, (m - 1) * p AS h, r, lowest, highest FROM ("
        f"SELECT {k}score, row_number() OVER ({part}ORDER BY score) - 1 AS r, count(*) OVER ({part.strip()}) AS m, min(score) OVER ({part.strip()}) AS lowest, "
        f"max(score) OVER ({part.strip()}) AS highest FROM {source}), (VALUES {probs}) AS q(p)) WHERE r = floor(h) OR r = ceil(h) GROUP BY {k}p)"
    )
