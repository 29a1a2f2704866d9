"""Feature marts: applicant columns, external-credit history, payment history."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrain.functions.scalars import exact_sum, flag, ratio, ratio_if_positive
from riskgrain.schemas import (
    BUREAU_FEATURES,
    EMPLOYED_SENTINEL,
    ID,
    INSTALLMENT_FEATURES,
    PRIMARY_CURRENCY,
    REQUIRED_COLUMNS,
    SPLIT,
    TARGET,
    require_columns,
)

DAYS_PER_YEAR = 365.25
CENT = 0.01
MONEY = "decimal(38,6)"
RECENT_WINDOWS = (365, 730)


# ---------------------------------------------------------------------------
# V1: applicant
# ---------------------------------------------------------------------------
def application_mart(application: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per applicant present in both tables with the same label, plus derived columns."""
    require_columns(application, REQUIRED_COLUMNS["application"], "application")
    require_columns(splits, REQUIRED_COLUMNS["splits"], "splits")
    s = splits.select(
        F.col(ID).alias("_sid"), F.col(TARGET).alias("_starget"), F.col(SPLIT).cast("string").alias("_split")
    )
    # The label test is written as a difference so that only the id is an equi-join key: the rows
    # stay hash-partitioned by id and the two history joins reuse that layout.
    joined = application.join(
        s, (application[ID] == s["_sid"]) & (application[TARGET] - s["_starget"] == 0), "inner"
    )
    c = F.col
    employed, birth = c("DAYS_EMPLOYED"), c("DAYS_BIRTH")
    at_work = (employed < 0) & (employed != EMPLOYED_SENTINEL)
    scores = [c(f"EXT_SOURCE_{i}") for i in (1, 2, 3)]
    observed = reduce(add, [s.isNotNull().cast("int") for s in scores])
    kept = [x for x in application.columns if x not in (ID, TARGET, "DAYS_EMPLOYED")]
    return joined.select(
        c(ID).cast("bigint").alias(ID),
        c(TARGET).cast("tinyint").alias(TARGET),
        c("_split").alias(SPLIT),
        *[application[x] for x in kept],
        F.when(employed == EMPLOYED_SENTINEL, F.lit(None)).otherwise(employed.cast("double")).alias("DAYS_EMPLOYED"),
        flag(employed == EMPLOYED_SENTINEL).alias("DAYS_EMPLOYED_SENTINEL"),
        flag((c("FLAG_OWN_CAR") == "N") & c("OWN_CAR_AGE").isNull()).alias("OWN_CAR_AGE_NOT_APPLICABLE"),
        flag((c("FLAG_OWN_CAR") == "Y") & c("OWN_CAR_AGE").isNull()).alias("OWN_CAR_AGE_MISSING"),
        ratio_if_positive(c("AMT_CREDIT"), c("AMT_INCOME_TOTAL")).alias("APP_CREDIT_INCOME_RATIO"),
        ratio_if_positive(c("AMT_ANNUITY"), c("AMT_INCOME_TOTAL")).alias("APP_ANNUITY_INCOME_RATIO"),
        ratio_if_positive(c("AMT_CREDIT"), c("AMT_ANNUITY")).alias("APP_CREDIT_ANNUITY_RATIO"),
        ratio_if_positive(c("AMT_GOODS_PRICE"), c("AMT_CREDIT")).alias("APP_CREDIT_GOODS_RATIO"),
        ratio_if_positive(c("AMT_INCOME_TOTAL"), c("CNT_FAM_MEMBERS")).alias("APP_INCOME_PER_FAMILY_MEMBER"),
        F.when(birth < 0, -birth.cast("double") / DAYS_PER_YEAR).alias("APP_AGE_YEARS"),
        F.when(at_work, -employed.cast("double") / DAYS_PER_YEAR).alias("APP_EMPLOYED_YEARS"),
        F.when(at_work & (birth < 0), employed.cast("double") / birth).alias("APP_EMPLOYED_AGE_RATIO"),
        observed.cast("tinyint").alias("APP_EXT_SOURCE_OBSERVED_COUNT"),
        ratio(
            reduce(add, [F.coalesce(s.cast("double"), F.lit(0.0)) for s in scores]), observed
        ).alias("APP_EXT_SOURCE_MEAN"),
    )


# ---------------------------------------------------------------------------
# V2: external credit history
# ---------------------------------------------------------------------------
def usable_credits(bureau: DataFrame) -> DataFrame:
    """Drop credit rows whose last update lies after the application (or is unknown)."""
    return bureau.where(F.col("DAYS_CREDIT_UPDATE") <= 0)


def _distinct_per_customer(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-NULL values per customer in two partial-aggregated steps."""
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(ID, column).agg(F.lit(1).alias("_one"))
        .groupBy(ID).agg(F.count("*").alias(name))
    )


def bureau_features(bureau: DataFrame) -> DataFrame:
    """External-credit aggregate, one row per customer that has a usable credit row.

    The three branches each shuffle one pre-aggregated row per customer (or customer and value)
    and end partitioned by customer, so joining them adds no exchange. One aggregate with two
    distinct counts would instead copy every row three times before its shuffle. Means are written
    as sum / count, which share the buffers of the sums and counts that are shuffled anyway.
    """
    require_columns(bureau, REQUIRED_COLUMNS["bureau"], "bureau")
    rows = usable_credits(bureau)
    c = F.col
    in_money = c("CREDIT_CURRENCY") == PRIMARY_CURRENCY
    active = c("CREDIT_ACTIVE") == "Active"
    overdue = (c("CREDIT_DAY_OVERDUE") > 0) | (c("AMT_CREDIT_SUM_OVERDUE") > 0)
    credit, debt = c("AMT_CREDIT_SUM").cast("double"), c("AMT_CREDIT_SUM_DEBT").cast("double")
    both = in_money & credit.isNotNull() & debt.isNotNull()
    days, late = c("DAYS_CREDIT").cast("double"), c("CREDIT_DAY_OVERDUE").cast("double")
    overdue_amount, annuity = c("AMT_CREDIT_SUM_OVERDUE").cast("double"), c("AMT_ANNUITY").cast("double")
    worst = c("AMT_CREDIT_MAX_OVERDUE").cast("double")

    def money(value: Column, *conditions: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, conditions, in_money), value)

    measures = {
        "RECORD_COUNT": F.count("*"),
        "ACTIVE_COUNT": F.count_if(active),
        "CLOSED_COUNT": F.count_if(c("CREDIT_ACTIVE") == "Closed"),
        "SOLD_COUNT": F.count_if(c("CREDIT_ACTIVE") == "Sold"),
        "BAD_DEBT_COUNT": F.count_if(c("CREDIT_ACTIVE") == "Bad debt"),
        "NON_PRIMARY_CURRENCY_COUNT": F.count_if(c("CREDIT_CURRENCY") != PRIMARY_CURRENCY),
        "OVERDUE_LOAN_COUNT": F.count_if(overdue),
        "ACTIVE_RATIO": ratio(F.count_if(active), F.count("*")),
        "OVERDUE_LOAN_RATIO": ratio(F.count_if(overdue), F.count("*")),
        "DAYS_CREDIT_MEAN": F.avg(days),
        "DAYS_CREDIT_MIN": F.min(days),
        "DAYS_CREDIT_MAX": F.max(days),
        "DAYS_SINCE_RECENT_CREDIT": -F.max(days),
        "DAYS_OVERDUE_MEAN": F.avg(late),
        "DAYS_OVERDUE_MAX": F.max(late),
        "PROLONG_COUNT_SUM": F.sum(c("CNT_CREDIT_PROLONG").cast("double")),
        "CREDIT_AMOUNT_OBSERVED_COUNT": F.count(money(credit)),
        "CREDIT_AMOUNT_SUM": exact_sum(money(credit)),
        "CREDIT_AMOUNT_MEAN": ratio(exact_sum(money(credit)), F.count(money(credit))),
        "CREDIT_AMOUNT_MAX": F.max(money(credit)),
        "DEBT_OBSERVED_COUNT": F.count(money(debt)),
        "DEBT_SUM": exact_sum(money(debt)),
        "DEBT_MEAN": ratio(exact_sum(money(debt)), F.count(money(debt))),
        "DEBT_MAX": F.max(money(debt)),
        "OVERDUE_AMOUNT_SUM": exact_sum(money(overdue_amount)),
        "OVERDUE_AMOUNT_MAX": F.max(money(overdue_amount)),
        "MAX_OVERDUE_OBSERVED_COUNT": F.count(money(worst)),
        "MAX_OVERDUE_AMOUNT": F.max(money(worst)),
        "ACTIVE_CREDIT_SUM": exact_sum(money(credit, active)),
        "ACTIVE_DEBT_SUM": exact_sum(money(debt, active)),
        "DEBT_CREDIT_RATIO": ratio(exact_sum(F.when(both, debt)), exact_sum(F.when(both, credit))),
        "ANNUITY_OBSERVED_COUNT": F.count(money(annuity)),
        "ANNUITY_SUM": exact_sum(money(annuity)),
        "ANNUITY_MEAN": ratio(exact_sum(money(annuity)), F.count(money(annuity))),
    }
    main = rows.groupBy(ID).agg(*[e.alias(f"BUREAU_{n}") for n, e in measures.items()])
    loans = _distinct_per_customer(rows, "SK_ID_BUREAU", "BUREAU_LOAN_COUNT")
    kinds = _distinct_per_customer(rows, "CREDIT_TYPE", "BUREAU_CREDIT_TYPE_COUNT")
    whole = main.join(loans, ID, "left").join(kinds, ID, "left")
    counts = ("BUREAU_LOAN_COUNT", "BUREAU_CREDIT_TYPE_COUNT")
    return whole.select(
        F.col(ID).cast("bigint").alias(ID),
        *[
            F.coalesce(F.col(n), F.lit(0)).alias(n) if n in counts else F.col(n)
            for n in BUREAU_FEATURES
            if n != "BUREAU_HAS_HISTORY"
        ],
    )


# ---------------------------------------------------------------------------
# V3: payment history
# ---------------------------------------------------------------------------
SCHEDULE_KEY = (ID, "SK_ID_PREV", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER")


def installment_schedules(payments: DataFrame) -> DataFrame:
    """Payment events folded to one row per scheduled instalment, with derived lateness and gap."""
    require_columns(payments, REQUIRED_COLUMNS["installments"], "installments")
    c = F.col
    unpaired = c("DAYS_ENTRY_PAYMENT").isNull() | c("AMT_PAYMENT").isNull()
    level = payments.groupBy(*SCHEDULE_KEY).agg(
        F.min(c("DAYS_INSTALMENT").cast("double")).alias("DAYS_DUE"),
        F.max(c("DAYS_ENTRY_PAYMENT").cast("double")).alias("_paid_day"),
        F.max("AMT_INSTALMENT").alias("_planned"),
        F.sum(c("AMT_PAYMENT").cast(MONEY)).alias("_paid"),
        F.count("*").alias("PAYMENT_EVENT_COUNT"),
        F.count_if(unpaired).alias("MISSING_PAYMENT_EVENT_COUNT"),
    )
    whole = c("MISSING_PAYMENT_EVENT_COUNT") == 0
    due, paid_day, planned, paid = c("DAYS_DUE"), c("_paid_day"), c("_planned").cast(MONEY), c("_paid")
    zero = F.lit(0).cast(MONEY)
    return level.select(
        *SCHEDULE_KEY,
        "DAYS_DUE",
        planned.alias("SCHEDULED_AMOUNT"),
        "PAYMENT_EVENT_COUNT",
        "MISSING_PAYMENT_EVENT_COUNT",
        F.when(whole, paid_day).alias("DAYS_PAID_LAST"),
        F.when(whole, paid).alias("PAID_AMOUNT"),
        # greatest() skips NULLs, so the observed side is guarded first
        F.when(whole & paid_day.isNotNull(), F.greatest(paid_day - due, F.lit(0.0))).alias("DAYS_LATE"),
        F.when(whole & planned.isNotNull(), F.greatest((planned - paid).cast(MONEY), zero)).alias("PAYMENT_GAP"),
        F.when(whole & (planned > 0), paid.cast("double") / planned.cast("double")).alias("PAYMENT_RATIO"),
        F.when(whole & (planned > 0), flag((paid + F.lit(CENT).cast("decimal(3,2)")) < planned)).alias("IS_UNDERPAID"),
    )


def installment_features(payments: DataFrame) -> DataFrame:
    """Customer-level payment history.

    Two partial-aggregated steps: instalment, then customer. A customer, a loan or an instalment that
    holds a large share of the events is reduced before every shuffle. The distinct loan count is
    its own narrow branch (two columns), which keeps the wide sums out of a third shuffle; both
    branches end partitioned by customer, so their join adds no exchange.
    """
    c = F.col
    rows = installment_schedules(payments)
    missing, late = c("MISSING_PAYMENT_EVENT_COUNT") > 0, c("DAYS_LATE") > 0
    sums = {
        "schedules": F.count("*"),
        "events": F.sum("PAYMENT_EVENT_COUNT"),
        "dated": F.count("DAYS_PAID_LAST"),
        "paid_seen": F.count("PAID_AMOUNT"),
        "missing": F.count_if(missing),
        "late": F.count_if(late),
        "late_seen": F.count("DAYS_LATE"),
        "late_days": F.sum("DAYS_LATE"),
        "under": F.count_if(c("IS_UNDERPAID") == 1),
        "under_seen": F.count("IS_UNDERPAID"),
        "planned": F.sum("SCHEDULED_AMOUNT"),
        "paid": F.sum("PAID_AMOUNT"),
        "planned_seen": F.sum(F.when(c("PAID_AMOUNT").isNotNull(), c("SCHEDULED_AMOUNT"))),
        "gap": F.sum("PAYMENT_GAP"),
    }
    for days in RECENT_WINDOWS:
        recent = c("DAYS_DUE") >= -days
        sums[f"n{days}"] = F.count_if(recent)
        sums[f"late{days}"] = F.count_if(recent & late)
        sums[f"dated{days}"] = F.count_if(recent & c("DAYS_PAID_LAST").isNotNull())
    extremes = {
        "late_max": F.max("DAYS_LATE"),
        "gap_max": F.max("PAYMENT_GAP"),
        "due_max": F.max("DAYS_DUE"),
        "due_min": F.min("DAYS_DUE"),
    }
    totals = rows.groupBy(ID).agg(
        *[e.alias(n) for n, e in sums.items()], *[e.alias(n) for n, e in extremes.items()]
    )
    loans = _distinct_per_customer(payments, "SK_ID_PREV", "loans")
    customer = totals.join(loans, ID, "left").fillna(0, ["loans"])
    out = {
        "SCHEDULE_COUNT": c("schedules"),
        "PREV_LOAN_COUNT": c("loans"),
        "PAYMENT_EVENT_COUNT": c("events"),
        "PAYMENT_DATE_OBSERVED_SCHEDULE_COUNT": c("dated"),
        "PAYMENT_AMOUNT_OBSERVED_SCHEDULE_COUNT": c("paid_seen"),
        "MISSING_PAYMENT_SCHEDULE_COUNT": c("missing"),
        "MISSING_PAYMENT_RATIO": ratio(c("missing"), c("schedules")),
        "LATE_SCHEDULE_COUNT": c("late"),
        "LATE_RATIO": ratio(c("late"), c("late_seen")),
        "DAYS_LATE_MEAN": ratio(c("late_days"), c("late_seen")),
        "DAYS_LATE_MAX": c("late_max"),
        "DAYS_LATE_SUM": c("late_days"),
        "UNDERPAID_SCHEDULE_COUNT": c("under"),
        "UNDERPAID_RATIO": ratio(c("under"), c("under_seen")),
        "SCHEDULED_AMOUNT_SUM": c("planned").cast("double"),
        "PAID_AMOUNT_SUM": c("paid").cast("double"),
        "PAYMENT_GAP_SUM": c("gap").cast("double"),
        "PAYMENT_GAP_MAX": c("gap_max").cast("double"),
        "PAYMENT_RATIO": ratio(c("paid"), c("planned_seen")),
        "DAYS_SINCE_RECENT_DUE": -c("due_max"),
        "OLDEST_DUE_AGE_DAYS": -c("due_min"),
        "HISTORY_SPAN_DAYS": c("due_max") - c("due_min"),
    }
    for days in RECENT_WINDOWS:
        out[f"LAST_{days}_SCHEDULE_COUNT"] = c(f"n{days}")
        out[f"LAST_{days}_LATE_COUNT"] = c(f"late{days}")
        out[f"LAST_{days}_LATE_RATIO"] = ratio(c(f"late{days}"), c(f"dated{days}"))
    return customer.select(
        c(ID).cast("bigint").alias(ID),
        *[out[n.removeprefix("INST_")].alias(n) for n in INSTALLMENT_FEATURES if n != "INST_HAS_HISTORY"],
    )


# ---------------------------------------------------------------------------
# history attachment
# ---------------------------------------------------------------------------
def is_history_count(name: str) -> bool:
    """Columns that read 0, not NULL, where a customer has no history."""
    return name.endswith("_COUNT") or name == "BUREAU_PROLONG_COUNT_SUM"


def attach_history(mart: DataFrame, history: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Left-join a customer aggregate: presence flag, zero counts, NULL statistics.

    Customers outside the mart fall away here, after aggregation, so the child table needs no
    row-level scope join of its own.
    """
    prefix = names[0].removesuffix("HAS_HISTORY")
    present = f"_{prefix}present"
    h = history.withColumn(present, F.lit(True))
    joined = mart.join(h, ID, "left")

    def column(name: str) -> Column:
        if name == names[0]:
            return flag(F.col(present).isNotNull()).alias(name)
        if is_history_count(name):
            zero = F.lit(0.0 if name == "BUREAU_PROLONG_COUNT_SUM" else 0)
            return F.coalesce(F.col(name), zero).alias(name)
        return F.col(name)

    return joined.select(*mart.columns, *[column(n) for n in names])


def bureau_mart(v1: DataFrame, bureau: DataFrame) -> DataFrame:
    return attach_history(v1, bureau_features(bureau), BUREAU_FEATURES)


def installment_mart(v2: DataFrame, payments: DataFrame) -> DataFrame:
    return attach_history(v2, installment_features(payments), INSTALLMENT_FEATURES)


def feature_mart(
    application: DataFrame, splits: DataFrame, bureau: DataFrame, payments: DataFrame
) -> DataFrame:
    """The widest mart as one lazy plan."""
    return installment_mart(bureau_mart(application_mart(application, splits), bureau), payments)


def in_scope(child: DataFrame, application: DataFrame) -> DataFrame:
    """Child rows of customers in the application set (row level; use only where rows are needed)."""
    return child.join(application.select(ID).distinct(), ID, "left_semi")
