"""Data-quality rules, contracts, profiles and reconciliation as counted predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.functions.scalars import ratio_or_zero, semantic_type
from riskgrain.operators.features import SCHEDULE_KEY, usable_credits
from riskgrain.schemas import (
    EMPLOYED_SENTINEL,
    ID,
    SPLIT,
    SPLITS,
    TABLES,
    TARGET,
    ContractError,
    require_columns,
)


def number(df: DataFrame, column: str) -> Column:
    """The column as a double; text tokens that do not parse become NULL."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.col(column).try_cast("double")
    return F.col(column).cast("double")


def _counted(df: DataFrame, items: Sequence[tuple[Column, dict]], name: str) -> DataFrame:
    """Count every predicate in one pass, then turn the single row into one row per predicate."""
    one = df.agg(*[F.count_if(p).alias(f"_{i}") for i, (p, _) in enumerate(items)])
    cells = [
        F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], F.col(f"_{i}").alias(name))
        for i, (_, meta) in enumerate(items)
    ]
    return one.select(F.inline(F.array(*cells)))


def domain_observations(df: DataFrame, table: str) -> DataFrame:
    """Known oddities, reported but not judged."""
    n = {c: number(df, c) for c in df.columns}
    raw = F.col
    if table == "application":
        seen = {
            "days_employed_365243": n["DAYS_EMPLOYED"] == EMPLOYED_SENTINEL,
            "code_gender_xna": raw("CODE_GENDER") == "XNA",
            "family_status_unknown": raw("NAME_FAMILY_STATUS") == "Unknown",
            "own_car_age_missing_when_car_owned": (raw("FLAG_OWN_CAR") == "Y") & raw("OWN_CAR_AGE").isNull(),
        }
    elif table == "bureau":
        seen = {
            "negative_credit_sum_debt": n["AMT_CREDIT_SUM_DEBT"] < 0,
            "negative_credit_sum_limit": n["AMT_CREDIT_SUM_LIMIT"] < 0,
            "positive_days_credit_update": n["DAYS_CREDIT_UPDATE"] > 0,
            "active_with_enddate_fact": (raw("CREDIT_ACTIVE") == "Active") & raw("DAYS_ENDDATE_FACT").isNotNull(),
            "closed_without_enddate_fact": (raw("CREDIT_ACTIVE") == "Closed") & raw("DAYS_ENDDATE_FACT").isNull(),
        }
    else:
        day_gone, sum_gone = raw("DAYS_ENTRY_PAYMENT").isNull(), raw("AMT_PAYMENT").isNull()
        day, due = n["DAYS_ENTRY_PAYMENT"], n["DAYS_INSTALMENT"]
        paid, planned = n["AMT_PAYMENT"], n["AMT_INSTALMENT"]
        seen = {
            "payment_fields_both_missing": day_gone & sum_gone,
            "payment_fields_missing_mismatch": day_gone != sum_gone,
            "payment_late": day > due,
            "payment_early": day < due,
            "payment_on_time": day == due,
            "payment_below_scheduled": paid < planned,
            "payment_above_scheduled": paid > planned,
            "payment_equal_scheduled": paid == planned,
        }
    items = [(p, {"table_name": table, "observation": k}) for k, p in seen.items()]
    return _counted(df, items, "row_count")


def column_profile(df: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """Missing, blank and infinite counts and the finite range of every column, in one pass."""
    aggs, cells = [F.count("*").alias("_n")], []
    for i, column in enumerate(df.columns):
        text = isinstance(df.schema[column].dataType, T.StringType)
        raw = F.col(column)
        is_number = column not in categorical and not (text and not categorical)
        value = number(df, column)
        open_ended = value.isNotNull() & (F.abs(value) == F.lit(float("inf")))
        inside = F.when(value.isNotNull() & ~F.isnan(value) & ~open_ended, value)
        aggs += [
            F.count_if(raw.isNull()).alias(f"_m{i}"),
            (F.count_if(F.trim(raw) == "") if text else F.lit(0).cast("bigint")).alias(f"_b{i}"),
            (F.count_if(open_ended) if is_number else F.lit(0).cast("bigint")).alias(f"_i{i}"),
            (F.min(inside) if is_number else F.lit(None).cast("double")).alias(f"_lo{i}"),
            (F.max(inside) if is_number else F.lit(None).cast("double")).alias(f"_hi{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(column).alias("column_name"),
                F.lit(semantic_type(column, text and not is_number)).alias("semantic_type"),
                F.col("_n").alias("row_count"),
                F.col(f"_m{i}").alias("missing_count"),
                ratio_or_zero(F.col(f"_m{i}"), F.col("_n")).alias("missing_rate"),
                F.col(f"_b{i}").alias("blank_count"),
                F.col(f"_i{i}").alias("infinite_count"),
                F.col(f"_lo{i}").alias("min_value"),
                F.col(f"_hi{i}").alias("max_value"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def level_counts(df: DataFrame, columns: Sequence[str], carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows per (column, value); NULL stays a value of its own."""
    carry = carry or {}
    long = df.select(
        *[F.col(c).cast("string").alias(c) for c in columns], *[e.alias(f"_k_{k}") for k, e in carry.items()]
    ).unpivot([f"_k_{k}" for k in carry], list(columns), "column_name", "value")
    return long.groupBy("column_name", "value").agg(
        F.count("*").alias("n"), *[F.sum(f"_k_{k}").alias(k) for k in carry]
    )


def category_top(df: DataFrame, columns: Sequence[str], limit: int | None = None, keep_null: bool = False) -> DataFrame:
    """Values per column ranked by (count desc, value asc), with the distinct count; ``limit`` keeps the first ranks."""
    counts = level_counts(df, columns)
    if not keep_null:
        counts = counts.where(F.col("value").isNotNull())
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    top = counts.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        top = top.where(F.col("rank") <= limit)
    distinct = counts.groupBy("column_name").agg(F.count("value").alias("distinct_count"))
    return top.join(distinct, "column_name").select("column_name", "value", "n", "rank", "distinct_count")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Surplus copies of identical rows, compared by value (copies collapse before the shuffle)."""
    keys = [F.col(c) for c in df.columns]
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"),
        F.count_if(F.col("_n") > 1).alias("duplicated_groups"),
    )


def normalise_numbers(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Numbers written differently (``1`` and ``1.0``) become equal; bad tokens stay themselves."""
    out = []
    for column in df.columns:
        if column in numeric and isinstance(df.schema[column].dataType, T.StringType):
            value = F.col(column).try_cast("double")
            out.append(F.coalesce(value.cast("string"), F.col(column)).alias(column))
        else:
            out.append(F.col(column))
    return df.select(*out)


def primary_key(df: DataFrame, key: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count("*").alias("_n"))
    known = F.col(key).isNotNull()
    return per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("null_count"),
        F.count_if(known).alias("distinct_count"),
        F.coalesce(F.sum(F.when(known, F.col("_n") - 1)), F.lit(0)).alias("duplicate_count"),
    )


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Keys that map to more than one value; min/max differ exactly when two values exist."""
    per = df.where(F.col(determinant).isNotNull()).groupBy(determinant).agg(
        F.min(dependent).alias("_lo"), F.max(dependent).alias("_hi")
    )
    return per.agg(
        F.count("*").alias("key_count"), F.count_if(F.col("_lo") != F.col("_hi")).alias("violating_keys")
    )


def schedule_consistency(payments: DataFrame) -> DataFrame:
    """Instalments whose events disagree on the due day or the amount."""
    per = payments.groupBy(*SCHEDULE_KEY).agg(
        F.min("DAYS_INSTALMENT").alias("_d0"), F.max("DAYS_INSTALMENT").alias("_d1"),
        F.min("AMT_INSTALMENT").alias("_a0"), F.max("AMT_INSTALMENT").alias("_a1"),
    )
    day, amount = F.col("_d0") != F.col("_d1"), F.col("_a0") != F.col("_a1")
    return per.agg(
        F.count("*").alias("schedule_groups"),
        F.count_if(day).alias("due_day_conflicts"),
        F.count_if(amount).alias("amount_conflicts"),
        F.count_if(F.coalesce(day, F.lit(False)) | F.coalesce(amount, F.lit(False))).alias("inconsistent_groups"),
    )


# ---------------------------------------------------------------------------
# relations between tables
# ---------------------------------------------------------------------------
def _rows_per_customer(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(ID).isNotNull()).groupBy(ID).agg(F.count("*").alias(name))


def history_coverage(application: DataFrame, children: Mapping[str, DataFrame]) -> DataFrame:
    """Per child table: customers and rows inside and outside the application set.

    Each child shrinks to one row per customer before it meets the application ids.
    """
    applicants = application.select(F.col(ID)).where(F.col(ID).isNotNull()).distinct().withColumn("_in", F.lit(1))
    parts = []
    for name, child in children.items():
        joined = _rows_per_customer(child, "_rows").join(applicants, ID, "full_outer")
        c = F.col
        inside, has = c("_in").isNotNull(), c("_rows").isNotNull()
        agg = joined.agg(
            F.count_if(inside).alias("application_customers"),
            F.count_if(has).alias("support_customers"),
            F.count_if(inside & has).alias("matched_customers"),
            F.count_if(~inside & has).alias("outside_customers"),
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("support_rows"),
            F.coalesce(F.sum(F.when(inside, c("_rows"))), F.lit(0)).alias("matched_rows"),
        )
        parts.append(
            agg.select(
                F.lit(name).alias("table_name"),
                "*",
                ratio_or_zero(c("matched_customers"), c("application_customers")).alias("coverage_rate"),
                ratio_or_zero(c("matched_rows"), c("support_rows")).alias("matched_row_rate"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def history_overlap(application: DataFrame, bureau: DataFrame, payments: DataFrame) -> DataFrame:
    """Applicants by which histories they have; all four cells are reported."""
    ids = application.select(ID).where(F.col(ID).isNotNull()).distinct()
    joined = ids.join(_rows_per_customer(bureau, "_b"), ID, "left").join(
        _rows_per_customer(payments, "_i"), ID, "left"
    )
    b, i = F.col("_b").isNotNull(), F.col("_i").isNotNull()
    cells = {
        "both": b & i,
        "bureau_only": b & ~i,
        "installments_only": ~b & i,
        "neither": ~b & ~i,
    }
    one = joined.agg(F.count("*").alias("_n"), *[F.count_if(p).alias(k) for k, p in cells.items()])
    rows = [
        F.struct(
            F.lit(k).alias("coverage"), F.col(k).alias("customers"), ratio_or_zero(F.col(k), F.col("_n")).alias("rate")
        )
        for k in cells
    ]
    return one.select(F.inline(F.array(*rows)))


def reconcile(left: DataFrame, right: DataFrame, compare: Sequence[str], key: str = ID) -> DataFrame:
    """Full outer reconciliation; a comparison with NULL does not count as a difference."""
    l = left.select(F.col(key), F.lit(1).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in compare])
    r = right.select(F.col(key), F.lit(1).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in compare])
    joined = l.join(r, key, "full_outer")
    gone_l, gone_r = F.col("_l").isNull(), F.col("_r").isNull()
    differs = {c: F.coalesce(F.col(f"_l_{c}") != F.col(f"_r_{c}"), F.lit(False)) for c in compare}
    any_bad = reduce(lambda a, b: a | b, differs.values(), gone_l | gone_r)
    return joined.agg(
        F.count("*").alias("row_count"),
        F.count_if(gone_l).alias("only_right"),
        F.count_if(gone_r).alias("only_left"),
        *[F.count_if(d).alias(f"{c.lower()}_differs") for c, d in differs.items()],
        F.count_if(any_bad).alias("mismatches"),
    )


def attach_audit_attribute(rows: DataFrame, source: DataFrame, attribute: str, key: str = ID) -> DataFrame:
    """Bring in an audit-only attribute by key; key sets must be equal."""
    r = reconcile(rows, source, [], key).first()
    if r["mismatches"]:
        raise ContractError(f"audit attribute {attribute}: key sets differ by {r['mismatches']} rows")
    return rows.join(source.select(key, attribute), key)


def id_overlap(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """Sizes of the id intersection and both differences."""
    ids = left.select(key).distinct().withColumn("_l", F.lit(1)).join(
        right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer"
    )
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return ids.agg(
        F.count_if(l & r).alias("in_both"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only")
    )


def lineage_mismatches(lower: DataFrame, higher: DataFrame) -> DataFrame:
    """Rows of the lower mart that the higher mart does not carry unchanged (bag difference)."""
    return lower.exceptAll(higher.select(lower.columns)).agg(F.count("*").alias("mismatches"))


# ---------------------------------------------------------------------------
# contracts
# ---------------------------------------------------------------------------
def _long(df: DataFrame, scope: str) -> DataFrame:
    """A one-row frame of counts as (scope, check_name, value) rows."""
    cells = [
        F.struct(F.lit(scope).alias("scope"), F.lit(c).alias("check_name"), F.col(c).cast("bigint").alias("value"))
        for c in df.columns
    ]
    return df.select(F.inline(F.array(*cells)))


def _per_customer(df: DataFrame, with_split: bool, also: Sequence[Column] = ()) -> DataFrame:
    bad_target = F.col(TARGET).isNull() | ~F.col(TARGET).isin(0, 1)
    return df.groupBy(ID).agg(
        F.count("*").alias("_n"),
        F.count_if(bad_target).alias("_t"),
        *(
            [F.count_if(F.col(SPLIT).isNull() | ~F.col(SPLIT).isin(*SPLITS)).alias("_s")]
            + [F.count_if(F.col(SPLIT) == s).alias(f"_{s}") for s in SPLITS]
            if with_split
            else [F.count_if(F.col("DAYS_EMPLOYED") == EMPLOYED_SENTINEL).alias("_e")]
        ),
        *also,
    )


def _contract_sums(tag: str, with_split: bool) -> list[tuple[str, Column]]:
    """Aggregates over customers, whose columns are named after ``tag``."""
    c = lambda name: F.col(f"{tag}{name}")
    known, total = F.col(ID).isNotNull(), lambda v: F.coalesce(F.sum(v), F.lit(0))
    out = [
        ("row_count", total(c("_n"))),
        ("unique_ids", F.count_if(known & c("_n").isNotNull())),
        ("missing_ids", total(F.when(~known, c("_n")))),
        ("invalid_targets", total(c("_t"))),
    ]
    if with_split:
        filled = [F.when(total(c(f"_{s}")) > 0, 1).otherwise(0) for s in SPLITS]
        return [*out, ("invalid_splits", total(c("_s"))), ("split_names", reduce(lambda a, b: a + b, filled))]
    return [*out, ("employed_sentinel_rows", total(c("_e")))]


def _customer_contract(df: DataFrame, with_split: bool) -> DataFrame:
    return _per_customer(df, with_split).agg(*[x.alias(k) for k, x in _contract_sums("", with_split)])


def source_contract(
    application: DataFrame, splits: DataFrame, bureau: DataFrame, payments: DataFrame
) -> DataFrame:
    """Counts behind the pre-build contract of all four inputs, as (scope, check_name, value)."""
    c = F.col
    loans = bureau.groupBy("SK_ID_BUREAU").agg(
        F.count("*").alias("_n"),
        F.count_if(c(ID).isNull()).alias("_k"),
        F.count_if(c("DAYS_CREDIT") > 0).alias("_f"),
        F.count_if(c("DAYS_CREDIT_UPDATE") > 0).alias("_u"),
    )
    key_gone = F.when(c("SK_ID_BUREAU").isNull(), c("_n")).otherwise(c("_k"))
    credit = loans.agg(
        F.sum("_n").alias("row_count"),
        F.sum(key_gone).alias("missing_keys"),
        F.count("SK_ID_BUREAU").alias("unique_loan_ids"),
        F.sum("_f").alias("future_credit_rows"),
        F.sum("_u").alias("positive_update_rows"),
    )
    return reduce(
        DataFrame.unionByName,
        [_customer_contracts(application, splits), _long(credit, "bureau"), _long(_payment_contract(payments), "installments")],
    )


def _payment_contract(payments: DataFrame) -> DataFrame:
    """All counts of the payments from one read: rows fold to instalments, these to loans, these to one row."""
    c = F.col
    counted = {
        "row_count": F.lit(True),
        "missing_keys": c(ID).isNull() | c("SK_ID_PREV").isNull(),
        "future_due_rows": c("DAYS_INSTALMENT") > 0,
        "future_payment_rows": c("DAYS_ENTRY_PAYMENT") > 0,
        "mismatched_missingness": c("DAYS_ENTRY_PAYMENT").isNull() != c("AMT_PAYMENT").isNull(),
    }
    ends = [(f(x).alias(f"{p}_{x}")) for x in ("DAYS_INSTALMENT", "AMT_INSTALMENT") for p, f in (("lo", F.min), ("hi", F.max))]
    schedules = payments.groupBy(*SCHEDULE_KEY).agg(*[F.count_if(p).alias(k) for k, p in counted.items()], *ends)
    uneven = F.coalesce(c("lo_DAYS_INSTALMENT") != c("hi_DAYS_INSTALMENT"), F.lit(False)) | F.coalesce(
        c("lo_AMT_INSTALMENT") != c("hi_AMT_INSTALMENT"), F.lit(False))
    loans = schedules.groupBy("SK_ID_PREV").agg(
        *[F.sum(k).alias(k) for k in counted], F.count_if(uneven).alias("inconsistent_schedules"), F.min(ID).alias("_lo"), F.max(ID).alias("_hi"))
    several = c("SK_ID_PREV").isNotNull() & (c("_lo") != c("_hi"))
    return loans.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counted], F.count_if(several).alias("owner_violations"),
        F.coalesce(F.sum("inconsistent_schedules"), F.lit(0)).alias("inconsistent_schedules"))


def _customer_contracts(application: DataFrame, splits: DataFrame) -> DataFrame:
    """Counts of both customer tables and of their differences, from one read of each: both fold to customers and meet once."""
    c = F.col

    def folded(df: DataFrame, tag: str, with_split: bool) -> DataFrame:
        per = _per_customer(df, with_split, [F.min(TARGET).alias("lo"), F.max(TARGET).alias("hi")])
        return per.select(c(ID), *[c(x).alias(f"{tag}{x}") for x in per.columns if x != ID], F.lit(True).alias(f"{tag}here"))

    both = folded(application, "a", False).join(folded(splits, "s", True), ID, "full_outer")
    alone = c("ahere").isNull() | c("shere").isNull()
    # rows of a customer pair up; their labels differ if the smallest or largest do
    differs = F.coalesce((c("alo") != c("slo")) | (c("ahi") != c("shi")), F.lit(False))
    rows = F.coalesce(c("a_n"), F.lit(1)) * F.coalesce(c("s_n"), F.lit(1))
    pick = lambda tag, with_split: [x.alias(f"{tag}{i}") for i, (_, x) in enumerate(_contract_sums(tag, with_split))]
    match = F.coalesce(F.sum(F.when(alone | differs, rows)), F.lit(0)).alias("match")
    one = both.agg(*pick("a", False), *pick("s", True), match)
    cells = [("application", k, f"a{i}") for i, (k, _) in enumerate(_contract_sums("a", False))]
    cells += [("splits", k, f"s{i}") for i, (k, _) in enumerate(_contract_sums("s", True))] + [("splits", "assignment_mismatches", "match")]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(k).alias("check_name"), c(x).cast("bigint").alias("value")) for scope, k, x in cells])))


def enforce_source_contract(contract: DataFrame) -> dict[tuple[str, str], int]:
    """Raise on the first broken source rule; the contract is a fixed list of about 25 counts."""
    v = {(r["scope"], r["check_name"]): int(r["value"] or 0) for r in contract.collect()}

    def need(ok: bool, message: str) -> None:
        if not ok:
            raise ContractError(message)

    app, spl = "application", "splits"
    need(v[app, "row_count"] > 0, "application: no rows")
    need(v[app, "row_count"] == v[app, "unique_ids"] and not v[app, "missing_ids"], "application: customer key")
    need(not v[app, "invalid_targets"], "application: label domain")
    need(v[spl, "row_count"] == v[spl, "unique_ids"] and not v[spl, "missing_ids"], "splits: customer key")
    need(not v[spl, "invalid_targets"] and not v[spl, "invalid_splits"], "splits: label or name domain")
    need(v[spl, "split_names"] == 3, "splits: three parts are needed")
    need(v[spl, "row_count"] == v[app, "row_count"], "splits: row count differs from application")
    need(not v[spl, "assignment_mismatches"], "splits: customers or labels differ from application")
    need(not v["bureau", "missing_keys"], "bureau: missing keys")
    need(v["bureau", "row_count"] == v["bureau", "unique_loan_ids"], "bureau: loan id is not unique")
    need(not v["bureau", "future_credit_rows"], "bureau: credit dated after the application")
    ins = "installments"
    need(not v[ins, "missing_keys"], "installments: missing keys")
    need(not v[ins, "future_due_rows"] and not v[ins, "future_payment_rows"], "installments: rows after the application")
    need(not v[ins, "mismatched_missingness"], "installments: payment day and amount must be missing together")
    need(not v[ins, "owner_violations"], "installments: a previous loan has several customers")
    need(not v[ins, "inconsistent_schedules"], "installments: an instalment has several due days or amounts")
    return v


def mart_contract(mart: DataFrame, splits: DataFrame) -> DataFrame:
    """Row, key, label and split preservation of a built mart."""
    require_columns(mart, (ID, TARGET, SPLIT), "mart")
    own = _long(_customer_contract(mart, True), "mart")
    match = reconcile(mart, splits, [TARGET, SPLIT]).select("only_left", "only_right", "mismatches")
    return own.unionByName(_long(match, "splits"))


def _outside_unit(name: str, upper: bool = True) -> Column:
    v = F.col(name)
    odd = F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | (v < 0)
    if upper:
        odd = odd | (v > 1)
    return F.coalesce(odd, F.lit(False))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def in_scope_rows(child: DataFrame, application: DataFrame) -> DataFrame:
    """Child rows that belong to applicants, counted per customer first."""
    per = _rows_per_customer(child, "_rows")
    return per.join(application.select(ID).distinct(), ID, "left_semi").agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("expected_rows")
    )


def bureau_contract(mart: DataFrame, bureau: DataFrame, application: DataFrame) -> DataFrame:
    c = F.col
    one = mart.agg(
        F.coalesce(F.sum("BUREAU_RECORD_COUNT"), F.lit(0)).alias("rows_aggregated"),
        F.count_if(c("BUREAU_HAS_HISTORY") == 1).alias("customers_with_history"),
        F.count_if((c("BUREAU_HAS_HISTORY") == 0) & ((c("BUREAU_RECORD_COUNT") != 0) | c("BUREAU_ACTIVE_RATIO").isNotNull())).alias("no_history_violations"),
        F.count_if((c("BUREAU_HAS_HISTORY") == 1) & (c("BUREAU_RECORD_COUNT") == 0)).alias("history_flag_violations"),
        F.count_if(_any([c(f"BUREAU_{k}_COUNT") > c("BUREAU_RECORD_COUNT") for k in ("ACTIVE", "OVERDUE_LOAN")])).alias("count_violations"),
        F.count_if(_outside_unit("BUREAU_ACTIVE_RATIO") | _outside_unit("BUREAU_OVERDUE_LOAN_RATIO")).alias("ratio_violations"),
    )
    return _long(one, "mart").unionByName(_long(in_scope_rows(usable_credits(bureau), application), "source"))


def installment_contract(mart: DataFrame, payments: DataFrame, application: DataFrame) -> DataFrame:
    for name in ("SCHEDULED_AMOUNT_SUM", "PAID_AMOUNT_SUM", "PAYMENT_GAP_SUM", "PAYMENT_GAP_MAX"):
        if mart.schema[f"INST_{name}"].dataType != T.DoubleType():
            raise ContractError(f"mart: INST_{name} must be double")
    n = {k: F.col(f"INST_{k}") for k in (
        "SCHEDULE_COUNT", "PAYMENT_EVENT_COUNT", "PAYMENT_DATE_OBSERVED_SCHEDULE_COUNT",
        "PAYMENT_AMOUNT_OBSERVED_SCHEDULE_COUNT", "MISSING_PAYMENT_SCHEDULE_COUNT", "LATE_SCHEDULE_COUNT",
        "UNDERPAID_SCHEDULE_COUNT", "LAST_365_SCHEDULE_COUNT", "LAST_365_LATE_COUNT",
        "LAST_730_SCHEDULE_COUNT", "LAST_730_LATE_COUNT", "HAS_HISTORY", "LATE_RATIO")}
    total, missing = n["SCHEDULE_COUNT"], n["MISSING_PAYMENT_SCHEDULE_COUNT"]
    dated, paid = n["PAYMENT_DATE_OBSERVED_SCHEDULE_COUNT"], n["PAYMENT_AMOUNT_OBSERVED_SCHEDULE_COUNT"]
    wrong_counts = [
        dated > total, paid > total, dated + missing != total, paid + missing != total,
        n["LATE_SCHEDULE_COUNT"] > dated, n["UNDERPAID_SCHEDULE_COUNT"] > paid,
        n["LAST_365_SCHEDULE_COUNT"] > n["LAST_730_SCHEDULE_COUNT"], n["LAST_730_SCHEDULE_COUNT"] > total,
        n["LAST_365_LATE_COUNT"] > n["LAST_365_SCHEDULE_COUNT"],
        n["LAST_730_LATE_COUNT"] > n["LAST_730_SCHEDULE_COUNT"],
    ]
    wrong_ratios = [
        _outside_unit(f"INST_{k}_RATIO") for k in ("MISSING_PAYMENT", "LATE", "UNDERPAID", "LAST_365_LATE", "LAST_730_LATE")
    ] + [_outside_unit("INST_PAYMENT_RATIO", upper=False)]
    one = mart.agg(
        F.coalesce(F.sum(n["PAYMENT_EVENT_COUNT"]), F.lit(0)).alias("rows_aggregated"),
        F.coalesce(F.sum(total), F.lit(0)).alias("schedules_aggregated"),
        F.count_if(n["HAS_HISTORY"] == 1).alias("customers_with_history"),
        F.count_if((n["HAS_HISTORY"] == 0) & ((total != 0) | n["LATE_RATIO"].isNotNull())).alias("no_history_violations"),
        F.count_if((n["HAS_HISTORY"] == 1) & (total == 0)).alias("history_flag_violations"),
        F.count_if(_any(wrong_counts)).alias("count_violations"),
        F.count_if(_any(wrong_ratios)).alias("ratio_violations"),
    )
    return _long(one, "mart").unionByName(_long(in_scope_rows(payments, application), "source"))


def enforce_mart_contract(*contracts: DataFrame) -> None:
    """Raise if a built mart breaks its contract (a fixed list of counts)."""
    for contract in contracts:
        v = {(r["scope"], r["check_name"]): int(r["value"] or 0) for r in contract.collect()}
        broken = [k for k, n in v.items() if n and (k[1].endswith("_violations") or k[1] in ("mismatches", "missing_ids", "invalid_targets", "invalid_splits"))]
        if ("mart", "unique_ids") in v and v["mart", "row_count"] != v["mart", "unique_ids"]:
            broken.append(("mart", "unique_ids"))
        if ("source", "expected_rows") in v and v["source", "expected_rows"] != v["mart", "rows_aggregated"]:
            broken.append(("source", "expected_rows"))
        if broken:
            raise ContractError(f"mart contract broken: {broken}")


# ---------------------------------------------------------------------------
# findings
# ---------------------------------------------------------------------------
def scope_findings(coverage: DataFrame) -> DataFrame:
    return coverage.select(
        F.lit("INFO").alias("severity"), F.lit("support_table_scope").alias("code"), "table_name",
        F.lit(None).cast("string").alias("subject"), F.col("outside_customers").cast("double").alias("value"),
    )


def validation_status(findings: DataFrame) -> DataFrame:
    """FAIL exactly when an ERROR finding exists."""
    return findings.agg(
        F.count("*").alias("finding_count"),
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        F.when(F.count_if(F.col("severity") == "ERROR") > 0, "FAIL").otherwise("PASS").alias("status"),
    )


def check_exact_columns(df: DataFrame, table: str) -> None:
    if tuple(df.columns) != TABLES[table].columns:
        raise ContractError(f"{table}: column list differs from the contract")


def data_dictionary(profile: DataFrame, descriptions: DataFrame, table: str) -> DataFrame:
    """Column statistics with their descriptions; the loan-id spelling variant is mapped."""
    name = F.when(F.col("Row") == "SK_BUREAU_ID", "SK_ID_BUREAU").otherwise(F.trim("Row"))
    text = descriptions.where(F.col("Table") == table).groupBy(name.alias("column_name")).agg(
        F.min("Description").alias("description"), F.min("Special").alias("special")
    )
    return profile.join(text, "column_name", "left")
