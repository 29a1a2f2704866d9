"""Validation of raw tables as text: one state per column, folded in one pass over the table.

A table is read with every token as text. Its columns, and three facts of each row (its digest, its primary key, the
customer behind its loan), become long rows of one aggregation; whole columns fold to one partial state per task, so the
shuffle carries two or three narrow rows per row of the table and no column is read twice. Rules, profile and findings are
computed from the states alone. States of whole columns merge: those of new files can be added to stored ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrain.functions.scalars import ratio_or_zero, semantic_type
from riskgrain.schemas import EMPLOYED_SENTINEL, ID, TABLES, TARGET, ContractError, by_name
from riskgrain.session import small_table

HIGH_MISSING_RATE = 0.5
ROW, KEY, OWNER = "#row", "#key", "#owner"
_SAME = "#same"
#: The column whose values must not belong to several customers.
OWNED = {"installments": "SK_ID_PREV"}
INF = float("inf")


@dataclass(frozen=True)
class Domain:
    """What a column's values may be; numbers have bounds, exceptions or a list, texts have a list."""

    rule: str
    low: float = -INF
    high: float = INF
    open_ends: bool = False
    also: tuple[float, ...] = ()
    numbers: tuple[float, ...] = ()
    texts: tuple[str, ...] = ()
    null_counts: bool = False


_FLAG = Domain("{}_binary", numbers=(0.0, 1.0), null_counts=True)
_NOT_NEGATIVE = Domain("{}_non_negative", low=0.0)
_NOT_LATER = Domain("{}_non_positive", high=0.0)

# The domain of each column by its name; of several matches the one that ends last counts.
DOMAINS: dict[str, dict[Domain, str]] = {
    "application": {
        _FLAG: "^FLAG_|^(REG|LIVE)_(REGION|CITY)_NOT_(LIVE|WORK)_(REGION|CITY)$",
        Domain("{}_yn", texts=("N", "Y"), null_counts=True): "^FLAG_OWN_(CAR|REALTY)$",
        Domain("target_domain", numbers=(0.0, 1.0)): "^TARGET$",
        Domain("{}_negative", high=0.0, open_ends=True): "^DAYS_BIRTH$",
        Domain("{}_domain", high=0.0, also=(float(EMPLOYED_SENTINEL),)): "^DAYS_EMPLOYED$",
        Domain("hour_range", low=0.0, high=23.0): "^HOUR_APPR_PROCESS_START$",
        _NOT_NEGATIVE: "^(CNT_CHILDREN|AMT_INCOME_TOTAL|AMT_CREDIT|AMT_ANNUITY|AMT_GOODS_PRICE)$",
    },
    "bureau": {_NOT_NEGATIVE: "^(CREDIT_DAY_OVERDUE|AMT_CREDIT_SUM|AMT_CREDIT_SUM_OVERDUE)$"},
    "installments": {
        _NOT_LATER: "^(DAYS_INSTALMENT|DAYS_ENTRY_PAYMENT)$",
        _NOT_NEGATIVE: "^(NUM_INSTALMENT_VERSION|NUM_INSTALMENT_NUMBER|AMT_INSTALMENT|AMT_PAYMENT)$",
    },
}
_IDENTIFIER = Domain("{}_positive", low=0.0, open_ends=True)


def column_domain(table: str, column: str) -> Domain | None:
    return _IDENTIFIER if column.startswith("SK_ID_") else by_name(column, DOMAINS[table])


def column_rules(table: str, column: str) -> list[tuple[str, str]]:
    """(rule, counter of the column's state that breaks it)."""
    low, rules = column.lower(), []
    if column.startswith("SK_ID_"):
        rules += [(f"{low}_not_null", "missing_count"), (f"{low}_integer", "fraction_count")]
    if column not in TABLES[table].categorical:
        rules.append((f"{low}_numeric", "text_count"))
    if domain := column_domain(table, column):
        rules.append((domain.rule.format(low), "outside_count"))
    return rules


#: Spellings Spark casts to a double other than NaN, without Java's suffixes. A cast that fails inside builds an exception
#: for each token, which costs far more than the match.
NUMBER = (
    r"^[\x00-\x20]*[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?"
    r"|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][-+]?[0-9]+)[\x00-\x20]*$"
)


def parsed(token: Column) -> Column:
    """The number a token stands for (infinite ones too), else NULL; a Java suffix does not make a number."""
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


COUNTERS = ("missing_count", "blank_count", "text_count", "infinite_count", "fraction_count", "outside_count", "one_count")


def _column_specs(df: DataFrame, table: str) -> DataFrame:
    """One row per column: how its tokens are judged (its size is that of the schema)."""
    rows = []
    for c in df.columns:
        d = column_domain(table, c)
        number = c not in TABLES[table].categorical
        rows.append((
            c, semantic_type(c, not number), number, c.startswith("SK_ID_"), d is not None, d.low if d else None, d.high if d else None,
            bool(d and d.open_ends), list(d.also if d else ()), list(d.numbers if d else ()), list(d.texts if d else ()),
            bool(d and d.null_counts), column_rules(table, c)))
    return small_table(
        df.sparkSession, rows,
        "column_name string, semantic_type string, is_number boolean, is_id boolean, judged boolean, low double, high double, open_ends boolean, "
        "also array<double>, numbers array<double>, texts array<string>, null_counts boolean, rules array<struct<rule: string, counter: string>>")


def _outside(token: Column, value: Column, missing: Column) -> Column:
    """Whether a token breaks the domain its spec row declares."""
    c = F.col
    beyond = (value < c("low")) | (value > c("high")) | (c("open_ends") & ((value == c("low")) | (value == c("high"))))
    # identifiers are compared only where finite, and infinite bounds of a domain admit any value
    ranged = value.isNotNull() & ~(c("is_id") & (F.abs(value) == F.lit(INF))) & beyond & ~F.array_contains(c("also"), value)
    listed = value.isNull() | ~F.array_contains(c("numbers"), value)
    spelled = ~F.array_contains(c("texts"), token)
    by_kind = F.when(F.size("numbers") > 0, listed).when(F.size("texts") > 0, spelled).otherwise(F.coalesce(ranged, F.lit(False)))
    return c("judged") & F.when(missing, c("null_counts")).otherwise(by_kind)


def column_states(df: DataFrame, table: str) -> DataFrame:
    """One row per column of the raw table, and one per fact of its rows (``#row``, ``#key``, ``#owner``).

    ``groups`` counts a fact's distinct values, ``surplus`` the rows beyond one per value, ``conflicts`` the loans of
    several customers. Rows are told apart by two 64-bit hashes of their values, numbers compared as numbers.
    """
    if not df.columns:
        raise ContractError(f"{table}: no columns")
    spec, c = TABLES[table], F.col
    tokens = [c(x).cast("string").alias(x) for x in df.columns]
    same = [F.coalesce(parsed(c(x)).cast("string") if x not in spec.categorical else c(x), c(x), F.lit("\0")) for x in df.columns]
    facts = {ROW: F.concat(F.hex(F.xxhash64(_SAME)), F.hex(F.xxhash64(F.lit(ROW), _SAME)))}
    if spec.primary_key in df.columns:
        facts[KEY] = F.coalesce(parsed(c(spec.primary_key)).cast("string"), c(spec.primary_key))
    owned = OWNED.get(table)
    if owned in df.columns and ID in df.columns:
        facts[OWNER] = F.concat(F.coalesce(parsed(c(owned)).cast("string"), c(owned)), F.lit("\0"), F.coalesce(c(ID), F.lit("")))
    cells = [F.struct(F.lit(k).alias("column_name"), e.alias("token")) for k, e in [*((x, c(x)) for x in df.columns), *facts.items()]]
    long = df.select(*tokens).select("*", F.array(*same).alias(_SAME)).select(F.inline(F.array(*cells)))
    fact = c("column_name").isin(*facts)
    parts = F.split("token", "\0")
    long = long.join(_column_specs(df, table).drop("rules", "semantic_type"), "column_name", "left").select(
        "column_name", F.when(fact, parts[0]).alias("fact"), F.when(~fact, c("token")).alias("token"),
        parsed(F.when(c("column_name") == OWNER, F.get(parts, F.lit(1))).when(~fact, c("token"))).alias("value"),
        "is_number", "is_id", "judged", "low", "high", "open_ends", "also", "numbers", "texts", "null_counts")
    token, value = c("token"), c("value")
    missing = token.isNull() | (c("is_number") & F.lower(F.trim(token)).isin("nan", "+nan", "-nan"))
    finite = value.isNotNull() & (F.abs(value) < F.lit(INF))
    seen = {
        "missing_count": F.when(fact, c("fact").isNull()).otherwise(missing),
        "blank_count": F.trim(token) == "",
        "text_count": ~missing & ~fact & value.isNull(),
        "infinite_count": c("is_number") & (F.abs(value) == F.lit(INF)),
        "fraction_count": finite & ~fact & (value != F.floor(value)),
        "outside_count": _outside(token, value, missing),
        "one_count": ~fact & (value == 1),
    }
    bounded = F.when(finite, value)
    folded = long.groupBy("column_name", "fact").agg(
        F.count("*").alias("n"), *[F.count_if(p).alias(k) for k, p in seen.items()], F.min(bounded).alias("low"), F.max(bounded).alias("high"))
    per = folded.groupBy("column_name").agg(
        F.sum("n").alias("row_count"), *[F.sum(k).alias(k) for k in seen],
        F.min("low").alias("min_value"), F.max("high").alias("max_value"), F.count("fact").alias("groups"),
        F.coalesce(F.sum(F.when(c("fact").isNotNull(), c("n") - 1)), F.lit(0)).alias("surplus"),
        F.count_if(c("fact").isNotNull() & (c("low") != c("high"))).alias("conflicts"))
    plain = ~c("column_name").isin(*facts)
    return per.select(
        F.lit(table).alias("table_name"), "column_name", "row_count", *seen,
        *[F.when(plain, c(x)).alias(x) for x in ("min_value", "max_value")], "groups", "surplus", "conflicts")


def merged_states(states: DataFrame) -> DataFrame:
    """States of the same columns over several parts of a table as one; facts of rows do not merge and are left out."""
    return states.where(~F.col("column_name").startswith("#")).groupBy("table_name", "column_name").agg(
        F.sum("row_count").alias("row_count"), *[F.sum(k).alias(k) for k in COUNTERS], F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), *[F.sum(k).alias(k) for k in ("groups", "surplus", "conflicts")])


def _with_specs(states: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    frame = states.sparkSession.createDataFrame([], ", ".join(f"`{x}` string" for x in columns))
    return states.join(_column_specs(frame, table).select("column_name", "semantic_type", "is_number", "rules"), "column_name", "left")


def _counter(name: Column) -> Column:
    picked = F.when(name == "missing_count", F.col("missing_count"))
    for k in COUNTERS[1:]:
        picked = picked.when(name == k, F.col(k))
    return picked


def rules_of(states: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """(table_name, rule, column_name, severity, violations) of every rule of the columns."""
    each = _with_specs(states, table, columns).select("table_name", "column_name", *COUNTERS, F.explode("rules").alias("r"))
    return each.select("table_name", F.col("r.rule").alias("rule"), "column_name", F.lit("ERROR").alias("severity"), _counter(F.col("r.counter")).alias("violations"))


def rule_violations(df: DataFrame, table: str) -> DataFrame:
    return rules_of(column_states(df, table), table, df.columns)


def profile_of(states: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Token kinds, missing and blank tokens and the finite range of every column."""
    c = F.col
    numbers = c("row_count") - c("missing_count") - c("text_count")
    return _with_specs(states, table, columns).where(c("semantic_type").isNotNull()).select(
        "table_name", "column_name", "semantic_type", "row_count", "missing_count", ratio_or_zero(c("missing_count"), c("row_count")).alias("missing_rate"),
        "blank_count", numbers.alias("number_count"), "text_count", "infinite_count", "fraction_count",
        F.when(c("is_number"), c("min_value")).alias("min_value"), F.when(c("is_number"), c("max_value")).alias("max_value"))


def findings_of(states: DataFrame, table: str, columns: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """Findings as (severity, code, table_name, subject, value), from the states in one pass.

    A column drifts if some of its tokens are numbers and others are not.
    """
    c, name = F.col, F.col("column_name")
    key, owned = TABLES[table].primary_key, OWNED.get(table)

    def finding(severity: str, code: str, subject: Column, value: Column, found: Column) -> Column:
        return F.struct(
            F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"),
            value.cast("double").alias("value"), F.coalesce(found, F.lit(False)).alias("found"))

    column = c("semantic_type").isNotNull()
    numbers = c("row_count") - c("missing_count") - c("text_count")
    rate = ratio_or_zero(c("missing_count"), c("row_count"))
    bad_target = c("missing_count") + c("outside_count")
    cells = [
        finding("ERROR", "infinite_numeric_value", name, c("infinite_count"), column & (c("infinite_count") > 0)),
        finding("WARNING", "high_missing_rate", name, rate, column & (rate >= HIGH_MISSING_RATE)),
        finding("WARNING", "dtype_drift", name, c("text_count"), column & (c("text_count") > 0) & (numbers > 0)),
        finding("WARNING", "duplicate_row", F.lit(None), c("surplus"), (name == ROW) & (c("surplus") > 0)),
        finding("ERROR", "primary_key_null", F.lit(key), c("missing_count"), (name == KEY) & (c("missing_count") > 0)),
        finding("ERROR", "primary_key_duplicate", F.lit(key), c("surplus"), (name == KEY) & (c("surplus") > 0)),
        finding("ERROR", "previous_customer_dependency", F.lit(owned), c("conflicts"), (name == OWNER) & (c("conflicts") > 0)),
    ]
    if table == "application":
        cells += [
            finding("ERROR", "target_invalid", name, bad_target, (name == TARGET) & (bad_target > 0)),
            finding("INFO", "target_imbalance", name, ratio_or_zero(c("one_count"), c("row_count")), (name == TARGET) & (bad_target == 0)),
        ]
    if expected_rows is not None:
        cells.append(finding("ERROR", "row_count_mismatch", F.lit(None), c("row_count"), (name == ROW) & (c("row_count") != expected_rows)))
    ruled = F.transform(F.coalesce(c("rules"), F.array().cast("array<struct<rule: string, counter: string>>")), lambda r: finding(
        "ERROR", "rule_violation", r["rule"], _counter(r["counter"]), _counter(r["counter"]) > 0))
    each = _with_specs(states, table, columns).select("table_name", F.inline(F.concat(F.array(*cells), ruled)))
    return each.where("found").select("severity", "code", "table_name", "subject", "value")


def table_findings(df: DataFrame, table: str, expected_rows: int | None = None) -> DataFrame:
    return findings_of(column_states(df, table), table, df.columns, expected_rows)
