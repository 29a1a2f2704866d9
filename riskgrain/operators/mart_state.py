"""The contract state of a written mart: counts and an order-free digest of every column, from one scan.

A column's digest is the sum of hashes of (customer, value), so two marts carry the same values for the same customers
exactly when the digests and row counts agree (up to a chance of about one in 2**64). States are small tables that are
stored beside their mart; versions are compared by their states, without reading the marts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.schemas import ID, METADATA, SPLIT, SPLITS, TARGET, ContractError, require_columns

IDS, PARTS = "#id", "#part"


def mart_state(mart: DataFrame, version: str) -> DataFrame:
    """One row per column, and one each for the customers (``#id``) and the parts (``#part``) of the mart.

    ``bad_count``: labels outside 0 and 1, unknown parts, infinite values. ``groups`` and ``surplus`` tell distinct
    customers or parts and the rows beyond one each. Rows fold to one partial state per column in each task; only
    customers go through the shuffle one by one.
    """
    require_columns(mart, METADATA, "mart")
    c = F.col

    def bad(field: T.StructField):
        v = c(field.name)
        if field.name == TARGET:
            return v.isNull() | ~v.isin(0, 1)
        if field.name == SPLIT:
            return v.isNull() | ~v.isin(*SPLITS)
        return F.abs(v) == F.lit(float("inf")) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else F.lit(False)

    def cell(name: str, fact, digest, empty, wrong):
        return F.struct(
            F.lit(name).alias("column_name"), fact.cast("string").alias("fact"), digest.alias("h"), empty.alias("empty"),
            F.coalesce(wrong, F.lit(False)).alias("wrong"))

    none = F.lit(None)
    cells = [cell(f.name, none, F.xxhash64(ID, c(f.name)), c(f.name).isNull(), bad(f)) for f in mart.schema.fields]
    cells += [cell(IDS, c(ID), F.xxhash64(ID), c(ID).isNull(), F.lit(False)), cell(PARTS, c(SPLIT), F.xxhash64(SPLIT), c(SPLIT).isNull(), F.lit(False))]
    folded = mart.select(F.inline(F.array(*cells))).groupBy("column_name", "fact").agg(
        F.count("*").alias("n"), F.count_if("empty").alias("empty"), F.count_if("wrong").alias("wrong"), F.sum(c("h").cast("decimal(20,0)")).alias("h"))
    fact = c("fact").isNotNull()
    return folded.groupBy("column_name").agg(
        F.sum("n").alias("row_count"), F.sum("empty").alias("null_count"), F.sum("wrong").alias("bad_count"), F.count("fact").alias("groups"),
        F.coalesce(F.sum(F.when(fact, c("n") - 1)), F.lit(0)).alias("surplus"), F.sum("h").cast("decimal(38,0)").alias("digest"),
    ).select(F.lit(version).alias("version"), "*")


def state_contract(state: DataFrame) -> DataFrame:
    """(scope, check_name, value) of one mart, the scope being its version."""
    c, name = F.col, F.col("column_name")
    of = lambda column, value: F.coalesce(F.sum(F.when(name == column, c(value))), F.lit(0))
    one = state.groupBy(c("version").alias("scope")).agg(
        of(ID, "row_count").alias("row_count"), of(IDS, "groups").alias("unique_ids"), of(ID, "null_count").alias("missing_ids"),
        of(IDS, "surplus").alias("repeated_ids"), of(TARGET, "bad_count").alias("invalid_targets"), of(SPLIT, "bad_count").alias("invalid_splits"),
        of(PARTS, "groups").alias("split_names"),
        F.coalesce(F.sum(F.when(~name.isin(TARGET, SPLIT), c("bad_count"))), F.lit(0)).alias("infinite_values"),
        F.count_if(~name.startswith("#")).alias("column_count"))
    return one.unpivot(["scope"], [x for x in one.columns if x != "scope"], "check_name", "value")


def changed_columns(lower: DataFrame, higher: DataFrame) -> DataFrame:
    """(column_name, missing, changed) of the lower mart's columns that the higher one lacks or does not carry unchanged."""
    l = lower.where(~F.col("column_name").startswith("#")).select("column_name", F.col("row_count").alias("n"), F.col("digest").alias("d"))
    h = higher.select("column_name", F.col("row_count").alias("hn"), F.col("digest").alias("hd"))
    both = l.join(h, "column_name", "left").select(
        "column_name", F.col("hn").isNull().alias("missing"),
        F.coalesce((F.col("n") != F.col("hn")) | ~F.col("d").eqNullSafe(F.col("hd")), F.lit(True)).alias("changed"))
    return both.where("missing or changed")


def check_states(states: dict[str, DataFrame]) -> dict[str, dict]:
    """Raise unless every mart keeps one row per known customer and each version carries the one before it unchanged.

    ``states`` in the order of the versions. Returns each version's counts; states have one row per column.
    """
    seen: dict[str, dict] = {}
    previous = None
    for version, state in states.items():
        v = {r["check_name"]: int(r["value"]) for r in state_contract(state).collect()}
        if not v:
            raise ContractError(f"{version}: no rows")
        broken = [k for k in ("missing_ids", "repeated_ids", "invalid_targets", "invalid_splits", "infinite_values") if v[k]]
        if v["split_names"] != len(SPLITS):
            broken.append("split_names")
        if previous is not None:
            broken += [f"{r['column_name']} of the version before" for r in changed_columns(states[previous], state).collect()]
        if broken:
            raise ContractError(f"{version}: mart contract broken: {broken}")
        seen[version], previous = v, version
    return seen


def check_loaded(mart: DataFrame, published: DataFrame, version: str) -> None:
    """Raise unless the mart has exactly the columns, rows and values of the published state."""
    own, kept = mart_state(mart, version), published.where(F.col("version") == version)
    if kept.isEmpty():
        raise ContractError(f"{version}: no published state")
    differ = changed_columns(kept, own).unionByName(changed_columns(own, kept)).select("column_name").distinct().collect()
    if differ:
        raise ContractError(f"{version}: mart differs from its published state in {sorted(r[0] for r in differ)}")
