"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrain.operators.splits import seal_test
from riskgrain.schemas import ID, SPLIT, TABLES, TARGET, FeatureRoles, require_columns


def read_raw_csv(spark: SparkSession, path: str, table: str, as_text: bool = False, view: str | None = None) -> DataFrame:
    """A raw CSV table under its declared schema, with NaN normalised to NULL.

    ``as_text`` keeps every token as text so that validation can see what does not parse.
    """
    spec = TABLES[table]
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if as_text:
        df = reader.schema(spec.text_schema()).csv(path)
    else:
        df = reader.schema(spec.typed_schema()).csv(path)
        df = df.select(
            *[
                F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if kind == "double" else F.col(c)
                for c, kind in df.dtypes
            ]
        )
        if "EMERGENCYSTATE_MODE" in df.columns:
            yes = F.lower("EMERGENCYSTATE_MODE")
            df = df.withColumn(
                "EMERGENCYSTATE_MODE",
                F.when(yes.isin("yes", "true", "1"), 1).when(yes.isin("no", "false", "0"), 0).cast("tinyint"),
            )
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Customer id and label of a wide CSV, read as text and parsed strictly.

    Tokens that are not whole numbers become NULL and fail the split's key contract.
    """
    wide = spark.read.option("header", True).csv(path)
    require_columns(wide, (ID, TARGET), "application")

    def whole(column: str):
        value = F.col(column).try_cast("double")
        return F.when(value == F.floor(value), value.cast("bigint")).alias(column)

    return wide.select(whole(ID), whole(TARGET))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(f"{ID} bigint, {TARGET} bigint, {SPLIT} string").csv(path)


def _cp1252(column: str) -> Column:
    """Latin-1 text re-read as cp1252: the two differ only in 0x80..0x9F."""
    pairs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    known = {k: v for k, v in pairs.items() if v}
    return F.translate(F.col(column), "".join(known), "".join(known.values())).alias(column)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """The column-description file: UTF-8, or cp1252 when it is not valid UTF-8."""

    def load(encoding: str) -> DataFrame:
        return (
            spark.read.option("header", True).option("encoding", encoding).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path)
        )

    df = load("UTF-8")
    if not df.where(F.concat_ws("", *df.columns).contains("\ufffd")).isEmpty():
        df = load("ISO-8859-1")
        df = df.select(*[_cp1252(c) for c in df.columns])
    require_columns(df, ("Table", "Row", "Description", "Special"), "descriptions")
    return df


def read_mart(spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet mart; the split test and the column list are pushed into the scan."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col(SPLIT) == split)
    return df.select(*columns) if columns else df


def read_development(spark: SparkSession, path: str, split: str, roles: FeatureRoles) -> DataFrame:
    """Model rows of train or validation; the test part stays sealed."""
    return read_mart(spark, path, seal_test(split), [ID, TARGET, SPLIT, *roles.features])
