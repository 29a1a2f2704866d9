"""Put star-schema tables into the roles the library works on.

The given tables have no NULLs and no applicant attributes, so attributes and NULL patterns are
derived row by row from the keys. No row is dropped: orders whose customer number ends in zero are
re-keyed to customers outside the application set, which leaves some applicants without history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrain.session import spread

ANCHOR_DATE = "2001-06-30"
OUTSIDE_OFFSET = 1_000_000_000


# Declared schemas of the tables in use, so that no read infers one.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


APPLICATION_SQL = {
    "SK_ID_CURR": "c_custkey",
    "TARGET": "CAST(c_acctbal < 0 AS BIGINT)",
    "NAME_CONTRACT_TYPE": "c_mktsegment",
    "CODE_GENDER": "CASE WHEN c_custkey % 50 = 0 THEN 'XNA' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
    "FLAG_OWN_CAR": "CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END",
    "FLAG_OWN_REALTY": "CASE WHEN c_custkey % 7 < 4 THEN 'Y' ELSE 'N' END",
    "CNT_CHILDREN": "c_custkey % 4",
    "AMT_INCOME_TOTAL": "CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 20000 + (c_custkey * 7919 % 5000) * 10 END",
    "AMT_CREDIT": "CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE 50000 + (c_custkey * 104729 % 9000) * 50 END",
    "AMT_ANNUITY": "CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 0 ELSE 1000 + (c_custkey * 31 % 700) * 5 END",
    "AMT_GOODS_PRICE": "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE 45000 + (c_custkey * 104729 % 9000) * 45 END",
    "NAME_FAMILY_STATUS": "CASE WHEN c_custkey % 40 = 0 THEN 'Unknown' WHEN c_custkey % 3 = 1 THEN 'Married' ELSE 'Single' END",
    "NAME_EDUCATION_TYPE": "r_name",
    "ORGANIZATION_TYPE": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE n_name END",
    "DAYS_BIRTH": "-(7300 + (c_custkey * 13 % 16000))",
    "DAYS_EMPLOYED": "CASE WHEN c_custkey % 6 = 0 THEN 365243 WHEN c_custkey % 31 = 0 THEN NULL ELSE -(c_custkey * 17 % 9000) END",
    "OWN_CAR_AGE": "CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN c_custkey % 25 END",
    "FLAG_MOBIL": "CASE WHEN c_custkey % 500 = 0 THEN 0 ELSE 1 END",
    "CNT_FAM_MEMBERS": "CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN 0 ELSE 1 + c_custkey % 5 END",
    "REGION_RATING_CLIENT": "CAST(1 + n_regionkey % 3 AS BIGINT)",
    "HOUR_APPR_PROCESS_START": "CASE WHEN c_custkey % 997 = 0 THEN 24 ELSE c_custkey % 24 END",
    "EXT_SOURCE_1": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE (c_custkey * 97 % 1000) / 1000.0 END",
    "EXT_SOURCE_2": "CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE (c_custkey * 193 % 1000) / 1000.0 END",
    "EXT_SOURCE_3": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey * 389 % 1000) / 1000.0 END",
}

_DAYS = "date_diff_days(o_orderdate)"
_OWNER = f"CASE WHEN o_custkey % 10 = 0 THEN o_custkey + {OUTSIDE_OFFSET} ELSE o_custkey END"
_PAID_UNKNOWN = "l_returnflag = 'N' AND l_linestatus = 'O'"

BUREAU_SQL = {
    "SK_ID_CURR": _OWNER,
    "SK_ID_BUREAU": "o_orderkey",
    "CREDIT_ACTIVE": "CASE WHEN o_orderkey % 97 = 0 THEN 'Bad debt' WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Sold' END",
    "CREDIT_CURRENCY": "CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'currency 2' ELSE 'currency 1' END",
    "DAYS_CREDIT": f"LEAST({_DAYS}, 0)",
    "CREDIT_DAY_OVERDUE": "CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 60 ELSE 0 END",
    "DAYS_ENDDATE_FACT": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 9 <> 0 OR o_orderkey % 211 = 0 THEN -(o_orderkey % 300) END",
    "AMT_CREDIT_MAX_OVERDUE": "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 500) * 1.5 END",
    "CNT_CREDIT_PROLONG": "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END",
    "AMT_CREDIT_SUM": "CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_totalprice END",
    "AMT_CREDIT_SUM_DEBT": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 33 = 0 THEN -100.5 ELSE (o_orderkey % 1000) * 10.25 END",
    "AMT_CREDIT_SUM_LIMIT": "CASE WHEN o_orderkey % 301 = 0 THEN -50.0 ELSE (o_orderkey % 7) * 100.0 END",
    "AMT_CREDIT_SUM_OVERDUE": "CASE WHEN o_orderkey % 29 = 0 THEN (o_orderkey % 100) * 2.5 ELSE 0 END",
    "CREDIT_TYPE": "o_orderpriority",
    "DAYS_CREDIT_UPDATE": f"CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE {_DAYS} END",
    "AMT_ANNUITY": "CASE WHEN o_orderkey % 5 IN (1, 2) THEN NULL ELSE (o_orderkey % 300) * 3.0 END",
}

INSTALLMENTS_SQL = {
    "SK_ID_PREV": "l_orderkey",
    "SK_ID_CURR": _OWNER,
    "NUM_INSTALMENT_VERSION": "1",
    "NUM_INSTALMENT_NUMBER": "l_linenumber",
    "DAYS_INSTALMENT": _DAYS,
    "DAYS_ENTRY_PAYMENT": f"CASE WHEN {_PAID_UNKNOWN} THEN NULL ELSE date_diff_days(l_shipdate) END",
    "AMT_INSTALMENT": "l_extendedprice",
    "AMT_PAYMENT": f"CASE WHEN {_PAID_UNKNOWN} THEN NULL ELSE CAST(FLOOR(l_extendedprice * (1 - l_discount) * 10000 + 0.5) AS DOUBLE) / 10000 END",
}

REGION_FLAGS_SQL = {
    "REG_REGION_NOT_LIVE_REGION": "c_custkey % 2",
    "REG_REGION_NOT_WORK_REGION": "c_custkey % 3 % 2",
    "LIVE_REGION_NOT_WORK_REGION": "c_custkey % 5 % 2",
    "REG_CITY_NOT_LIVE_CITY": "c_custkey % 7 % 2",
    "REG_CITY_NOT_WORK_CITY": "c_custkey % 11 % 2",
    "LIVE_CITY_NOT_WORK_CITY": "c_custkey % 13 % 2",
}

#: The raw tables as text hold tokens that break their contract: column -> (condition, token) pairs, first match.
BAD_TOKENS = {
    "application": {
        "SK_ID_CURR": [("c_custkey % 41 = 0", "NULL"), ("c_custkey % 43 = 0", "concat(c_custkey, '.5')"), ("c_custkey % 47 = 0", "concat('-', c_custkey)"), ("c_custkey % 53 = 0", "concat('id', c_custkey)"), ("c_custkey % 59 = 0", "'5'")],
        "TARGET": [("c_custkey % 61 = 0", "'2'"), ("c_custkey % 67 = 0", "'?'"), ("c_custkey % 71 = 0", "NULL")],
        "AMT_CREDIT": [("c_custkey % 73 = 0", "'n/a'"), ("c_custkey % 79 = 0", "'-5'"), ("c_custkey % 83 = 0", "'1e5'")],
        "AMT_ANNUITY": [("c_custkey % 37 = 0", "'inf'"), ("c_custkey % 89 = 0", "'nan'")],
        "AMT_INCOME_TOTAL": [("c_custkey % 97 = 0", "'-inf'"), ("c_custkey % 31 = 0", "''")],
        "CNT_CHILDREN": [("c_custkey % 101 = 0", "'two'"), ("c_custkey % 103 = 0", "'-1'")],
        "DAYS_BIRTH": [("c_custkey % 107 = 0", "'12'")],
        "DAYS_EMPLOYED": [("c_custkey % 109 = 0", "'30'")],
        "FLAG_OWN_CAR": [("c_custkey % 113 = 0", "'y'"), ("c_custkey % 127 = 0", "NULL")],
        "FLAG_OWN_REALTY": [("c_custkey % 131 = 0", "' '")],
        "FLAG_MOBIL": [("c_custkey % 29 = 0", "'Y'")],
        "EXT_SOURCE_1": [("c_custkey % 137 = 0", "'0,5'")],
        "ORGANIZATION_TYPE": [("c_custkey % 139 = 0", "'5'")],
        **{c: [(f"c_custkey % {19 + 2 * k} = 0", "NULL"), (f"c_custkey % {23 + 2 * k} = 0", "'2'"), (f"c_custkey % {17 + 2 * k} = 0", "'N'")] for k, c in enumerate(REGION_FLAGS_SQL)},
    },
    "bureau": {
        "SK_ID_BUREAU": [("o_orderkey % 499 = 0", "NULL"), ("o_orderkey % 503 = 0", "'7.0'"), ("o_orderkey % 509 = 0", "'0'")],
        "SK_ID_CURR": [("o_orderkey % 521 = 0", "'?'")],
        "CREDIT_DAY_OVERDUE": [("o_orderkey % 523 = 0", "'-3'")],
        "AMT_CREDIT_SUM": [("o_orderkey % 541 = 0", "'-1'"), ("o_orderkey % 547 = 0", "'Infinity'")],
        "AMT_CREDIT_SUM_OVERDUE": [("o_orderkey % 557 = 0", "'none'"), ("o_orderkey % 563 = 0", "'-0.5'")],
        "CREDIT_TYPE": [("o_orderkey % 569 = 0", "'12'")],
    },
    "installments": {
        "SK_ID_PREV": [("l_orderkey % 571 = 0", "NULL")],
        "SK_ID_CURR": [("l_orderkey % 577 = 0 AND l_linenumber = 2", "'1'")],
        "NUM_INSTALMENT_VERSION": [("l_orderkey % 587 = 0", "'one'"), ("l_orderkey % 593 = 0", "'-2'")],
        "DAYS_INSTALMENT": [("l_orderkey % 599 = 0", "'3'")],
        "DAYS_ENTRY_PAYMENT": [("l_orderkey % 601 = 0", "'4'")],
        "AMT_PAYMENT": [("l_orderkey % 607 = 0", "'-2'"), ("l_orderkey % 613 = 0", "'inf'")],
    },
}
#: Rows that come a second time, with one number written another way.
REPEATED = {
    "application": ("c_custkey % 50 = 7", "REG_CITY_NOT_LIVE_CITY"),
    "bureau": ("o_orderkey % 50 = 7", "CNT_CREDIT_PROLONG"),
    "installments": ("l_orderkey % 50 = 7", "NUM_INSTALMENT_NUMBER"),
}
RAW = {"application": {**APPLICATION_SQL, **REGION_FLAGS_SQL}, "bureau": BUREAU_SQL, "installments": INSTALLMENTS_SQL}

# Column kinds, so that both engines end with the same types.
DOUBLES = frozenset(
    """
    AMT_INCOME_TOTAL AMT_CREDIT AMT_ANNUITY AMT_GOODS_PRICE OWN_CAR_AGE CNT_FAM_MEMBERS EXT_SOURCE_1
    EXT_SOURCE_2 EXT_SOURCE_3 DAYS_ENDDATE_FACT AMT_CREDIT_MAX_OVERDUE AMT_CREDIT_SUM
    AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE NUM_INSTALMENT_VERSION
    DAYS_INSTALMENT DAYS_ENTRY_PAYMENT AMT_INSTALMENT AMT_PAYMENT
    """.split()
)
TEXTS = frozenset(
    """
    NAME_CONTRACT_TYPE CODE_GENDER FLAG_OWN_CAR FLAG_OWN_REALTY NAME_FAMILY_STATUS
    NAME_EDUCATION_TYPE ORGANIZATION_TYPE CREDIT_ACTIVE CREDIT_CURRENCY CREDIT_TYPE
    """.split()
)


def typed(name: str, expression: str, double: str) -> str:
    if name in TEXTS:
        return f"{expression} AS {name}"
    return f"CAST({expression} AS {double if name in DOUBLES else 'BIGINT'}) AS {name}"


def _spark(columns: dict[str, str]) -> list[str]:
    days = "datediff(CAST({0} AS DATE), DATE '" + ANCHOR_DATE + "')"
    out = []
    for name, expression in columns.items():
        for source in ("o_orderdate", "l_shipdate"):
            expression = expression.replace(f"date_diff_days({source})", days.format(source))
        out.append(typed(name, expression, "DOUBLE"))
    return out


def raw_columns(name: str, expressions: list[str], text: str) -> list[str]:
    """The typed expressions of a raw table as text, with its bad tokens."""
    out = []
    for column, expression in zip(RAW[name], expressions, strict=True):
        value = f"CAST({expression.removesuffix(f' AS {column}')} AS {text})"
        cases = "".join(f" WHEN {condition} THEN {token}" for condition, token in BAD_TOKENS[name].get(column, ()))
        out.append(f"{f'CASE{cases} ELSE {value} END' if cases else value} AS {column}")
    return out


def raw_text(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A raw table with every token as text, bad tokens and repeated rows included; each source is read once."""
    if name == "application":
        places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    elif name == "bureau":
        rows = table(spark, folder, "orders")
    else:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        rows = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    condition, rewritten = REPEATED[name]
    plain = rows.selectExpr(*raw_columns(name, _spark(RAW[name]), "STRING"), f"IF({condition}, array(0, 1), array(0)) AS copies")
    each = plain.select("*", F.explode("copies").alias("copy")).drop("copies")
    again = F.when(F.col("copy") == 1, F.concat(rewritten, F.lit(".0"))).otherwise(F.col(rewritten))
    return each.withColumn(rewritten, again).drop("copy")


def application(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, folder, "customer")
    return customers.join(places, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(*_spark(APPLICATION_SQL))


def bureau(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*_spark(BUREAU_SQL))


def installments(spark: SparkSession, folder: str) -> DataFrame:
    """Payments; the groupings by loan or instalment that follow keep the layout of this join."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem")
    rows = lines.count()
    lines, orders = spread(lines, rows, "l_orderkey"), spread(orders, rows, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_spark(INSTALLMENTS_SQL))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score with many exact ties and a two-class label per customer."""
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS id",
        "CAST(c_acctbal < 0 AS INT) AS label",
        "CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000D AS score",
    )


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels of documents scored by text length."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return (
        table(spark, folder, "labels")
        .join(documents, "doc_id")
        .selectExpr(
            "doc_id AS id",
            "lang AS family",
            "CAST(quality AS INT) AS label",
            "CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 1000D) AS score",
        )
    )
