"""Deterministic stratified split and folds, by keyed hash order inside each class."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrain.operators.ranking import bucketed_row_number
from riskgrain.schemas import ID, SPLIT, SPLITS, TARGET, ContractError, require_columns

DEFAULT_RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
DEFAULT_SEED = 42


def apportion(total: int, weights: Sequence[float]) -> list[int]:
    """Largest-remainder shares of ``total``; equal remainders go to the lower index."""
    exact = np.asarray(weights, float) * total
    floor = np.floor(exact).astype(int)
    rest, place = exact - floor, np.arange(len(exact))
    before = (rest > rest[:, None]) | ((rest == rest[:, None]) & (place < place[:, None]))
    return [int(n) for n in floor + (before.sum(axis=1) < total - floor.sum())]


def check_ratios(ratios: Mapping[str, float]) -> dict[str, float]:
    values = {k: float(v) for k, v in ratios.items()}
    if any(not math.isfinite(v) or v <= 0 for v in values.values()):
        raise ContractError("split ratios must be finite and positive")
    if not math.isclose(sum(values.values()), 1.0, abs_tol=1e-12):
        raise ContractError("split ratios must sum to 1")
    return values


class PartLimit(NamedTuple):
    """The ranks ``above < rank <= upto`` of one class go to one part."""

    label: int
    part: str
    above: int
    upto: int


def class_limits(negatives: int, positives: int, ratios: Mapping[str, float]) -> list[PartLimit]:
    """Cumulative rank limits per class. Parts get their share of all rows; positives follow the parts' sizes."""
    sizes = np.array(apportion(negatives + positives, list(ratios.values())))
    ones = np.array(apportion(positives, sizes / sizes.sum()))
    if (sizes < 1).any() or (ones > sizes).any():
        raise ContractError("too few rows of a class for the parts")
    return [
        PartLimit(label, part, int(end - n), int(end))
        for label, counts in ((0, sizes - ones), (1, ones))
        for part, n, end in zip(ratios, counts, np.cumsum(counts), strict=True)
    ]


def sha_key(seed: int, id_column: str = ID) -> Column:
    """Ranking key a SQL engine can reproduce: SHA-256 of ``seed:id`` in hex."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")), 256)


def blake_key(seed: int, person: bytes, id_column: str = ID) -> Column:
    """Ranking key as 128-bit BLAKE2b of ``seed:id`` under a caller-given person string."""

    @F.pandas_udf("string")
    def digest(ids: pd.Series) -> pd.Series:
        prefix = f"{seed}:"
        return ids.map(
            lambda i: hashlib.blake2b(f"{prefix}{i}".encode("ascii"), digest_size=16, person=person).hexdigest()
        )

    return digest(F.col(id_column))


def class_ranks(
    customers: DataFrame, key: Column, id_column: str = ID, target: str = TARGET, hex_digits: int = 3
) -> DataFrame:
    """Rank each row inside its class by (key, id); ``hex_digits`` of the key cut 16 ** hex_digits even buckets."""
    keyed = customers.select(id_column, target, key.alias("_key"))
    cut = keyed.withColumn("_hash_bucket", F.substring("_key", 1, hex_digits))
    return bucketed_row_number(cut, "_hash_bucket", ["_key", id_column], [target]).select(
        id_column, target, "rank"
    )


def class_counts(customers: DataFrame, id_column: str = ID, target: str = TARGET) -> tuple[int, int]:
    """Negatives and positives, after checking the key and label contract (two-row result)."""
    bad = F.count_if(F.col(target).isNull() | ~F.col(target).isin(0, 1) | F.col(id_column).isNull())
    ids = customers.groupBy(id_column).agg(
        F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("p"), bad.alias("bad")
    )
    r = ids.agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("bad").alias("bad"), F.max("n").alias("copies")
    ).first()
    if not r["n"]:
        raise ContractError("no customers to split")
    if r["bad"]:
        raise ContractError("customer id and label must be present and the label 0 or 1")
    if r["copies"] > 1:
        raise ContractError("a customer id appears more than once")
    if not 0 < r["p"] < r["n"]:
        raise ContractError("both classes are needed")
    return int(r["n"] - r["p"]), int(r["p"])


def stratified_split(
    customers: DataFrame,
    seed: int = DEFAULT_SEED,
    ratios: Mapping[str, float] | None = None,
    key: Column | None = None,
    id_column: str = ID,
    target: str = TARGET,
) -> DataFrame:
    """Assign each customer to a part; independent of row order and partitioning."""
    shares = check_ratios(ratios or DEFAULT_RATIOS)
    require_columns(customers, (id_column, target), "customers")
    limits = class_limits(*class_counts(customers, id_column, target), shares)
    ranked = class_ranks(customers, key if key is not None else sha_key(seed, id_column), id_column, target)
    part = F.lit(None).cast("string")
    for x in limits:
        inside = (F.col(target) == x.label) & (F.col("rank") > x.above) & (F.col("rank") <= x.upto)
        part = F.when(inside, x.part).otherwise(part)
    return ranked.select(id_column, target, part.alias(SPLIT))


def stratified_folds(
    customers: DataFrame, k: int, seed: int, id_column: str = ID, target: str = TARGET
) -> DataFrame:
    """Fold number 1..k per row; every class is dealt round-robin in hash order."""
    if k < 2:
        raise ContractError("at least two folds are needed")
    if min(class_counts(customers, id_column, target)) < k:
        raise ContractError("the smaller class has fewer rows than folds")
    ranked = class_ranks(customers, sha_key(seed, id_column), id_column, target)
    return ranked.select(id_column, target, ((F.col("rank") - 1) % k + 1).cast("int").alias("fold"))


def holdout_split(
    customers: DataFrame, fraction: float, seed: int, id_column: str = ID, target: str = TARGET
) -> DataFrame:
    """Inner fit / hold-out split of the same stratified kind."""
    return stratified_split(
        customers, seed, {"fit": 1.0 - fraction, "holdout": fraction}, None, id_column, target
    )


def check_split(customers: DataFrame, assignments: DataFrame, ratios: Mapping[str, float] | None = None) -> DataFrame:
    """One row of violation counts: exclusive, complete, label kept, names valid, counts exact."""
    shares = check_ratios(ratios or DEFAULT_RATIOS)
    limits = class_limits(*class_counts(customers), shares)
    a = assignments.groupBy(ID).agg(
        F.count("*").alias("copies"), F.min(TARGET).alias("_t"), F.min(SPLIT).alias("_split")
    )
    c = customers.select(ID, F.col(TARGET).alias("_source"))
    joined = c.join(a, ID, "full_outer")
    counted = [F.count_if((F.col("_t") == x.label) & (F.col("_split") == x.part)) for x in limits]
    total = sum((F.abs(n - (x.upto - x.above)) for n, x in zip(counted, limits, strict=True)), F.lit(0))
    return joined.agg(
        F.count_if(F.col("copies") > 1).alias("duplicate_ids"),
        F.count_if(F.col("_source").isNull() | F.col("copies").isNull()).alias("unmatched_ids"),
        F.count_if(F.col("_source") != F.col("_t")).alias("label_changes"),
        F.count_if(F.col("copies").isNotNull() & (F.col("_split").isNull() | ~F.col("_split").isin(*shares))).alias("bad_names"),
        total.alias("count_deviation"),
    )


def split_target_counts(assignments: DataFrame) -> DataFrame:
    """Rows per split and class with empty cells kept as zero."""
    per = assignments.groupBy(SPLIT).agg(
        F.count_if(F.col(TARGET) == 0).alias("n0"), F.count_if(F.col(TARGET) == 1).alias("n1")
    )
    spark = assignments.sparkSession
    grid = spark.createDataFrame([(s,) for s in SPLITS], f"{SPLIT} string")
    full = grid.join(per, SPLIT, "left").fillna(0, ["n0", "n1"])
    cells = F.explode(
        F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{t}").alias("n")) for t in (0, 1)])
    )
    return full.select(SPLIT, (F.col("n0") + F.col("n1")).alias("split_rows"), cells.alias("c")).select(
        SPLIT, F.col("c.t").alias(TARGET), F.col("c.n").alias("row_count"), "split_rows"
    )


def split_summary(assignments: DataFrame) -> DataFrame:
    """Rows, shares and label rates per split against the overall rate."""
    overall = assignments.agg(F.count("*").alias("n"), F.avg(F.col(TARGET).cast("double")).alias("rate"))
    n, rate = overall.select("n").scalar(), overall.select("rate").scalar()
    per = assignments.groupBy(SPLIT).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(TARGET) == 0).alias("target_0"),
        F.count_if(F.col(TARGET) == 1).alias("target_1"),
    )
    return per.select(
        "*",
        (F.col("row_count") / n).alias("row_ratio"),
        (F.col("target_1") / F.col("row_count")).alias("target_rate"),
        (F.col("target_1") / F.col("row_count") - rate).alias("rate_difference"),
    )


def assignment_digest(assignments: DataFrame) -> DataFrame:
    """Order-independent digest: row count and the sums of the eight 32-bit slices of the rows' SHA-256."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in (ID, TARGET, SPLIT)])
    row = F.sha2(line, 256)
    sums = [F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    return assignments.agg(F.count("*").alias("row_count"), F.concat_ws("-", *[F.coalesce(x, F.lit(0)).cast("string") for x in sums]).alias("digest"))


def seal_test(split: str) -> str:
    """Refuse any request for the sealed test part."""
    if split not in SPLITS:
        raise ContractError(f"unknown split {split!r}")
    if split == "test":
        raise ContractError("the test split is sealed")
    return split


def sealed(scored: DataFrame) -> DataFrame:
    """``scored``, which carries its part; a row of the sealed part, or of none, fails the task that meets it.

    The test runs with the scan and needs no join or second job.
    """
    open_part = F.coalesce(F.col(SPLIT).isin(*[p for p in SPLITS if p != "test"]), F.lit(False))
    message = F.concat(F.lit("the test split is sealed: part "), F.coalesce(F.col(SPLIT), F.lit("unknown")))
    return scored.withColumn(SPLIT, F.when(open_part, F.col(SPLIT)).otherwise(F.raise_error(message)))


def part_reconciliation(parts: dict[str, DataFrame], assignments: DataFrame) -> DataFrame:
    """(check_name, value): how the customers of several parts agree with the assignment, in one shuffle of ids.

    Counts customers in two parts, of the sealed part, unknown ones, changed labels, and per part those that belong
    elsewhere or are absent.
    """
    c, names = F.col, list(parts)
    tagged = [assignments.select(ID, F.lit("").alias("_in"), c(TARGET).cast("int").alias("_y"), c(SPLIT).alias("_p"))]
    tagged += [df.select(ID, F.lit(n).alias("_in"), c(TARGET).cast("int").alias("_y"), F.lit(None).cast("string").alias("_p")) for n, df in parts.items()]
    per = reduce(DataFrame.unionByName, tagged).groupBy(ID).agg(
        F.max("_p").alias("part"), F.max(F.when(c("_in") == "", c("_y"))).alias("y"),
        *[F.count_if(c("_in") == n).alias(f"n_{n}") for n in names],
        *[f(F.when(c("_in") != "", c("_y"))).alias(k) for k, f in (("lo", F.min), ("hi", F.max))])
    inside = {n: c(f"n_{n}") > 0 for n in names}
    seen = reduce(lambda a, b: a | b, inside.values())
    several = reduce(lambda a, b: a + b, [i.cast("int") for i in inside.values()]) > 1
    checks = {
        "shared_ids": several,
        "sealed_ids": seen & (c("part") == "test"),
        "unknown_ids": seen & c("part").isNull(),
        "label_changes": seen & ((c("lo") != c("y")) | (c("hi") != c("y"))),
        **{f"misplaced_in_{n}": i & (c("part") != n) for n, i in inside.items()},
        **{f"absent_from_{n}": ~i & (c("part") == n) for n, i in inside.items()},
    }
    one = per.agg(*[F.count_if(p).alias(k) for k, p in checks.items()])
    return one.unpivot([], list(checks), "check_name", "value")


def check_parts(reconciled: DataFrame) -> None:
    """Raise if parts share customers, hold sealed or unknown ones, or changed a label."""
    broken = [r["check_name"] for r in reconciled.collect() if r["value"] and not r["check_name"].startswith("absent")]
    if broken:
        raise ContractError(f"parts break the assignment: {broken}")


def version_alignment(versions: dict[str, DataFrame]) -> DataFrame:
    """(pair, row_count, id_differences, value_differences) of neighbouring mart versions, in one shuffle of narrow rows."""
    c, names = F.col, list(versions)
    tagged = [df.select(ID, F.lit(k).alias("_v"), F.concat_ws("\u0000", c(TARGET).cast("string"), c(SPLIT)).alias("_x")) for k, df in enumerate(versions.values())]
    per = reduce(DataFrame.unionByName, tagged).groupBy(ID).agg(
        *[F.count_if(c("_v") == k).alias(f"n{k}") for k in range(len(names))],
        *[F.min(F.when(c("_v") == k, c("_x"))).alias(f"x{k}") for k in range(len(names))])
    cells = [F.struct(
        F.lit(f"{a}_{b}").alias("pair"), c(f"n{k}").alias("n"), (c(f"n{k}") != c(f"n{k + 1}")).alias("alone"), (c(f"x{k}") != c(f"x{k + 1}")).alias("differs"))
        for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    return per.select(F.inline(F.array(*cells))).groupBy("pair").agg(
        F.sum("n").alias("row_count"), F.count_if("alone").alias("id_differences"), F.count_if("differs").alias("value_differences"))
