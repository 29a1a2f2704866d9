"""Isotonic regression by pools: equal scores first, then neighbours that break the order, range by range.

Every range of scores pools its own neighbours; while pools on both sides of a cut break the order, half as many ranges
are cut anew from the pools that are left. Pooling neighbours that break it, in whatever sequence, ends at the one
least-squares solution, so the result does not depend on the cuts. A task keeps the pools of its range, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrain.schemas import ContractError
from riskgrain.session import default_buckets, stored

#: Pools that one task may finish on its own, or that may be sent to all tasks.
FEW = 50_000
_POOL = "low double, high double, total double, weight double"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools of a run of pools in order of scores: a pool takes in the ones before it while their mean is not smaller."""
    kept: list[list[float]] = []
    for b in batches:
        for low, high, total, weight in zip(*(b.column(c).to_pylist() for c in ("low", "high", "total", "weight")), strict=True):
            while kept and kept[-1][2] * weight >= total * kept[-1][3]:
                low, _, t, w = kept.pop()
                total, weight = total + t, weight + w
            kept.append([low, high, total, weight])
    if kept:
        yield pa.RecordBatch.from_pydict({c: pa.array([k[i] for k in kept], pa.float64()) for i, c in enumerate(("low", "high", "total", "weight"))})


def _pass(pools: DataFrame, ranges: int) -> DataFrame:
    cut = pools.repartitionByRange(ranges, "low").sortWithinPartitions("low").select("low", "high", "total", "weight")
    marked = cut.mapInArrow(_pooled, _POOL).withColumn("range", F.spark_partition_id())
    return stored(marked)


def isotonic_pools(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(low, high, value, weight): the scores each pool spans and its mean label, values ascending with the scores.

    Rows without label or score count nothing. No rows give no pools.
    """
    y, x = F.col(label).cast("double"), F.col(score).cast("double")
    each = rows.where(y.isNotNull() & x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("low")).agg(F.sum(y).alias("total"), F.count("*").cast("double").alias("weight"))
    ranges = default_buckets(rows.sparkSession)
    pools = _pass(each.select("low", F.col("low").alias("high"), "total", "weight"), ranges)
    while ranges > 1:
        # two rows a range: its first and last pool
        end = F.struct("low", "total", "weight")
        ends = pools.groupBy("range").agg(F.count("*").alias("n"), F.min(end).alias("first"), F.max(end).alias("last"))
        before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("first.low"))
        pairs = ends.select("n", "first", before.alias("last"))
        falls = F.col("last.total") * F.col("first.weight") >= F.col("first.total") * F.col("last.weight")
        seen = pairs.agg(F.sum("n").alias("n"), F.count_if(falls).alias("broken")).first()
        if not seen["broken"]:
            break
        # half as many ranges, so that the cuts lie elsewhere and in the end there are none
        ranges = 1 if seen["n"] <= FEW else ranges // 2
        pools = _pass(pools, ranges)
    mean = F.col("total") / F.col("weight")
    return pools.select("low", "high", mean.alias("value"), "weight")


def calibrate(df: DataFrame, pools: DataFrame, score: str = "score", out: str = "calibrated") -> DataFrame:
    """``df`` with the calibrated score: a pool's value inside it, linear between two pools, the outermost value beyond them.

    At most ``FEW`` pools are sent to all tasks; more are joined by pieces of the interval the pools span. A null score
    stays null, and without pools all do. ``out`` must be a free name.
    """
    if out in df.columns:
        raise ContractError(f"column exists already: {out}")
    x = F.col(score).cast("double")
    span = pools.agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("low").alias("high")).first()
    if span["n"] <= FEW:
        kept = sorted((r["low"], r["high"], r["value"]) for r in pools.select("low", "high", "value").collect())
        points = [(p, v) for low, high, v in kept for p in ([low] if low == high else [low, high])]
        sent = df.sparkSession.sparkContext.broadcast(np.array(points, np.float64).reshape(-1, 2))

        @F.arrow_udf("double")
        def placed(values: pa.Array) -> pa.Array:
            at = sent.value
            if not len(at):
                return pa.nulls(len(values), pa.float64())
            gone = values.is_null().to_numpy(zero_copy_only=False)
            found = np.interp(values.fill_null(0.0).to_numpy(zero_copy_only=False), at[:, 0], at[:, 1])
            return pa.array(np.clip(found, 0.0, 1.0), mask=gone)

        return df.withColumn(out, placed(x))
    c, n = F.col, int(span["n"])
    width = (span["high"] - span["low"]) / n or 1.0
    piece = lambda v: F.least(F.lit(n), F.greatest(F.lit(0), F.floor((v - F.lit(span["low"])) / F.lit(width)))).cast("int")
    spans = _followed(pools).select(
        c("low").alias("_low"), c("high").alias("_high"), c("value").alias("_value"), c("next_low").alias("_next_low"), c("next_value").alias("_next_value"),
        (c("low") == F.lit(span["low"])).alias("_opens"), F.explode(F.sequence(piece(c("low")), F.when(c("next_low").isNotNull(), piece(c("next_low"))).otherwise(n))).alias("_piece"))
    inside = ((x >= c("_low")) | c("_opens")) & (c("_next_low").isNull() | (x < c("_next_low")))
    joined = df.withColumn("_at", piece(x)).join(spans, (c("_at") == c("_piece")) & inside, "left")
    share = (x - c("_high")) / (c("_next_low") - c("_high"))
    value = F.when((x > c("_high")) & c("_next_low").isNotNull(), c("_value") + share * (c("_next_value") - c("_value"))).otherwise(c("_value"))
    return joined.select(*[F.col(k) for k in df.columns], F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias(out))


def _followed(pools: DataFrame) -> DataFrame:
    """Each pool with the one after it, by ranges: only the first pool of a range is looked up from elsewhere."""
    n = default_buckets(pools.sparkSession)
    cut = stored(pools.repartitionByRange(n, "low").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("low")
    firsts = cut.groupBy("range").agg(F.min(F.struct("low", "value")).alias("first"))
    before = firsts.select(F.lag("range").over(Window.partitionBy(F.lit(0)).orderBy("range")).alias("range"), F.col("first.low").alias("_l"), F.col("first.value").alias("_v"))
    own = cut.select("*", F.lead("low").over(inside).alias("_nl"), F.lead("value").over(inside).alias("_nv"))
    joined = own.join(F.broadcast(before), "range", "left")
    return joined.select("low", "high", "value", "weight", F.coalesce("_nl", "_l").alias("next_low"), F.coalesce("_nv", "_v").alias("next_value"))
