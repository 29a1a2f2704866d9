"""Global ranks, running sums and exact quantiles without a one-task window.

Equal values collapse to one counted row. The counted rows are range-partitioned once by the global order and sorted in
their partitions; each partition sums up on its own, and the rows are stored with their partition's number, so that the
partition totals (one row per partition and key it holds) give every partition its offset whatever a later run would
cut differently. Nothing is sketched and no edge of a value reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.session import default_buckets, stored

_B = "_bucket"


def _new_runs(batch: pa.RecordBatch | pa.Table, columns: Sequence[str], last: dict | None) -> np.ndarray:
    """Which rows differ from the row before them in one of the columns; ``last`` is the row before the first."""
    new = np.zeros(batch.num_rows, bool)
    if batch.num_rows:
        new[0] = last is None or any(batch.column(c)[0].as_py() != last[c] for c in columns)
        for c in columns:
            values = batch.column(c)
            same = pc.fill_null(pc.equal(values[1:], values[:-1]), False)
            both_null = pc.and_(pc.is_null(values[1:]), pc.is_null(values[:-1]))
            new[1:] |= ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
    return new


def _restarted(values: np.ndarray, new: np.ndarray, carried: float | int) -> np.ndarray:
    """Running sums that start anew at the marked rows; ``carried`` is what an unmarked first row goes on from."""
    total = np.cumsum(values)
    start = np.flatnonzero(new)
    before = np.zeros(len(values), total.dtype)
    if len(start):
        before[start[0] :] = np.repeat(total[start] - values[start], np.diff(np.append(start, len(values))))
    out = total - before
    out[: start[0] if len(start) else len(values)] += carried
    return out


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in global order over as many partitions as a shuffle has, each named by its number."""
    cut = df.repartitionByRange(default_buckets(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    return cut.withColumn(_B, F.spark_partition_id())


def _offsets(cut: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys, bucket): what lies before each partition, and the totals of the key.

    A key lies in neighbouring partitions, so there are fewer rows than partitions and keys together.
    """
    totals = cut.groupBy(*keys, _B).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, _B,
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(group).alias(f"tot_{m}") for m in measures],
    )


def running_sums(
    df: DataFrame,
    order: str,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums ``cum_<m>`` and group totals ``tot_<m>`` (NULL measures count as 0).

    ``df`` has one row per (keys, order value); keys are not NULL.
    """
    keys, measures = list(keys), list(measures)
    cut = _ranged(df, keys, [F.desc(order) if descending else F.asc(order)])
    sums = [T.StructField(f"_c_{m}", df.schema[m].dataType) for m in measures]
    schema = T.StructType([*cut.schema.fields, *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, dict.fromkeys(measures, 0)
        for b in batches:
            if not b.num_rows:
                continue
            new = _new_runs(b, keys, last)
            out = {m: _restarted(pc.fill_null(b.column(m), 0).to_numpy(zero_copy_only=False), new, carried[m]) for m in measures}
            carried = {m: out[m][-1] for m in measures}
            last = {c: b.column(c)[b.num_rows - 1].as_py() for c in keys}
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(out[m], b.column(m).type) for m in measures)], names=[*b.schema.names, *(f.name for f in sums)])

    summed = stored(cut.mapInArrow(run, schema))
    joined = summed.join(F.broadcast(_offsets(summed, keys, measures)), [*keys, _B])
    return joined.select(
        *df.columns, *[(F.col(f"_c_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures], *[f"tot_{m}" for m in measures])


def tie_ranks(df: DataFrame, value: str, within: str, weight: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the mean rank of each row's value among all rows, ``weight`` rows each, and their number ``<name>_of``.

    Rows are cut by (value, within), so a value that a large share of the rows has lies in many partitions. A partition
    knows the extent of the values inside it; only its first and last value may go on elsewhere, and these, two rows a
    partition at most, are put together and sent to all.
    """
    keys = list(keys)
    cut = _ranged(df, keys, [F.asc(value), F.asc(within)])
    extent = [T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()), T.StructField("_open", T.BooleanType())]
    schema = T.StructType([*cut.schema.fields, *extent])
    by = [*keys, value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows whose value may go on, the running count before them and whether they are the first of the partition
        held, before, first, last = [], 0, True, None

        def closed(end: bool) -> pa.RecordBatch:
            t = pa.concat_batches(held)
            n, size = int(pc.sum(t.column(weight)).as_py() or 0), t.num_rows
            marks = [pa.array(np.full(size, before)), pa.array(np.full(size, before + n)), pa.array(np.full(size, first or end))]
            return pa.RecordBatch.from_arrays([*t.columns, *marks], names=[*t.schema.names, "_from", "_to", "_open"])

        for b in batches:
            if not b.num_rows:
                continue
            new, new_key = _new_runs(b, by, last), _new_runs(b, keys, last)
            starts = np.flatnonzero(new)
            lead = starts[0] if len(starts) else b.num_rows
            if lead:
                held.append(b.slice(0, lead))
            if len(starts):
                if held:
                    yield closed(False)
                    before += sum(int(pc.sum(x.column(weight)).as_py() or 0) for x in held)
                    first = False
                if new_key[starts[0]]:
                    before, first = 0, first if last is None else False
                # all but the last value of the batch end in it
                inner = b.slice(starts[0], starts[-1] - starts[0])
                if inner.num_rows:
                    w = pc.fill_null(inner.column(weight), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    edge = np.append(starts[:-1] - starts[0], inner.num_rows)
                    sums = np.add.reduceat(w, edge[:-1])
                    key_at = new_key[starts[:-1]].copy()
                    ends = _restarted(sums, key_at, 0 if key_at[0] else before)
                    size = np.diff(edge)
                    opening = np.zeros(len(sums), bool)
                    opening[0] = first
                    columns = [pa.array(np.repeat(ends - sums, size)), pa.array(np.repeat(ends, size)), pa.array(np.repeat(opening, size))]
                    yield pa.RecordBatch.from_arrays([*inner.columns, *columns], names=[*inner.schema.names, "_from", "_to", "_open"])
                    before, first = int(ends[-1]), False
                    if new_key[starts[-1]]:
                        before = 0
                held = [b.slice(starts[-1])]
            last = {c: b.column(c)[b.num_rows - 1].as_py() for c in by}
        if held:
            yield closed(True)

    n = f"_o_{weight}"
    summed = stored(cut.mapInArrow(run, schema))
    placed = summed.join(F.broadcast(_offsets(summed, keys, [weight])), [*keys, _B]).select(
        *df.columns, (F.col("_from") + F.col(n)).alias("_from"), (F.col("_to") + F.col(n)).alias("_to"), "_open", F.col(f"tot_{weight}").alias(f"{name}_of"))
    spanning = placed.where("_open").groupBy(*by).agg(F.min("_from").alias("_least"), F.max("_to").alias("_most"))
    both = placed.join(F.broadcast(spanning), by, "left")
    low, high = F.coalesce("_least", "_from"), F.coalesce("_most", "_to")
    return both.select(*df.columns, ((low + high + 1) / 2.0).alias(name), f"{name}_of")


def bucketed_row_number(
    df: DataFrame, bucket: str, order: Sequence[str], keys: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Global ``row_number`` by ``order`` inside ``keys``.

    ``bucket`` is a column that never decreases along ``order`` and spreads the rows evenly.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (
        df.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, bucket])
        .withColumn(name, (F.col("_r") + F.col("_o")).cast("bigint"))
        .drop("_r", "_o")
    )


def quantile_expr(
    value: Column, first: Column, last: Column, total: Column, prob: float
) -> Column:
    """Aggregate expression: linearly interpolated quantile over counted values.

    ``first``/``last`` are the 0-based ranks a row covers in ascending order.
    """
    position = (total.cast("double") - 1.0) * F.lit(float(prob))
    low, high = F.floor(position), F.ceil(position)
    a = F.max(F.when((first <= low) & (low <= last), value))
    b = F.max(F.when((first <= high) & (high <= last), value))
    t = F.max(position - low)
    return a + (b - a) * t


def counted_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct non-NULL values with their counts ``n``; partial counts run before the shuffle."""
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n"))
    )


def ranked_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with count ``n``, running count ``cum_n`` and group size ``tot_n``."""
    return running_sums(counted_values(df, value, keys), value, ["n"], keys)


def summed_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values, NULL and NaN as one of them with ``n`` 0, with running and total counts, sums and missing rows.

    ``n`` counts rows, ``nv`` is their sum of values, ``missing`` counts rows without a value. All that a summary needs
    comes from these rows, so the input is read once.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = df.select(*keys, v.alias(value)).groupBy(*keys, value).agg(F.count("*").alias("rows"))
    known = F.col(value).isNotNull()
    counts = counts.select(
        *keys, value, F.when(known, F.col("rows")).otherwise(0).alias("n"), F.when(known, F.col("rows") * F.col(value)).otherwise(0.0).alias("nv"),
        F.when(known, 0).otherwise(F.col("rows")).cast("bigint").alias("missing"))
    return running_sums(counts, value, ["n", "nv", "missing"], keys)


def moment_columns(value: str) -> list[Column]:
    """Aggregates over summed values: rows, observed, missing, zero and distinct counts, moments, range, modal count."""
    c, v = F.col, F.col(value)
    n, mean = F.max("tot_n"), c("tot_nv") / F.nullif(c("tot_n"), F.lit(0))
    square = F.sum(c("n") * (v - mean) * (v - mean))
    return [
        (n + F.max("tot_missing")).alias("row_count"), n.alias("observed_count"), F.max("tot_missing").alias("missing_count"),
        F.coalesce(F.sum(F.when(v == 0, c("n"))), F.lit(0)).alias("zero_count"), F.max(mean).alias("mean"),
        F.sqrt(square / F.nullif(n - 1, F.lit(0))).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count(v).alias("unique_count"), F.max(F.when(v.isNotNull(), c("n")).otherwise(0)).alias("modal_count"),
    ]


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """Exact interpolated quantiles per key; one output column per entry of ``probs``."""
    return ranked_values(df, value, keys).groupBy(*keys).agg(*quantile_columns(value, probs), *extra)


def quantile_columns(value: str, probs: dict[str, float]) -> list[Column]:
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    return [
        quantile_expr(F.col(value), first, last, F.col("tot_n"), p).alias(name)
        for name, p in probs.items()
    ]


def order_statistic(df: DataFrame, value: str, k: int) -> float | int:
    """The k-th smallest value of a column of unique integers (1-based)."""
    ranked = ranked_values(df, value)
    hit = (F.col("cum_n") - F.col("n") < k) & (F.col("cum_n") >= k)
    return ranked.where(hit).select(value).first()[0]
