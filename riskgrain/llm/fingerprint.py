"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so sketches of very unequal texts
can be compared (containment) and merged (union). Words are runs without white space, A-Z lower-cased; a shingle is
five consecutive words, or all words of a shorter text. A text that has shingles, but none below the fraction, keeps its
smallest hash; merging keeps that rule, so the merged sketch is the one of all texts together. A null text counts as
empty; texts without words have the empty sketch.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import LOWER, byte_class, free_name, small_batches, spans_hash, text_pieces, whole, words_of
from riskgrain.session import default_buckets, small_table

#: Words of a shingle.
SIZE = 5
#: One in so many shingle hashes is kept.
SCALE = 8
#: Bits of a shingle hash.
BITS = 60
#: The hash of a shingle is the sum of its words' hashes times the power of this odd number at their place.
MULTIPLIER = 1_000_003
#: Word hashes a task remembers before it starts afresh.
REMEMBERED = 1 << 18

WORD_BYTES = ~byte_class((9, 13), (32, 32))
_U = np.uint64


def word_hash(word: bytes) -> int:
    """The first 60 bits of the word's MD5, which SQL can compute too."""
    return int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:15], 16)


class Shingler:
    """Shingle hashes of texts; remembers the hashes of words it has met."""

    def __init__(self, size: int = SIZE):
        self.powers = np.array([pow(MULTIPLIER, k, 1 << BITS) for k in range(size)], np.uint64)
        self.known: dict[int, int] = {}

    def _word_hashes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        names, at, back = np.unique(spans_hash(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known = {}
        raw, known, out = low.tobytes(), self.known, np.empty(len(names), np.uint64)
        for k, (name, a, b) in enumerate(zip(names.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)):
            h = known.get(name)
            if h is None:
                h = known[name] = word_hash(raw[a:b])
            out[k] = h
        return out[back]

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All shingle hashes of each row in one flat array, and the row of each."""
        low, size = LOWER[data], len(self.powers)
        starts, ends, first = words_of(low, offsets, WORD_BYTES)
        w, words = self._word_hashes(low, starts, ends), np.diff(first)
        grams = np.where(words >= size, words - size + 1, np.minimum(words, 1))
        row = np.repeat(np.arange(len(words)), grams)
        at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + first[:-1][row]
        took = np.minimum(words, size)[row]
        h = np.zeros(len(row), np.uint64)
        for k in range(size):
            have = k < took
            h[have] += w[at[have] + k] * self.powers[k]
        return h & _U((1 << BITS) - 1), row

    def sketches(self, column: pa.Array, scale: int) -> pa.Array:
        """The sketch of each row as a sorted list."""
        lists, flat, filled = [np.zeros(1, np.int64)], [], 0
        for _, _, data, offsets in text_pieces(column):
            h, row = self.hashes(data, offsets)
            low = h < _U((1 << BITS) // scale)
            bare = np.ones(len(offsets) - 1, bool)
            bare[row[low]] = False
            # rows whose shingles all lie above the fraction keep the smallest one
            order = np.lexsort((h, row))
            order = order[low[order] | (bare[row[order]] & np.concatenate(([True], row[order][1:] != row[order][:-1])))[: len(order)]]
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            flat.append(h.astype(np.int64))
            lists.append(filled + np.searchsorted(row, np.arange(1, len(offsets))))
            filled += len(h)
        values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(lists), pa.int32()), pa.array(values, pa.int64()))


def fingerprints(df: DataFrame, texts: dict[str, str], *, scale: int = SCALE, size: int = SIZE) -> DataFrame:
    """``df`` with a sketch (sorted ``array<bigint>``) of each text column: text column -> name of its sketch.

    Names must be free. Rows, repeated ones too, stay as they are; null texts have the empty sketch.
    """
    taken = {c.lower() for c in df.columns}
    if clash := [o for o in texts.values() if o.lower() in taken]:
        raise ValueError(f"columns exist already: {clash}")
    small_batches(df.sparkSession)
    at = {df.columns.index(c): out for c, out in texts.items()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(o, T.ArrayType(T.LongType(), False)) for o in texts.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in batches:
            added = [shingler.sketches(b.column(i), scale) for i in at]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *at.values()])

    return df.mapInArrow(run, schema)


def jaccard(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketch columns; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: str, b: str) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; an empty sketch is contained in any."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def spelled(sketch: str) -> Column:
    """A sketch as text: its hashes in ascending order, fifteen hex digits each, comma-joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), ",")


def merged(df: DataFrame, by: str, sketch: str, *, scale: int = SCALE) -> DataFrame:
    """(by, sketch): the sketch of all texts of a group together, one row per hash until the last step's list of them.

    Null and equal keys group as in SQL; a group of empty sketches has the empty one. Hashes are combined before the
    shuffle, so a group of many copies costs no more than its distinct hashes.
    """
    h, low = free_name(df, "hash"), F.lit((1 << BITS) // scale)
    each = df.select(by, F.explode_outer(sketch).alias(h)).distinct()
    kept = each.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col(h) < low, F.col(h)))).alias("_low"), F.min(h).alias("_least"))
    bare = F.when(F.col("_least").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("_least"))
    return kept.select(by, F.when(F.size("_low") > 0, F.col("_low")).otherwise(bare).alias(sketch))


def with_next(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """(key, text, out): each row's text and that of the row after it in descending order of the key.

    The last row's next is the first. Rows of equal keys follow each other by a hash of their text, null keys come
    last, null texts count as empty; a single row is its own next. Rows must come in an order that a second reading
    repeats, as from files.

    The key ranges are cut on a narrow table, so that one key with many rows is cut too. Then all rows move once, with
    a copy of the first row of each range for the range before it.
    """
    spark, n = df.sparkSession, default_buckets(df.sparkSession)
    small_batches(spark)
    rows = df.select(F.col(key).alias("key"), whole(text).alias("text")).select(
        "key", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place")
    )
    order = [F.desc_nulls_last("key"), F.desc("h"), F.desc("place")]
    cut = rows.select("key", "h", "place").repartitionByRange(n, *order)
    # the first row of each range: as many rows as partitions
    first = [r["first"] for r in cut.groupBy(F.spark_partition_id().alias("range")).agg(F.max(F.struct("key", "h", "place")).alias("first")).collect()]
    # null keys come before all others in this ascending list
    name = lambda key, h, place: (1, key, h, place) if key is not None else (0, 0, h, place)
    starts = sorted(name(*f) for f in first)

    @F.arrow_udf("int")
    def range_of(keys: pa.Array, h: pa.Array, place: pa.Array) -> pa.Array:
        rows = zip(keys.to_pylist(), h.to_pylist(), place.to_pylist(), strict=True)
        return pa.array([len(starts) - 1 - bisect_left(starts, name(*r)) for r in rows], pa.int32())

    dealt = rows.withColumn("range", range_of("key", "h", "place")).withColumn("guest", F.lit(False))
    kind = df.schema[key].dataType.simpleString()
    # what starts a range ends the one before it
    heads = [(k[1] if k[0] else None, k[2], k[3], (len(starts) - 2 - i) % len(starts)) for i, k in enumerate(starts)]
    if heads:
        guests = small_table(spark, heads, f"k {kind}, x bigint, p bigint, range int")
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("x")) & (F.col("place") == F.col("p"))
        dealt = dealt.unionByName(rows.join(guests, same).select("key", "text", "h", "place", "range", F.lit(True).alias("guest")))
    moved = dealt.repartitionById(max(1, len(starts)), "range").sortWithinPartitions("range", "guest", *order)
    schema = T.StructType([df.schema[key], T.StructField(text, T.StringType()), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = b if held is None else pa.concat_batches([held, b])
            m = len(held) - 1
            ranges = held.column(2).to_numpy()
            pair = pa.array(ranges[:-1] == ranges[1:])
            parts = [held.column(0)[:m], held.column(1)[:m], held.column(1)[1:]]
            yield pa.RecordBatch.from_arrays(parts, names=[key, text, out]).filter(pair)
            held = held[m:]

    return moved.select("key", "text", "range").mapInArrow(run, schema)


def edited(text: str, following: str) -> Column:
    """The text whose last half, rounded down, gives way to as much of the start of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
