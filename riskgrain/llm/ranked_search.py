"""Ranked lexical search: posting lists with range-maximum sparse tables.

The index is a table of shards; a shard holds the posting lists of a run of documents, shortest document first. Searching
a shard, an interval of documents is bounded by the sum of each term's highest impact in it, which a sparse table gives
in two look-ups a term. The best intervals are taken first and split at the document of the highest single impact, whose
score is computed exactly; small ones are scored whole. What is bounded below the k-th best score so far is left.

Terms are runs of ASCII letters and digits and of all code points from U+0080, A-Z lower-cased. Documents without terms
(null and empty texts) take no part. Each row of the items is ranked on its own, under a null or repeated key too; of
documents with equal scores the smaller key comes first, a null one before all others. Repeated documents all rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import LOWER, byte_class, settle, small_batches, spans_hash, text_pieces, unsettle, words_of

#: Text bytes of a shard; one longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Distinct item terms searched at once: the block of items sent to the tasks has about as many.
BLOCK_TERMS = 1 << 20
#: Documents of an interval that is scored whole.
LEAF = 64
#: Intervals taken at once.
TAKEN = 32

TERM_BYTES = byte_class((48, 57), (97, 122), (128, 255))
_U = np.uint64


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term occurrence, and the number of them per row."""
    low = LOWER[data]
    starts, ends, first = words_of(low, offsets, TERM_BYTES)
    return spans_hash(low, starts, ends), np.diff(first)


def build_index(docs: DataFrame, key: str, text: str, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The settled index of all documents with terms, one row a shard.

    ``keys`` of its documents, ``sizes`` their numbers of terms, ``names`` the hashes of its terms, ``starts`` of their
    lists in ``rows`` (documents by place) and ``times`` (occurrences).
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    binary = ("sizes", "names", "starts", "rows", "times")
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in binary), T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())])

    def shard(keys: list[pa.Array], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch | None:
        n, h = np.concatenate(counts), np.concatenate(hashes)
        if not len(h):
            return None
        named = pa.concat_arrays(keys).filter(pa.array(n > 0))
        place = np.repeat(np.cumsum(n > 0) - 1, n)
        n = n[n > 0]
        order = np.argsort(n, kind="stable")  # documents alike in length have alike impacts
        back = np.empty(len(n), np.int64)
        back[order] = np.arange(len(n))
        names, number = np.unique(h, return_inverse=True)
        pair, times = np.unique(number * len(n) + back[place], return_counts=True)
        starts = np.searchsorted(pair, np.arange(len(names) + 1) * len(n))
        parts = (n[order].astype(np.int32), names, starts.astype(np.int32), (pair % len(n)).astype(np.int32), times.astype(np.int32))
        column = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), named.take(pa.array(order)))
        return pa.RecordBatch.from_arrays(
            [column, *(pa.array([p.tobytes()], pa.binary()) for p in parts), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())],
            names=["keys", *binary, "n_docs", "n_terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled = ([], [], []), 0
        for b in batches:
            for at, end, data, offsets in text_pieces(b.column(1)):
                if filled and filled + len(data) > shard_bytes:
                    if (row := shard(*held)) is not None:
                        yield row
                    held, filled = ([], [], []), 0
                h, n = _terms(data, offsets)
                for kept, part in zip(held, (b.column(0)[at:end], h, n), strict=True):
                    kept.append(part)
                filled += len(data)
        if held[0] and (row := shard(*held)) is not None:
            yield row

    return settle(docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema))


class Shard:
    """The lists of a shard for the terms asked for, with impacts and their sparse table."""

    def __init__(self, row: dict, vocabulary: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        names, starts = np.frombuffer(row["names"], _U), np.frombuffer(row["starts"], np.int32).astype(np.int64)
        at = np.minimum(np.searchsorted(names, vocabulary), max(len(names) - 1, 0))
        have = names[at] == vocabulary if len(names) else np.zeros(len(vocabulary), bool)
        #: the list of each asked term, -1: none here
        self.list_of = np.where(have, np.cumsum(have) - 1, -1)
        low, high = starts[at[have]], starts[at[have] + 1]
        self.starts = np.concatenate(([0], np.cumsum(high - low)))
        took = np.arange(self.starts[-1]) + np.repeat(low - self.starts[:-1], high - low)
        self.rows = np.frombuffer(row["rows"], np.int32)[took].astype(np.int64)
        times = np.frombuffer(row["times"], np.int32)[took].astype(np.int64)
        m = 50 + (50 * self.sizes * n_docs) // n_terms
        self.impacts = np.repeat(weights[have], high - low) * ((1_000_000_000 * times) // (1000 * times + 20 * m[self.rows]))
        #: lists and documents as one ascending sequence
        self.places = np.repeat(np.arange(len(low)), high - low) * len(self.sizes) + self.rows
        self.table = [np.arange(len(self.rows), dtype=np.int32)]
        span = 1
        while 2 * span <= int((high - low).max(initial=0)):
            a, b = self.table[-1][:-span], self.table[-1][span:]
            self.table.append(np.where(self.impacts[b] > self.impacts[a], b, a))
            span *= 2

    def highest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the highest impact of each range lies; ranges are not empty and inside one list."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            a, b = self.table[k][low[at]], self.table[k][high[at] - (1 << k)]
            out[at] = np.where(self.impacts[b] > self.impacts[a], b, a)
        return out

    def bound(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals given by each list's range (interval x list): their bounds and documents of highest impact."""
        some = high > low
        top = np.zeros(low.shape, np.int64)
        where = np.zeros(low.shape, np.int64)
        where[some] = self.highest(low[some], high[some])
        top[some] = self.impacts[where[some]]
        return top.sum(axis=1), self.rows[where[np.arange(len(low)), top.argmax(axis=1)]]

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores), at least those of the k highest scores (ties included) that are ``least`` or more."""
        lists = self.list_of[terms]
        lists = lists[lists >= 0]
        none = np.zeros(0, np.int64)
        if not len(lists):
            return none, none
        first = np.zeros(1, np.int64)
        # an interval: its ends, each list's range in it, its bound and where it splits
        a, b, low, high = first, first + len(self.sizes), self.starts[lists][None], self.starts[lists + 1][None]
        bound, split = self.bound(low, high)
        docs, scores, floor = [none], [none], max(least, 1)
        while len(a):
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] >= floor]
            now, rest = order[:TAKEN], order[TAKEN:]
            small = now[b[now] - a[now] <= LEAF]
            wide = now[b[now] - a[now] > LEAF]
            for i in small:
                got = np.zeros(b[i] - a[i], np.int64)
                for x, y in zip(low[i].tolist(), high[i].tolist(), strict=True):
                    if y > x:
                        got[self.rows[x:y] - a[i]] += self.impacts[x:y]
                good = np.flatnonzero(got >= floor)
                docs.append(good + a[i])
                scores.append(got[good])
            d, lw, hw = split[wide], low[wide], high[wide]
            at = np.searchsorted(self.places, lists[None] * len(self.sizes) + d[:, None])
            at = np.clip(at, lw, hw)
            has = (at < hw) & (self.rows[np.minimum(at, len(self.rows) - 1)] == d[:, None])
            got = np.where(has, self.impacts[np.minimum(at, len(self.rows) - 1)], 0).sum(axis=1)
            docs.append(d[got >= floor])
            scores.append(got[got >= floor])
            found = np.concatenate(scores)
            if len(found) >= k:
                floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
            a, b = np.concatenate((a[rest], a[wide], d + 1)), np.concatenate((b[rest], d, b[wide]))
            new_low, new_high = np.concatenate((lw, at + has)), np.concatenate((at, hw))
            new_bound, new_split = self.bound(new_low, new_high) if len(new_low) else (none, none)
            low, high = np.concatenate((low[rest], new_low)), np.concatenate((high[rest], new_high))
            bound, split = np.concatenate((bound[rest], new_bound)), np.concatenate((split[rest], new_split))
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        return docs[scores >= floor], scores[scores >= floor]


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): the distinct term hashes of each item."""
    schema = T.StructType([items.schema[key], T.StructField("terms", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for _, _, data, offsets in text_pieces(b.column(1)):
                h, n = _terms(data, offsets)
                edge = np.concatenate(([0], np.cumsum(n)))
                lists += [np.unique(h[x:y]).view(np.int64).tolist() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=[key, "terms"])

    return items.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def search(index: DataFrame, items: DataFrame, item_key: str, text: str, *, key: str, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_key, rank, key, score): the ``k`` highest-scoring documents of each item, scores above 0 only.

    Items are searched in blocks of a bounded number of terms; each block is one pass over the index, whose results are
    settled before the next one, and its broadcasts are given up.
    """
    spark = index.sparkSession
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), int(totals[1])
    asked = settle(_item_terms(items, item_key, text).where(F.size("terms") > 0).withColumn("place", F.monotonically_increasing_id()))
    blocks = -(-int(asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_terms)
    kind = index.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField(key, kind), T.StructField("score", T.LongType())])
    result = T.StructType([T.StructField(item_key, items.schema[item_key].dataType), T.StructField("rank", T.IntegerType()), *schema.fields[1:]])
    done = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block).collect()  # about block_terms terms
        if not rows:
            continue
        keys = [r[0] for r in rows]
        lists = [np.array(r["terms"], np.int64).view(_U) for r in rows]
        vocabulary = np.unique(np.concatenate(lists))
        sent = spark.sparkContext.broadcast(vocabulary)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value), np.int64)
            for b in batches:
                for names, starts in zip(b.column(0), b.column(1), strict=True):
                    names, size = np.frombuffer(names.as_buffer(), _U), np.diff(np.frombuffer(starts.as_buffer(), np.int32))
                    at = np.minimum(np.searchsorted(names, sent.value), len(names) - 1)
                    total += np.where(names[at] == sent.value, size[at], 0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "df": pa.array(total[at], pa.int64())})

        df = np.zeros(len(vocabulary), np.int64)
        for r in index.select("names", "starts").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():
            df[r[0]] = r[1]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
        used = weights > 0
        place = np.cumsum(used) - 1
        numbered = [np.searchsorted(vocabulary, t) for t in lists]
        query = spark.sparkContext.broadcast((vocabulary[used], weights[used], [place[t[used[t]]] for t in numbered]))

        def find(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            vocabulary, weights, asked = query.value
            best: list[list] = [[] for _ in asked]
            order = lambda x: (-x[0], x[1] is not None, x[1])
            for b in batches:
                for i in range(b.num_rows):
                    row = {c: b.column(c)[i].as_buffer() for c in ("sizes", "names", "starts", "rows", "times")}
                    shard, keys = Shard(row, vocabulary, weights, n_docs, n_terms), b.column("keys")[i].values
                    rank = np.empty(len(keys), np.int64)
                    rank[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
                    for item, terms in enumerate(asked):
                        had = best[item]
                        docs, scores = shard.search(terms, k, had[-1][0] if len(had) == k else 1)
                        if len(docs):
                            first = np.lexsort((rank[docs], -scores))[:k]
                            new = zip(scores[first].tolist(), keys.take(pa.array(docs[first])).to_pylist(), strict=True)
                            best[item] = sorted([*had, *new], key=order)[:k]
            flat = [(item, doc, score) for item, found in enumerate(best) for score, doc in found]
            if flat:
                columns = [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], b.schema.field("keys").type.value_type), pa.array([f[2] for f in flat], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", key, "score"])

        found = index.select("keys", "sizes", "names", "starts", "rows", "times").mapInArrow(find, schema)
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first(key))
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(keys)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", result[0].dataType)]))
        done.append(settle(ranked.join(named, "item").select(F.col("name").alias(item_key), "rank", key, "score")))
        sent.destroy()
        query.destroy()
    unsettle(asked)
    if not done:
        return spark.createDataFrame([], result)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
