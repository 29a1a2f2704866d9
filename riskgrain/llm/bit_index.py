"""Exact top-k inner products over a bit-sliced index.

Every component of a vector is an integer attribute. A block of vectors stores each attribute as bit slices: one bitmap
per binary digit, one bit per vector. A query adds up the slices of its weighted, coarsened attributes with bitmap
arithmetic, which gives the digits of a rough score of all vectors at once. Walking the digits of that sum from the most
significant slice downward keeps the vectors that can still be among the best; what remains at the boundary is scored
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrain.llm.common import settle

#: Vectors indexed together; queries sent to the executors at once; queries added up together inside a task.
BLOCK_ROWS = 1 << 14
QUERY_BLOCK = 1 << 14
_TOGETHER = 8
#: Binary digits kept of an attribute and of a query's weight in the rough score.
DIGITS, WEIGHT_DIGITS = 6, 5
#: Passes over the data whose partial results are kept apart before they are written.
_PASSES = 8


def quantised(vector: str, scale: int = 256) -> F.Column:
    """floor(scale * x) of each component x as a double; null if the vector is null or has a null or non-finite one."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _slices(x: np.ndarray, digits: int) -> np.ndarray:
    """rows x attributes of non-negative integers as attributes x digits x words of bits."""
    bits = (x.T[:, None, :] >> np.arange(digits)[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 0), (0, pad)))).view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two numbers given as ... x digits x words bit slices (least significant first), with one more digit."""
    digits = max(a.shape[-2], b.shape[-2])
    out = np.zeros((*np.broadcast_shapes(a.shape[:-2], b.shape[:-2]), digits + 1, a.shape[-1]), np.uint64)
    carry = np.zeros_like(out[..., 0, :])
    for k in range(digits):
        if k < a.shape[-2] and k < b.shape[-2]:
            x, y = a[..., k, :], b[..., k, :]
            half = x ^ y
            out[..., k, :] = half ^ carry
            carry = (x & y) | (half & carry)
        else:
            x = a[..., k, :] if k < a.shape[-2] else b[..., k, :]
            out[..., k, :] = x ^ carry
            carry = x & carry
    out[..., digits, :] = carry
    return out


def _times(slices: np.ndarray, most: int) -> list[np.ndarray]:
    """The slices multiplied by 0 .. most, by shifting and adding."""
    made = [np.zeros((slices.shape[0], 1, slices.shape[2]), np.uint64), slices]
    for m in range(2, most + 1):
        half = made[m // 2]
        twice = np.concatenate((np.zeros_like(half[:, :1]), half), axis=1)
        made.append(_add(twice, slices) if m % 2 else twice)
    return made


class SlicedBlock:
    """The bit-sliced index of one block of integer vectors."""

    def __init__(self, x: np.ndarray, digits: int = DIGITS, weight_digits: int = WEIGHT_DIGITS) -> None:
        self.x = x.astype(np.int64)
        low = x.min(axis=0)
        self.shift = max(0, int((x - low).max(initial=0)).bit_length() - digits)
        self.most, self.most_weight = (1 << digits) - 1, (1 << weight_digits) - 1
        coarse = (x - low) >> self.shift
        #: largest length of a vector, and of what coarsening takes from it
        self.reach = float(np.sqrt((self.x**2).sum(axis=1).max()))
        lost = self.x - (low + (coarse << self.shift)) - ((1 << self.shift) - 1) / 2
        self.lost = float(np.sqrt((lost**2).sum(axis=1).max()))
        # each attribute multiplied by every weight, ready to be added up
        self.width = digits + weight_digits
        made = _times(_slices(coarse, digits), self.most_weight)
        self.products = np.zeros((len(made), x.shape[1], self.width, made[1].shape[2]), np.uint64)
        for m, p in enumerate(made):
            k = min(self.width, p.shape[1])
            self.products[m, :, :k] = p[:, :k]
        self.valid = _slices(np.ones((len(x), 1), np.int64), 1)[0, 0]

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each query, the rows that can be among its k best, ties included; never too few."""
        size = np.abs(queries)
        bits = np.array([int(m).bit_length() for m in size.max(axis=1)])
        shift = np.maximum(0, bits - self.most_weight.bit_length())
        weights = np.minimum((size + ((1 << shift) >> 1)[:, None]) >> shift[:, None], self.most_weight)
        taken = np.sign(queries) * (weights << shift[:, None])
        # |q.x - rough| is at most |q - taken| |x| + |taken| |x - coarse x|, by the lengths of these vectors
        error = np.sqrt(((queries - taken) ** 2).sum(axis=1)) * self.reach + np.sqrt((taken**2).sum(axis=1)) * self.lost
        slack = np.ceil(2 * error * (1 + 1e-9) / (1 << (self.shift + shift))).astype(np.int64) + 1
        for j, sums in enumerate(self._sums(weights, queries < 0)):
            kept = self._top(sums, k, int(slack[j]))
            yield np.flatnonzero(np.unpackbits(kept.view(np.uint8), bitorder="little")[: len(self.x)])

    def _sums(self, weights: np.ndarray, negative: np.ndarray) -> np.ndarray:
        """queries x digits x words: slices of the sums of weight x coarse attribute, shifted to be non-negative.

        Under a negative weight w an attribute c counts as w * (most - c) = w * most - w * c, and - w * c is the
        complement of the product's digits plus one; the constants are added once at the end.
        """
        d = weights.shape[1]
        pad = int(d).bit_length() + 1
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        parts = self.products[weights, np.arange(d)[None, :]]
        flip = np.where(negative, ones, np.uint64(0))[:, :, None, None]
        total = np.concatenate((parts ^ flip, np.broadcast_to(flip, (*parts.shape[:2], pad, parts.shape[3]))), axis=2)
        while total.shape[1] > 1:
            if total.shape[1] % 2:
                total = np.concatenate((total, np.zeros_like(total[:, :1])), axis=1)
            total = _add(total[:, 0::2], total[:, 1::2])[:, :, : self.width + pad]
        constant = negative.sum(axis=1) + (np.where(negative, weights, 0) * self.most).sum(axis=1)
        digit = (constant[:, None] >> np.arange(self.width + pad)) & 1
        slices = np.where(digit == 1, ones, np.uint64(0))[:, :, None]
        return _add(total[:, 0], np.broadcast_to(slices, total[:, 0].shape))[:, : self.width + pad]

    def _top(self, sums: np.ndarray, k: int, slack: int) -> np.ndarray:
        """Bitmap of rows whose sum is at least the k-th largest minus ``slack``, from the top slice downward."""
        count = lambda m: int(np.bitwise_count(m).sum())
        have, open_, least = 0, self.valid, 0
        for digit in range(len(sums) - 1, -1, -1):
            ones = open_ & sums[digit]
            more = count(ones)
            if have + more >= k:
                open_, least = ones, least | (1 << digit)
            else:
                have, open_ = have + more, open_ & ~sums[digit]
        if least <= slack:
            return self.valid
        above, equal, least = np.zeros_like(self.valid), self.valid, least - slack
        for digit in range(len(sums) - 1, -1, -1):
            if least >> digit & 1:
                equal = equal & sums[digit]
            else:
                above, equal = above | (equal & sums[digit]), equal & ~sums[digit]
        return above | equal


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best of a block for each query, ties to smaller ids.

    ``own``: a query's own vector is left out.
    """
    index = SlicedBlock(x)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), _TOGETHER):
        some = queries[at : at + _TOGETHER]
        for j, rows in enumerate(index.candidates(some, k + own)):
            if own:
                rows = rows[ids[rows] != query_ids[at + j]]
            exact = index.x[rows] @ some[j]
            best = np.lexsort((ids[rows], -exact))[:k]
            out.append((np.full(len(best), at + j), rows[best], exact[best]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", own: bool = True, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, key, score): for each query the k vectors of largest integer inner product.

    ``vectors`` and ``queries`` have an integer key and an array of integers, all of one length; rows with a null
    key or array and arrays of another length than the first query's take no part. Repeated rows all count. Ties go to the smaller key; ``own`` leaves out rows with the
    query's key. Queries go through in blocks of ``query_block``, each broadcast, against all vectors; a task returns k
    rows for a query and block of vectors, and the k best of these are final.
    """
    spark = vectors.sparkSession
    named = F.col(vector).isNotNull() & F.col(key).isNotNull()
    rows = queries.where(named).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    usable = vectors.where(named).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    schema = "query_id bigint, vec_id bigint, score bigint"

    def searcher(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, wanted = sent.value
            d = wanted.shape[1]
            waiting, n = [], 0

            def search() -> pa.RecordBatch:
                ids, x = (np.concatenate(c) for c in zip(*waiting, strict=True))
                q, r, score = block_top(ids, x, query_ids, wanted, k, own)
                return pa.RecordBatch.from_pydict({"query_id": query_ids[q], "vec_id": ids[r], "score": score})

            for b in batches:
                ids, v = np.array(b.column(0)), b.column(1)
                fits = np.array(v.value_lengths()) == d
                x = np.array(v.filter(pa.array(fits)).flatten(), np.int64).reshape(-1, d)
                waiting.append((ids[fits], x))
                n += len(x)
                if n >= BLOCK_ROWS:
                    yield search()
                    waiting, n = [], 0
            if n:
                yield search()

        return run

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    parts = []
    for query_ids, wanted in _blocks(rows, query_block):
        sent = spark.sparkContext.broadcast((query_ids, wanted))
        parts.append(best(usable.mapInArrow(searcher(sent), schema)))
        if len(parts) == _PASSES:
            parts = [settle(_union(parts))]
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint").withColumnRenamed("vec_id", key)
    return _union(parts).select("query_id", F.col("rank").cast("int"), F.col("vec_id").alias(key), "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(rows: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries in blocks, streamed through the driver one block at a time."""
    ids, vectors = [], []
    length = None
    for r in rows.toLocalIterator():
        length = len(r["v"]) if length is None else length
        if len(r["v"]) != length:
            continue
        ids.append(r["q"])
        vectors.append(np.array(r["v"], np.int64))
        if len(ids) == size:
            yield np.array(ids), np.stack(vectors)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.stack(vectors)
