"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is a run of whole documents inside a task. Its suffix array sorts the word suffixes of these documents; every
test suffix is placed in it by binary search, which yields its longest verbatim match and all places that share at
least one window with it. Two facts keep the arrays small without losing a match: a window cannot cross a word that no
test item has, and only the first L words of a suffix matter when the longest test item has L.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrain.llm.common import LOWER, byte_class, free_name, small_batches, spans_hash, text_pieces, words_of

#: Every byte that is not in \x00-\x2F, \x3A-\x60 (after lower-casing) or \x7B-\x7F.
WORD_BYTES = byte_class((48, 57), (97, 122), (128, 255))
WINDOW = 10
#: Test text sent to the executors at once; a larger test set passes in several such blocks.
BLOCK_BYTES = 8 << 20

MATCHES = "array<struct<item_id:string,item_start:int,start:int,words:int>>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, first = words_of(low, offsets, WORD_BYTES)
    return low, starts, ends, first, spans_hash(low, starts, ends)


@dataclass
class TestBlock:
    """Some test items as words: numbered vocabulary, flat word numbers and each word's distance to its item's end."""

    ids: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    spelled: list[bytes]  # the word of each number
    flat: np.ndarray  # word numbers of all items
    first: np.ndarray  # item boundaries in flat
    window: int

    def __post_init__(self) -> None:
        n = len(self.flat)
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        at = np.arange(n) - self.first[item] if n else np.zeros(0, np.int64)
        left = self.first[item + 1] - np.arange(n) if n else np.zeros(0, np.int64)
        whole = np.diff(self.first)[item] if n else np.zeros(0, np.int64)
        self.item, self.at, self.left = item, at, left
        #: suffixes that begin a window, and the words that window takes
        self.needed = np.minimum(self.window, whole)
        self.queries = np.flatnonzero(left >= self.needed)
        self.longest = int(whole.max()) if n else 0
        self.shortest = int(self.needed.min()) if n else 0
        # numbers of neighbouring test words, to tell which training positions can start a match of two words
        pairs = self.flat[:-1].astype(np.int64) * (len(self.vocabulary) + 1) + self.flat[1:] if n else np.zeros(0, np.int64)
        self.pairs = np.unique(pairs[item[:-1] == item[1:]]) if n else pairs

    @staticmethod
    def of(items: list[tuple[str, str]], window: int) -> TestBlock:
        column = pa.array([t or "" for _, t in items], pa.string())
        hashes, spelled, counts = [], {}, []
        for _, _, data, offsets in text_pieces(column):
            low, starts, ends, first, h = _words(data, offsets)
            hashes.append(h)
            counts.append(np.diff(first))
            raw = low.tobytes()
            spelled |= {int(x): raw[a:b] for x, a, b in zip(h, starts, ends, strict=True)}
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        vocabulary = np.unique(h)
        first = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
        return TestBlock([i for i, _ in items], vocabulary, [spelled[int(x)] for x in vocabulary], np.searchsorted(vocabulary, h), first, window)


def suffix_array(numbers: np.ndarray, left: np.ndarray, kept: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``kept`` sorted by their first ``depth`` words, by prefix doubling; and their ranks (equal: equal rank).

    ``left`` is the number of words from each position to the end of its run; a run's end sorts first.
    """
    rank = np.zeros(len(numbers) + 1, np.int64)
    rank[:-1] = np.where(left > 0, numbers.astype(np.int64) + 1, 0)
    step, order = 1, kept
    while step < depth:
        nearby = np.minimum(np.arange(len(numbers)) + step, len(numbers))
        nearby[left <= step] = len(numbers)
        live = np.flatnonzero(left > 0)
        key = rank[live] * (int(rank.max()) + 1) + rank[nearby[live]]
        _, back = np.unique(key, return_inverse=True)
        rank[live] = back + 1
        step *= 2
    order = kept[np.argsort(rank[kept], kind="stable")]
    return order, rank[order]


def _place(order: np.ndarray, numbers: np.ndarray, left: np.ndarray, block: TestBlock, upper: bool) -> np.ndarray:
    """Binary search of every query suffix, cut to its window, in the suffix array: first slot not below (above) it."""
    q, need = block.queries, block.needed[block.queries]
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        at = order[mid]
        state = np.zeros(len(open_), np.int8)  # -1: the training suffix is smaller
        for k in range(int(need[open_].max())):
            live = np.flatnonzero((state == 0) & (k < need[open_]))
            if not len(live):
                break
            p = at[live]
            have = left[p] > k
            mine = np.where(have, numbers[np.minimum(p + k, len(numbers) - 1)], -1)
            test = block.flat[q[open_[live]] + k]
            state[live] = np.sign(mine - test)
        down = (state < 0) | (upper & (state == 0))
        low[open_[down]] = mid[down] + 1
        high[open_[~down]] = mid[~down]


def shard_matches(block: TestBlock, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each document, and left-maximal matches: rows of (document, item, item start, start, words)."""
    low, starts, ends, first, h = _words(data, offsets)
    none = np.zeros((0, 5), np.int64)
    n = len(h)
    if not n or not len(block.vocabulary):
        return np.diff(first), none
    slot = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    known = block.vocabulary[slot] == h
    # a hash only proposes a word: the bytes decide
    raw, size = low, ends - starts
    lengths = np.array([len(w) for w in block.spelled])
    known &= lengths[slot] == size
    if known.any():
        at = np.flatnonzero(known)
        flat = np.frombuffer(b"".join(block.spelled), np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        for k in range(int(size[at].max())):
            at = at[size[at] > k]
            wrong = raw[starts[at] + k] != flat[begin[slot[at]] + k]
            known[at[wrong]] = False
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # runs: known words of one document whose neighbours are also neighbours in a test item
    joined = np.zeros(n, bool)
    if n > 1:
        pair = slot[:-1].astype(np.int64) * (len(block.vocabulary) + 1) + slot[1:]
        both = known[:-1] & known[1:] & (doc[:-1] == doc[1:])
        spot = np.minimum(np.searchsorted(block.pairs, pair), max(len(block.pairs) - 1, 0))
        joined[:-1] = both & (block.pairs[spot] == pair) if len(block.pairs) else False
    stops = np.flatnonzero(~joined)
    left = np.where(known, stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1, 0)
    kept = np.flatnonzero(left >= block.shortest)
    if not len(kept):
        return np.diff(first), none
    # only runs that can hold a window go into the array
    run = np.concatenate(([True], ~joined[:-1]))
    head = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    inside = known & (left[head] >= block.shortest)
    at = np.flatnonzero(inside)
    numbers, left = slot[at], left[at]
    kept = np.flatnonzero(left >= block.shortest)
    order, _ = suffix_array(numbers, left, kept, block.longest)
    begin, end = _place(order, numbers, left, block, False), _place(order, numbers, left, block, True)
    found = end - begin
    q = np.repeat(block.queries, found)
    slots = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(begin, found)
    p = order[slots]
    # left-maximal only: the words before differ, or one side has none
    before_q = block.at[q] > 0
    before_p = (p > 0) & (left[np.maximum(p - 1, 0)] == left[p] + 1) & (at[np.maximum(p - 1, 0)] == at[p] - 1)
    same = before_q & before_p & (numbers[np.maximum(p - 1, 0)] == block.flat[np.maximum(q - 1, 0)])
    q, p = q[~same], p[~same]
    words = np.minimum(block.needed[q], left[p])
    reach = np.minimum(block.left[q], left[p])
    live = np.flatnonzero(words < reach)
    while len(live):
        live = live[block.flat[q[live] + words[live]] == numbers[p[live] + words[live]]]
        words[live] += 1
        live = live[words[live] < reach[live]]
    rows = np.column_stack([doc[at[p]], block.item[q], block.at[q], at[p] - first[doc[at[p]]], words])
    return np.diff(first), rows


def longest_matches(df: DataFrame, tests: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, words: str = "n_words", matches: str = "matches", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with the number of words of each text and its longest verbatim matches with the test items.

    A match has the item's id as text, the word it starts at in the item and in the text, and its length; it can be
    extended on neither side, and has at least ``window`` words, or all words of a shorter item. Null texts have no
    words; items without words match nothing. ``words`` and ``matches`` must be free names. The test set goes through
    in blocks of ``block_bytes`` of text, each broadcast and then dropped, so no side's size is assumed; a single item
    larger than that is a block of its own. Neither side is shuffled, so skew and repeated rows do not matter.
    """
    spark = df.sparkSession
    small_batches(spark)
    types = [*df.schema.fields, T.StructField(words, T.LongType()), T.StructField(matches, T.StructType.fromDDL(f"m {MATCHES}")["m"].dataType)]
    schema = T.StructType(types)
    spec = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("words", pa.int32())]))

    def searcher(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TestBlock.of(sent.value, window)
            ids = pa.array(block.ids, pa.string())
            for b in batches:
                names = list(b.schema.names)
                counts, rows, base = [], [np.zeros((0, 5), np.int64)], 0
                for at, _, data, offsets in text_pieces(b.column(names.index(text))):
                    n, found = shard_matches(block, data, offsets)
                    counts.append(n)
                    found[:, 0] += at
                    rows.append(found)
                rows = np.concatenate(rows)
                rows = rows[np.lexsort(rows.T[::-1])]
                lists = np.searchsorted(rows[:, 0], np.arange(b.num_rows + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([ids.take(pa.array(rows[:, 1])), *(pa.array(rows[:, k].astype(np.int32)) for k in (2, 3, 4))], names=["item_id", "item_start", "start", "words"])
                column = pa.ListArray.from_arrays(pa.array(lists), values).cast(spec)
                if matches in names:  # a later block of test items adds its matches
                    old = b.column(names.index(matches))
                    merged = [x + y for x, y in zip(old.to_pylist(), column.to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(merged, spec)], names=names)
                else:
                    total = pa.array(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([*b.columns, total, column], names=[*names, words, matches])

        return run

    items = tests.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    out = df
    for block in _blocks(items, block_bytes):
        out = out.mapInArrow(searcher(spark.sparkContext.broadcast(block)), schema)
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, streamed through the driver one block at a time; at least one block."""
    block, size, sent = [], 0, False
    for r in items.toLocalIterator():
        if block and size + len(r["t"]) > block_bytes:
            yield block
            block, size, sent = [], 0, True
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block or not sent:
        yield block


def hit_words(matches: str) -> F.Column:
    """How many word positions of a text its matches cover together."""
    spans = F.array_sort(F.transform(F.col(matches), lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["words"]).alias("e"))))
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))

    def add(state, m):
        new = F.greatest(F.lit(0), m["e"] - F.greatest(state["reach"], m["s"]))
        return F.struct(F.greatest(state["reach"], m["e"]).alias("reach"), (state["n"] + new).alias("n"))

    return F.aggregate(spans, start, add)["n"]


def decontaminate(df: DataFrame, tests: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` in which no window of a test item occurs, columns unchanged."""
    words, matches = free_name(df, "n_words"), free_name(df, "matches")
    found = longest_matches(df, tests, text, words=words, matches=matches, **options)
    return found.where(F.size(matches) == 0).select(*df.columns)
