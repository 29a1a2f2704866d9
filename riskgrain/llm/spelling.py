"""Spelling variants: near words of a vocabulary through a bit-sliced position index.

A run is a maximal row of letters A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. Two words are near if one
inserted, deleted or replaced code point turns one into the other. Of two near words the shorter one's first or last half
is whole in both, so the vocabulary is dealt by such halves; inside a task an index holds, for each position and letter,
the words with that letter there as bits, and one pass over a word's letters tracks all words that equal it so far and
all that differ by one replaced, missing or extra letter, 64 at a time.

Null texts have no runs. A null key counts as empty in the rule that deletes letters. Repeated rows count again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrain.llm.common import LOWER, byte_class, settle, small_batches, spans_hash, text_pieces, unsettle, words_of

#: Words a task remembers or counts before it starts afresh or hands them on.
REMEMBERED = 1 << 18
#: Words of a bucket that one task compares at once; larger buckets are cut into pairs of blocks of about this size.
BLOCK_WORDS = 4096
#: Rows gathered before they are compared, if a bucket ends there.
GATHERED = 1 << 15
#: Pairs of a word and 64 indexed ones that are worked on at once.
PAIRS = 1 << 17

LETTERS = byte_class((65, 90), (97, 122))
_U = np.uint64


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of each row, and each row's first run (n + 1)."""
    flat = data.copy()
    lead = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF are this byte and one more
    flat[lead] = flat[lead + 1] = 97
    return words_of(flat, offsets, LETTERS)


class ShiftedCrc:
    """CRC-32 of a prefix and a word from the CRCs of both: the prefix's moves past the word's bytes by table."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def __call__(self, prefix: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = word.copy()
        for n in np.unique(length).tolist():
            if n not in self.tables:
                if len(self.tables) > 500:
                    self.tables = {}
                zeros = bytes(n)
                moved = [zlib.crc32(zeros, 1 << b) ^ zlib.crc32(zeros) for b in range(32)]
                table = np.zeros((4, 256), np.uint32)
                for v in range(32):
                    byte, bit = divmod(v, 8)
                    table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ np.uint32(moved[v])
                self.tables[n] = table
            at = np.flatnonzero(length == n)
            for byte in range(4):
                out[at] ^= self.tables[n][byte, (prefix[at] >> np.uint32(8 * byte)) & np.uint32(255)]
        return out


def word_counts(df: DataFrame, key: str, text: str, *, letters: int = 1, least: int = 1, every: int | None = None) -> DataFrame:
    """(word, n): the lower-cased runs of all texts with at least that many letters and occurrences.

    ``every``: a run loses a letter where that number divides the CRC-32 of ``<key>:<run>``; the letter's place is the
    CRC modulo the run's length. Runs are counted in tasks before the shuffle, so a very common one costs no more.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, crcs, combined = {}, {}, ShiftedCrc()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counted], pa.string()), "n": pa.array(list(counted.values()), pa.int64())})

        for b in batches:
            names = b.column(0).to_pylist()
            for base, _, data, offsets in text_pieces(b.column(1)):
                low = LOWER[data]
                starts, ends, first = letter_runs(low, offsets)
                extra = np.concatenate(([0], np.cumsum(low == 0xC3)))
                size = ends - starts - (extra[ends] - extra[starts])
                long_enough = size >= letters
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[long_enough]
                starts, ends, size = starts[long_enough], ends[long_enough], size[long_enough]
                h, at, back = np.unique(spans_hash(low, starts, ends), return_index=True, return_inverse=True)
                raw = low.tobytes()
                words = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                pair, times = np.unique(row * len(h) + back, return_counts=True)
                row, back = pair // max(len(h), 1), pair % max(len(h), 1)
                if every:
                    if len(crcs) > REMEMBERED:
                        crcs = {}
                    own = np.empty(len(h), np.uint32)
                    for k, name in enumerate(h.tolist()):
                        c = crcs.get(name)
                        if c is None:
                            c = crcs[name] = zlib.crc32(words[k])
                        own[k] = c
                    before = np.array([zlib.crc32(f"{'' if names[base + r] is None else names[base + r]}:".encode()) for r in range(len(offsets) - 1)], np.uint32)
                    crc = combined(before[row], own[back], (ends - starts)[at][back])
                    hit = crc % np.uint32(every) == 0
                    for c, k, n in zip(crc[hit].tolist(), back[hit].tolist(), times[hit].tolist(), strict=True):
                        w = words[k].decode()
                        p = c % len(w)
                        if len(w) > letters:
                            w = (w[:p] + w[p + 1 :]).encode()
                            counted[w] = counted.get(w, 0) + n
                    back, times = back[~hit], times[~hit]
                for w, n in zip(words, np.bincount(back, times, len(h)).astype(np.int64).tolist(), strict=True):
                    if n:
                        counted[w] = counted.get(w, 0) + n
                if len(counted) > REMEMBERED:
                    yield handed()
                    counted = {}
        yield handed()

    counts = df.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """For each position and letter the indexed words with that letter there, one bit a word."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, short: int):
        n, width = codes.shape
        self.blocks, self.short = -(-n // 64), short
        word, bit = np.arange(n) >> 6, _U(1) << (np.arange(n).astype(np.uint64) & _U(63))
        # one position more than any word has, for steps past a word's end
        self.at = np.zeros((width + 1, int(codes.max(initial=0)) + 1, self.blocks), np.uint64)
        for p in range(width):
            np.bitwise_or.at(self.at[p], (codes[:, p], word), bit)
        self.of_length = {}
        for m in (short, short + 1):
            self.of_length[m] = np.zeros(self.blocks, np.uint64)
            np.bitwise_or.at(self.of_length[m], word[lengths == m], bit[lengths == m])

    def near(self, codes: np.ndarray, length: int, block: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Bits of the indexed words of ``block`` near each row of ``codes`` (words of ``length``), among those given.

        Words of the short length meet words as long or one longer; longer ones meet short ones only.
        """
        at = self.at
        same = among
        replaced = extra = missing = np.zeros(len(codes), np.uint64)
        for i in range(length):
            c = codes[:, i]
            here = at[i, c, block]
            if length == self.short:
                extra = (extra | same) & at[i + 1, c, block]  # the indexed word had one letter more before this one
                replaced = (replaced & here) | (same & ~here)
            else:
                missing = (missing & at[i - 1, c, block] if i else missing) | same  # or lacks this one or an earlier one
            same = same & here
        if length == self.short:
            return (replaced & self.of_length[length][block]) | ((extra | same) & self.of_length[length + 1][block])
        return missing & self.of_length[self.short][block]


def bucket_pairs(codes: np.ndarray, lengths: np.ndarray, short: int, group: np.ndarray, asks: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking row, held row) of all near words of a bucket; rows of a bucket follow each other, ``group`` numbers them."""
    rows = np.flatnonzero(held)
    index = PositionIndex(codes[rows], lengths[rows], short)
    low, high = np.searchsorted(group[rows], group, "left"), np.searchsorted(group[rows], group, "right")
    found_a, found_b = [], []
    for length in (short, short + 1):
        ask = np.flatnonzero(asks & (lengths == length) & (high > low))
        n = (high[ask] - 1 >> 6) - (low[ask] >> 6) + 1
        edge = np.cumsum(n)
        at = 0
        while at < len(ask):
            end = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + PAIRS, "right")))
            who = np.repeat(ask[at:end], n[at:end])
            step = np.arange(len(who)) - np.repeat(edge[at:end] - n[at:end] - (edge[at - 1] if at else 0), n[at:end])
            block = (low[who] >> 6) + step
            # the bits of the word's own bucket
            a, z = np.maximum(low[who] - 64 * block, 0), np.minimum(high[who] - 64 * block, 64)
            full = _U(0xFFFFFFFFFFFFFFFF)
            among = (full >> (64 - (z - a)).astype(np.uint64)) << a.astype(np.uint64)
            bits = index.near(codes[who], length, block, among)
            some = np.flatnonzero(bits)
            if len(some):
                k, bit = np.nonzero(np.unpackbits(bits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                found_a.append(who[some[k]])
                found_b.append(rows[64 * block[some[k]] + bit])
            at = end
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _best(words: list[str], n: np.ndarray, group: np.ndarray, asks: np.ndarray, held: np.ndarray, short: int, tail: np.ndarray) -> pa.RecordBatch:
    """Per asking word its number of near words here and the most frequent of them (ties: first in order)."""
    points = np.frombuffer("".join(w.ljust(short + 1, "\0") for w in words).encode("utf-32-le"), np.uint32)
    _, codes = np.unique(np.concatenate((np.zeros(1, np.uint32), points)), return_inverse=True)
    codes = codes[1:].reshape(len(words), short + 1)  # 0: past the end
    lengths = np.array([len(w) for w in words])
    a, b = bucket_pairs(codes, lengths, short, group, asks, held)
    # words alike at both ends meet twice; they count where their first halves meet
    again = tail[a] & (codes[a, : short // 2] == codes[b, : short // 2]).all(axis=1)
    a, b = a[~again], b[~again]
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort(codes.T[::-1])] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))[: len(a)])
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[k] for k in a[start]], pa.string()), "near": pa.array(np.diff(np.append(start, len(a))), pa.int64()),
        "best": pa.array([words[k] for k in b[start]], pa.string()), "best_n": pa.array(n[b[start]], pa.int64()),
    })


def near_words(vocabulary: DataFrame, *, least: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of every word of ``vocabulary`` (word, n; words distinct) that has a near one.

    ``least``: code points of the shortest word. A half that many words share makes a large bucket, which is cut into
    pairs of blocks, so that no task holds it whole.
    """
    size = F.length("word")
    kinds = [F.struct(m.alias("short"), F.lit(tail).alias("tail"), half.alias("half")) for m in (size, size - 1) for tail, half in (
        (False, F.substring("word", F.lit(1), F.floor(m / 2).cast("int"))), (True, F.right(F.col("word"), F.floor(m / 2).cast("int"))))]
    bucket = ["short", "tail", "half"]
    keyed = vocabulary.select("word", "n", F.explode(F.array(*kinds)).alias("at")).select("word", "n", "at.*").where(F.col("short") >= least)
    sizes = keyed.groupBy(*bucket).count().where(F.col("count") > block_words)
    keyed = keyed.join(sizes, bucket, "left").withColumn("cuts", F.coalesce(F.ceil(F.col("count") / block_words), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")
    cells = F.expr("flatten(transform(sequence(0, cuts - 1), k -> if(k = own, array(struct(own AS i, own AS j)), array(struct(own AS i, k AS j), struct(k AS i, own AS j)))))")
    dealt = keyed.withColumn("own", own).withColumn("cell", F.explode(cells)).select(
        *bucket, F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "word", "n", (F.col("cell.i") == F.col("own")).alias("held"), (F.col("cell.j") == F.col("own")).alias("asks"))
    cell = [*bucket, "i", "j"]
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell)
    schema = "word string, near bigint, best string, best_n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, last, rows, group = None, None, ([], [], [], [], [], []), 0

        def compared() -> pa.RecordBatch:
            words, n, group, asks, held, tail = rows
            return _best(words, np.array(n), np.array(group), np.array(asks), np.array(held), short, np.array(tail))

        for b in batches:
            for m, tail, half, i, j, word, n, held, asks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = (m, tail, half, i, j)
                if name != last:
                    if rows[0] and (m != short or len(rows[0]) >= GATHERED):
                        yield compared()
                        rows = ([], [], [], [], [], [])
                    last, short, group = name, m, group + 1
                for kept, value in zip(rows, (word, n, group, asks, held, tail), strict=True):
                    kept.append(value)
        if rows[0]:
            yield compared()

    found = dealt.mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.least")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form; words distinct, without circles): where following forms ends.

    Each round doubles the steps taken; tables between rounds are settled and deleted.
    """
    reached = settle(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        unsettle(reached)
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(vocabulary: DataFrame, *, times: int = 5, least: int = 1) -> DataFrame:
    """``vocabulary`` (word, n) with the form of each word, the form's n, its root and its number of near words.

    The form is the most frequent near word (ties: first in code-point order) if it occurs at least ``times`` as often,
    else null; the root is the last of the forms that follow each other from the word, itself without a form.
    """
    vocabulary = settle(vocabulary.select("word", "n"))
    found = near_words(vocabulary, least=least)
    accepted = F.col("best_n") >= times * F.col("n")
    grouped = settle(vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(accepted, F.col("best")).alias("form"), F.when(accepted, F.col("best_n")).alias("form_n")))
    ends = roots(grouped.where(F.col("form").isNotNull()))
    return grouped.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
