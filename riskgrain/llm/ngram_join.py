"""N-gram Jaccard join through prefix trees.

A text is the set of its word n-grams, kept as hashes in one global order: n-grams met in few texts first. Similar sets
must share one of their first few elements, and very similar ones a whole part when their elements are dealt into more
parts than the sets may differ in elements; these propose candidates. The join itself stores the ordered sets of a
probe's candidates in a trie and walks it once, sharing the overlap counted on a common path and leaving a branch as
soon as the elements that remain cannot reach the overlap the similarity asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrain.llm.common import LOWER, PIECE_BYTES, bucketed, byte_class, free_name, hash_filter, mix, settle, small_batches, spans_hash, text_pieces, unsettle, words_of
from riskgrain.llm.linking import connect, one_per_set, shared_members

#: Every byte but space and \x09-\x0D.
WORD_BYTES = ~byte_class((9, 13), (32, 32))
#: Counters of the sketch that orders n-grams by how common they are; its size is fixed, so it can be broadcast.
SKETCH_BITS = 22
#: Counters of the sketch in one row between tasks.
_SLICE = 1 << 14
#: From this similarity on, candidates share a part of the set, of some ten elements, instead of one element.
PARTS_FROM = 0.85
#: Sets of sizes up to this factor are dealt into the same number of parts.
_CLASS = 1.5
#: Sets a task remembers to have met.
_REMEMBERED = 100_000

_U = np.uint64


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row as one flat array, sorted within rows, and the row boundaries in it."""
    low = LOWER[data]
    starts, ends, first = words_of(low, offsets, WORD_BYTES)
    words = np.diff(first)
    h = spans_hash(low, starts, ends)
    # a text of fewer words has one gram: all its words
    grams = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + first[:-1][row]
    took = np.minimum(words, size)[row]
    g = took.astype(np.uint64)
    for k in range(size):
        have = k < took
        g[have] = mix(g[have] * _U(0xD6E8FEB86659FD93) + h[at[have] + k])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    if len(g) > 1:
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(words) + 1))


def common_sketch(df: DataFrame, text: str, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """In how many texts n-grams of each hash bucket occur, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for _, _, data, offsets in text_pieces(b.column(0)):
                g, _ = _sets(data, offsets, size)
                at, n = np.unique(g >> _U(64 - bits), return_counts=True)
                total[at] += n.astype(np.uint32)
        parts = total.reshape(-1, min(_SLICE, 1 << bits))
        yield pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(len(parts)), pa.int32()), "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})

    def add(rows):
        total = sum(np.frombuffer(zlib.decompress(v.as_buffer()), np.uint32).astype(np.int64) for v in rows.column("counts"))
        # what is met in so many texts comes last anyway
        return pa.table({"slice": rows.column("slice")[:1], "counts": pa.array([np.minimum(total, 65_535).astype(np.uint16).tobytes()], pa.binary())})

    schema = "slice int, counts binary"
    partial = df.select(text).mapInArrow(count, schema)
    rows = partial.groupBy("slice").applyInArrow(add, schema).collect()  # 2**bits small numbers, whatever the input
    total = np.zeros((-(-(1 << bits) // _SLICE), min(_SLICE, 1 << bits)), np.uint16)
    for r in rows:
        total[r["slice"]] = np.frombuffer(r["counts"], np.uint16)
    return total.ravel()


def _ordered(g: np.ndarray, bounds: np.ndarray, common: np.ndarray, bits: int) -> np.ndarray:
    """The elements of each row by (commonness, hash)."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return g[np.lexsort((g, common[g >> _U(64 - bits)], row))]


def needed_overlap(a, b, share: float):
    """Least overlap of sets of ``a`` and ``b`` elements whose Jaccard similarity is at least ``share``."""
    return np.ceil(share / (1 + share) * (a + b) - 1e-9).astype(np.int64)


def _digests(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each row's set."""
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g))))
    return mix((running[bounds[1:]] - running[bounds[:-1]]) ^ mix(np.diff(bounds).astype(np.uint64)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def part_classes(share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of set sizes: the largest size, in how many elements two similar sets up to it may differ, the number of parts.

    Similar sets lie in one class or in two neighbouring ones. There are more parts than elements may differ in, so similar
    sets agree in some; the few further ones make it rare that those could be empty. Where nothing may differ, only equal
    sets are similar, and there are no parts.
    """
    rate = 2 * (1 - share) / (1 + share)
    upper = [max(1, int(0.999_999 / rate))]
    while upper[-1] < 1 << 40:
        upper.append(max(int(upper[-1] * _CLASS), int(upper[-1] / share) + 1))
    top = np.array(upper, np.int64)
    differ = np.floor(rate * top + 1e-6).astype(np.int64)
    return top, differ, np.where(differ > 0, differ + 2 + differ // 16, 0)


def part_keys(g: np.ndarray, bounds: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, the row of each, rows of too few parts) of sets of sorted hashes.

    A key stands for one part with all its elements. Sets that reach the similarity have a key in common, unless both are
    rows of too few parts: the parts in which they agree may then all be empty.
    """
    top, differ, parts = part_classes(share)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g ^ _U(0xA0761D6478BD642F)))))
    own = np.searchsorted(top, sizes)
    few, keys, rows = np.zeros(len(sizes), bool), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    # the own class, and the next one for sets that sets of it may be similar to
    for c, takes in ((own, sizes > 0), (own + 1, sizes >= share * (top[own] + 1) - 1e-9)):
        count = np.where(takes, parts[c], 0)
        part = ((g >> _U(32)) * count.astype(np.uint64)[row]) >> _U(32)
        new = np.ones(len(g), bool)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(g))
        at = row[start]
        few |= (np.bincount(at, minlength=len(sizes)) <= differ[c]) & (count > 0)
        key = mix((running[end] - running[start]) ^ mix(part[start] * _U(0xD6E8FEB86659FD93) + c[at].astype(np.uint64)))
        held = count[at] > 0
        keys.append(key[held])
        rows.append(at[held])
    return np.concatenate(keys), np.concatenate(rows), np.flatnonzero(few)


def _first_elements(g: np.ndarray, bounds: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(elements, the row of each) of which ordered sets that reach the similarity share one."""
    sizes = np.diff(bounds)
    keep = np.where(sizes > 0, sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + 1, 0)
    row = np.repeat(np.arange(len(sizes)), keep)
    return g[np.arange(len(row)) - np.repeat(np.cumsum(keep) - keep, keep) + bounds[:-1][row]], row


def prefixes(df: DataFrame, key: str, text: str, size: int, share: float, sent, bits: int) -> DataFrame:
    """(key, n, node, prefix): per row its set size, the digest of its set and the buckets a similar set must share one of.

    Buckets are first elements of the ordered set or, for high similarities, parts of the set. Equal sets have equal
    digests; of those a task meets, the first has buckets. The empty set has a null digest and no buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = sent.value, set()
        for b in batches:
            keys, n, node, empty, lists, flat = b.column(0), [], [], [], [np.zeros(1, np.int64)], []
            base = 0
            for _, _, data, offsets in text_pieces(b.column(1)):
                g, bounds = _sets(data, offsets, size)
                sizes = np.diff(bounds)
                digest = _digests(g, bounds)
                if len(seen) > _REMEMBERED:
                    seen.clear()
                first = np.array([not (x in seen or seen.add(x)) for x in digest.tolist()], bool)
                if share >= PARTS_FROM:
                    made, row, few = part_keys(g, bounds, share)
                    again = np.isin(np.repeat(np.arange(len(sizes)), sizes), few)
                    g, bounds = g[again], np.concatenate(([0], np.cumsum(np.where(np.isin(np.arange(len(sizes)), few), sizes, 0))))
                else:
                    made, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                more, more_row = _first_elements(_ordered(g, bounds, common, bits), bounds, share)
                made, row = np.concatenate((made, more)), np.concatenate((row, more_row))
                made, row = made[first[row]], row[first[row]]
                n.append(sizes)
                node.append(digest)
                empty.append(sizes == 0)
                flat.append(made[np.argsort(row, kind="stable")])
                lists.append(base + np.cumsum(np.bincount(row, minlength=len(sizes))))
                base += len(made)
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            nodes = pa.array(cat(node, np.uint64).view(np.int64), mask=cat(empty, bool))
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(lists).astype(np.int32)), _signed(cat(flat, np.uint64)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(cat(n, np.int64).astype(np.int64)), nodes, prefix], names=["key", "n", "node", "prefix"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n bigint, node bigint, prefix array<bigint>")


def texts_by_set(df: DataFrame, text: str, size: int) -> DataFrame:
    """(node, text): the texts under the digests of their sets. Of equal sets a task brings the first only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            node = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in text_pieces(b.column(0)):
                node.append(_digests(*_sets(data, offsets, size)))
            nodes = _signed(np.concatenate(node))
            new = pa.array([not (x in seen or seen.add(x)) for x in nodes.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([nodes.filter(new), b.column(0).filter(new)], names=["node", "text"])

    return df.select(text).mapInArrow(run, "node bigint, text string")


def ordered_sets(texts: pa.Array, size: int, common: np.ndarray, bits: int) -> list[np.ndarray]:
    """The whole ordered set of each text."""
    out = []
    for _, _, data, offsets in text_pieces(texts):
        g, bounds = _sets(data, offsets, size)
        g = _ordered(g, bounds, common, bits)
        out += [g[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def trie_matches(probe: np.ndarray, sets: list[np.ndarray], share: float) -> np.ndarray:
    """Which of the ordered sets have at least the similarity with the probe.

    The sets are walked in lexicographic order, which is the depth-first order of their trie: what a set has in common
    with its predecessor is a shared path, whose overlap counts are taken over instead of counted again. A walk stops
    where the elements left on either side are too few; the depth it stopped at prunes the successors that share it.
    """
    out = np.zeros(len(sets), bool)
    order = sorted(range(len(sets)), key=lambda k: sets[k].tobytes())
    member = np.sort(probe)
    path, overlap = np.zeros(0, np.uint64), np.zeros(1, np.int64)
    for k in order:
        s = sets[k]
        m = min(len(path), len(s))
        differ = np.flatnonzero(path[:m] != s[:m])
        shared = int(differ[0]) if len(differ) else m
        need = int(needed_overlap(len(probe), len(s), share))
        counted = overlap[: shared + 1]
        at, reach = shared, counted[-1] + min(len(s) - shared, len(probe) - int(counted[-1]))
        while reach >= need and at < len(s):
            step = s[at : at + 64]
            spot = np.minimum(np.searchsorted(member, step), len(member) - 1)
            counted = np.concatenate((counted, counted[-1] + np.cumsum(member[spot] == step)))
            at += len(step)
            reach = counted[-1] + min(len(s) - at, len(probe) - int(counted[-1]))
        path, overlap = s[:at], counted
        out[k] = reach >= need and at == len(s) and counted[-1] >= need
    return out


def verify_pairs(pairs: DataFrame, texts: DataFrame, size: int, share: float, sent, bits: int) -> DataFrame:
    """The pairs (a, b) whose texts in (node, text) have sets that reach the similarity. Neighbouring rows with one a share a trie.

    Sets travel as text, which is a fraction of their size; each task makes the sets of its texts, so many at a time
    that they stay small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, hubs, others = np.array(b.column(0)), b.column(2), b.column(3)
            length = np.cumsum(np.array(pc.binary_length(others), np.int64))
            keep, start = np.zeros(len(a), bool), 0
            while start < len(a):
                end = start + int(np.argmax(np.append(a[start:] != a[start], True)))
                probe = ordered_sets(hubs.slice(start, 1), size, sent.value, bits)[0]
                while start < end:
                    stop = int(np.searchsorted(length, (length[start - 1] if start else 0) + PIECE_BYTES, "right"))
                    stop = min(end, max(start + 1, stop))
                    keep[start:stop] = trie_matches(probe, ordered_sets(others.slice(start, stop - start), size, sent.value, bits), share)
                    start = stop
            flags = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(flags), b.column(1).filter(flags)], names=["a", "b"])

    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a bigint, b bigint")


def jaccard_components(df: DataFrame, key: str, text: str = "text", size: int = 3, share: float = 0.9, bits: int = SKETCH_BITS) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``df``: rows linked, directly or through others, share a component.

    Two texts link when the Jaccard similarity of their sets of ``size``-word n-grams is at least ``share`` (compared
    as integers of hundredths). Words are the runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased. A text of
    fewer words has all of them as its one n-gram; null texts and texts without words have the empty set and link with
    nothing. Equal sets are one node throughout. A component's id is its smallest key. Keys should be unique: rows with
    the same key stay apart but cannot be told from each other in the result; a null key is its own component's
    smallest only if all keys there are null.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(common_sketch(docs, "text", size, bits))
    made = settle(prefixes(docs, "key", "text", size, share, sent, bits))
    # rows of equal sets bring the same members, which count once
    found = settle(shared_members(made.where("node is not null").select(F.explode("prefix").alias("bucket"), "node")))
    base = settle(made.select("key", "n", "node"))
    unsettle(made)
    first = base.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"))
    members = settle(one_per_set(found).join(first.select("node", "n"), "node"))
    unsettle(found)
    needed = members.select("node").distinct()
    chosen = first.join(needed, "node", "left_semi")
    # rows of one key may differ in text: each brings its own set, and sets that nobody asks for do no harm. So texts need
    # no exchange by key: a filter lets pass all rows with a chosen key or none, and few others
    tag = F.when(F.col("key").isNotNull(), F.xxhash64("key"))
    asked = docs.where(hash_filter(chosen.select(tag.alias("tag")), "tag")(tag))
    texts, drop = bucketed(texts_by_set(asked, "text", size), "node")
    sets_of = lambda column: ordered_sets(column, size, sent.value, bits)
    labels = connect(members, texts, share, share, lambda pairs: verify_pairs(pairs, texts, size, share, sent, bits), sets_of)
    drop()
    unsettle(members)
    roots = first.select("node", "key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = roots.groupBy("component").agg(F.min("key").alias("component_id"))
    named = roots.select("node", "component").join(least, "component").select("node", "component_id")
    out = base.select("key", "n", "node").join(named, "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that carry the smallest key of their component, columns unchanged; others are copies.

    Rows with a null key stay. Repeated rows of one key stay together or go together.
    """
    found = jaccard_components(df, key, text, **options)
    tag = free_name(df, "linked_key")
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(tag)).distinct()
    return df.join(gone, F.col(key) == F.col(tag), "left_anti")
