"""Line dedup: similar lines found by MinHash banding, verified exactly, one line kept of each connected component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrain.llm.common import bucketed, free_name, hash_filter, mix, power_tables, settle, small_batches, unsettle
from riskgrain.llm.linking import connect, one_per_set

SHINGLE = 8
SIMILARITY = 0.8
#: Bands of values each: a pair at the similarity itself shares a band with probability 0.9998, at 0.85 with 0.99999.
BANDS, ROWS = 16, 4
#: Characters hashed at once, so that the work stays in the processor's cache.
_RUN = 1 << 15
#: Text bytes of the pairs of lines that a task compares at once; one longer pair is compared alone.
_PAIR_BYTES = 1 << 19
#: Band values a task gathers before it sends them out, and bytes of text whose band values are one group.
_GATHERED, _SLOT_BYTES = 1 << 20, 4 << 20
#: Lines a task remembers to have met.
_REMEMBERED = 100_000

_U = np.uint64


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return (made[:n] >> _U(32)).astype(np.uint32), (made[n:] >> _U(32)).astype(np.uint32) | np.uint32(1)


def shingle_hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the lines, and where each line's begin. A shorter line is one shingle."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(lengths) - lengths
    count = np.maximum(lengths - size + 1, np.minimum(lengths, 1))
    first = np.cumsum(count) - count
    p, q = power_tables(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + _U(1)) * p[: len(points)], out=total[1:])
    # hashes from every character on, of which those stay that end within their line; short lines are set below
    begins = np.zeros(len(points), bool)
    begins[np.arange(int(count.sum())) + np.repeat(starts - first, count)] = True
    h = np.zeros(len(points), np.uint64)
    h[: max(0, len(points) - size + 1)] = (total[size:] - total[: max(0, len(total) - size)]) * q[: max(0, len(points) - size + 1)]
    short = np.flatnonzero((lengths < size) & (lengths > 0))
    at = starts[short]
    h[at] = (total[at + lengths[short]] - total[at]) * q[at]
    return mix(h[begins]), np.append(first, int(count.sum()))


def signatures(h: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """lines x n MinHash values of non-empty runs of shingle hashes."""
    masks, odd = _multipliers(n)
    out = np.empty((n, len(bounds) - 1), np.uint32)
    short = (h >> _U(32)).astype(np.uint32)
    made = np.empty_like(short)
    for k in range(n):
        np.bitwise_xor(short, masks[k], out=made)
        np.multiply(made, odd[k], out=made)
        np.minimum.reduceat(made, bounds[:-1], out=out[k])
    return out.T


def _runs(lines: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for k, line in enumerate(lines):
        if size and size + len(line) > _RUN:
            yield at, k
            at, size = k, 0
        size += len(line)
    if at < len(lines):
        yield at, len(lines)


def band_members(lines: DataFrame, shingle: int, bands: int, rows: int, slots: int) -> DataFrame:
    """(slot, buckets, nodes) of the non-empty lines in (node, line): equally many 64-bit numbers, packed.

    A bucket lies in one of ``slots`` slots. A line met again in a task counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            bucket, node = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            slot = _slots(bucket, slots)
            order = np.argsort(slot, kind="stable")
            slot, bucket, node = slot[order], bucket[order], node[order]
            begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            ends = pa.array(np.append(begin, len(slot)).astype(np.int32) * 8)
            packed = [pa.Array.from_buffers(pa.binary(), len(begin), [None, ends.buffers()[1], pa.py_buffer(x)]) for x in (bucket, node)]
            return pa.RecordBatch.from_arrays([pa.array(slot[begin], pa.int32()), *packed], names=["slot", "buckets", "nodes"])

        for b in batches:
            nodes, first = np.unique(np.array(b.column(0)), return_index=True)
            new = np.array([x not in seen for x in nodes.tolist()], bool)
            nodes, first = nodes[new], first[new]
            if len(seen) > _REMEMBERED:
                seen.clear()
            seen.update(nodes.tolist())
            text = b.column(1).take(pa.array(first)).to_pylist()
            for x, y in _runs(text):
                h, bounds = shingle_hashes(text[x:y], shingle)
                sig = signatures(h, bounds, bands * rows).astype(np.uint64).reshape(y - x, bands, rows)
                key = np.broadcast_to(salt, (y - x, bands)).copy()
                for k in range(rows):
                    key = mix(key * _U(0xD6E8FEB86659FD93) + sig[:, :, k])
                held.append((key.ravel(), np.repeat(nodes[x:y], bands)))
            if sum(len(k) for k, _ in held) >= _GATHERED:
                yield sent()
        if held:
            yield sent()

    return lines.select("node", "line").mapInArrow(run, "slot int, buckets binary, nodes binary")


def _slots(bucket: np.ndarray, slots: int) -> np.ndarray:
    return (((bucket >> _U(32)) * _U(slots)) >> _U(32)).astype(np.int32)


def shared_buckets(packed: DataFrame) -> DataFrame:
    """The distinct (bucket, node) of packed members whose bucket holds at least two different nodes."""

    def pick(rows):
        numbers = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(v.as_buffer(), kind) for v in rows.column(name))])
        bucket, node = numbers("buckets", np.uint64), numbers("nodes", np.int64)
        order = np.argsort(bucket)
        bucket = bucket[order]
        same = bucket[1:] == bucket[:-1]
        again = np.append(same, False) | np.append(False, same)
        bucket, node = bucket[again], node[order[again]]
        order = np.lexsort((node, bucket))
        bucket, node = bucket[order], node[order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))[: len(bucket)]
        bucket, node = bucket[new], node[new]
        same = bucket[1:] == bucket[:-1]
        again = (np.append(same, False) | np.append(False, same))[: len(bucket)]
        return pa.table({"bucket": bucket[again].view(np.int64), "node": node[again]})

    return packed.groupBy("slot").applyInArrow(pick, "bucket bigint, node bigint")


def line_sets(lines: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each line, as sorted hashes of 52 bits: a line's number in a run takes the others."""
    low, rest = _U(52), _U((1 << 52) - 1)
    out = []
    for x, y in _runs(lines):
        h, bounds = shingle_hashes(lines[x:y], shingle)
        for u in range(0, y - x, 4096):
            v = min(u + 4096, y - x)
            row = np.repeat(np.arange(v - u, dtype=np.uint64), np.diff(bounds[u : v + 1]))
            h_of = np.sort((row << low) | (h[bounds[u] : bounds[v]] >> _U(12)))
            h_of = h_of[np.append(True, h_of[1:] != h_of[:-1])[: len(h_of)]]
            ends = np.searchsorted(h_of, np.arange(v - u, dtype=np.uint64) << low).tolist() + [len(h_of)]
            h_of &= rest
            out += [h_of[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def verify_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lines in (node, line) have at least the Jaccard similarity of shingles, counted exactly.

    Lines travel as text, which is a fraction of their sets' size; each task makes the sets of its lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, keep = np.array(b.column(0)), np.zeros(b.num_rows, bool)
            size = np.cumsum(np.array(pc.add(pc.binary_length(b.column(2)), pc.binary_length(b.column(3))), np.int64))
            x = 0
            while x < len(keys):
                # so many pairs that the sets of their lines stay small, however long the lines are
                y = max(x + 1, int(np.searchsorted(size, (size[x - 1] if x else 0) + _PAIR_BYTES, "right")))
                a = keys[x:y]
                begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                mine = line_sets(b.column(2).take(pa.array(x + begin)).to_pylist(), shingle)
                others = line_sets(b.column(3)[x:y].to_pylist(), shingle)
                for own, start, end in zip(mine, begin, [*begin[1:], len(a)], strict=True):
                    sizes = np.array([len(o) for o in others[start:end]])
                    flat = np.concatenate(others[start:end])
                    spot = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    common = np.add.reduceat((own[spot] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                    keep[x + start : x + end] = common >= similarity * (len(own) + sizes - common) - 1e-9
                x = y
            flags = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(flags), b.column(1).filter(flags)], names=["a", "b"])

    a = texts.select(F.col("node").alias("a"), F.col("line").alias("left"))
    z = texts.select(F.col("node").alias("b"), F.col("line").alias("right"))
    return pairs.join(z, "b").join(a, "a").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _shingles(line: str, size: int) -> set[str]:
    return {line[k : k + size] for k in range(max(1, len(line) - size + 1))}


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    lines = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("at", "line"))
    # without decoding the line, as a regular expression would
    return lines.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "").withColumn("node", F.xxhash64("line"))


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, at, node): every line, by place and hash, that a similar, or a chain of similar, earlier line makes redundant.

    Lines are the pieces between ``\\n``. Two lines are similar when the Jaccard similarity of their sets of ``shingle``
    characters is at least ``similarity`` (a shorter line is one shingle); equal lines always are. Of each component the
    line with the smallest (key, position, hash) stays. Lines of white space only take no part. Equal lines are told by a
    64-bit hash, unequal ones found through ``bands`` x ``rows`` MinHash values: by default one pair in 4,500 at
    similarity 0.8 shares no band and is missed unless other lines connect it, one in 130,000 at 0.85.
    """
    small_batches(df.sparkSession)
    occurrences = _lines(df, key, text)
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    slots = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // _SLOT_BYTES))
    found = settle(shared_buckets(band_members(occurrences, shingle, bands, rows, slots)))
    stored = settle(one_per_set(found))
    unsettle(found)
    members = stored.withColumn("n", F.lit(1).cast("bigint"))
    may_need = hash_filter(members, "node")
    needed = members.select("node").distinct()
    asked = occurrences.select("node", "line").where(may_need("node")).dropDuplicates(["node"])
    texts, drop = bucketed(asked.join(needed, "node", "left_semi"), "node")
    sets_of = lambda column: line_sets(column.to_pylist(), shingle)
    labels = connect(members, texts, similarity, 0.0, lambda pairs: verify_pairs(pairs, texts, shingle, similarity), sets_of)
    drop()
    unsettle(stored)
    slim = settle(occurrences.select("key", "at", "node"))
    first = slim.groupBy("node").agg(F.min(F.struct("key", "at", "node")).alias("first"), F.count("*").alias("copies"))
    first = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = first.groupBy("component").agg(F.min("first").alias("kept"), F.sum("copies").alias("copies"))
    kept = first.select("node", "component").join(whole.where("copies > 1"), "component").select("node", "kept")
    gone = slim.join(kept, "node").where(~F.struct("key", "at", "node").eqNullSafe(F.col("kept")))
    return gone.select("key", "at", "node").distinct()


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None, **options) -> DataFrame:
    """``df`` with the redundant lines taken out of each text, other columns and text without such lines unchanged.

    ``removed`` names a new column with the number of lines taken out; it must be a free name. A text that loses all its
    lines becomes empty; null stays null. Of rows with one key each loses only lines that stand in its own text; equal
    lines at one place in such rows cannot be told apart and stay or go together. Rows with a null key lose nothing, as
    nothing tells them apart, but their lines count: they come first in the order of keys, so equal lines elsewhere go.
    """
    if removed and removed.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column exists already: {removed}")
    count, at, tag = removed or free_name(df, "n_removed"), free_name(df, "gone_at"), free_name(df, "gone_key")
    found = removed_lines(df, key, text, **options).where("key is not null")
    gone = settle(found.groupBy("key").agg(F.collect_list(F.struct("at", "node")).alias("at")))
    gone = gone.select(F.col("key").alias(tag), F.col("at").alias(at))
    number = free_name(df, "key_hash")
    # keys of any type by a 64-bit hash; a row that passes without need loses nothing in the join
    may_lose = hash_filter(gone.select(F.xxhash64(tag).alias(number)), number)
    df = df.withColumn(number, F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.lit(0)))
    touched = may_lose(number) & F.col(key).isNotNull()
    # a column of its own, so that the text is split once and not for every line
    lines = free_name(df, "gone_lines")
    joined = df.where(touched).join(gone, F.col(key) == F.col(tag), "left").withColumn(lines, F.split(F.col(text).cast("string"), "\n", -1))
    # strings, which array_except compares by hash
    name = lambda k, node: F.concat_ws(":", k, node)
    own = F.transform(F.col(lines), lambda x, k: name(k, F.xxhash64(x)))
    kept = F.array_except(own, F.transform(F.col(at), lambda x: name(x["at"], x["node"])))
    joined = joined.withColumn(at, F.when(F.col(at).isNotNull(), kept))
    clean = F.array_join(F.transform(F.col(at), lambda k: F.get(F.col(lines), F.substring_index(k, ":", 1).cast("int"))), "\n")
    columns = [F.when(F.col(at).isNull(), F.col(c)).otherwise(clean).alias(c) if c == text else F.col(c) for c in df.columns]
    out = joined.select(*columns, F.coalesce(F.size(lines) - F.size(at), F.lit(0)).cast("long").alias(count))
    out = out.unionByName(df.where(~touched).withColumn(count, F.lit(0).cast("long")))
    return out.drop(number) if removed else out.drop(number, count)
