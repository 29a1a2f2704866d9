"""Helpers the operators share: byte-level words of an Arrow batch, hashes, guarded columns, paths."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrain.session import shared_folder

#: Text bytes worked on at once inside a task; one longer text is one piece.
PIECE_BYTES = 1 << 19
#: Any fixed odd multiplier serves; hashes must only agree between tasks.
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage, survives lost executors and, unlike a checkpoint of rows, is compressed and read by column. The
    shuffles behind it are done with; Spark deletes their files once the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame | None) -> None:
    """Delete a settled table that nothing will read again."""
    if df is None:
        return
    jvm, path = df.sparkSession._jvm, df.inputFiles()
    if path:
        folder = jvm.org.apache.hadoop.fs.Path(path[0]).getParent()
        if folder.getName().startswith("settled-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write ``df``, one row per key, as a table bucketed by ``key``, so that joins on it need no exchange of this side.

    The table lies in the shared checkpoint folder. Returns it and a function that drops it.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key).dropDuplicates([key])
    dealt.write.bucketBy(n, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    spark._jvm.System.gc()  # the exchange behind it is done with

    def drop() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.table(name), drop


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` written as a table bucketed by ``key`` in the shared folder, without a shuffle: for keys with many bytes each.

    Each task writes a file per bucket it has rows of.
    """
    spark = df.sparkSession
    name, n = f"bucketed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    spark._jvm.System.gc()
    return spark.table(name)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch for this session, so that whole long texts fit a task's memory.

    A session that already asks for fewer keeps its setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that clashes with none of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def whole(text: str | Column) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values are inside one of the ranges (ends included)."""
    mark = np.zeros(256, bool)
    for low, high in ranges:
        mark[low : high + 1] = True
    return mark


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_pieces(column: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; offsets start at 0. Nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece_bytes, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: Powers a task keeps for its next pieces; longer tables, for longer texts, are made anew.
_KEPT_POWERS = 1 << 20


def power_tables(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if n > _KEPT_POWERS:
        _kept = {}
    have = _kept.get("n", 0)
    if have < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            filled, step = 1, base
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * _U(step)
                filled *= 2
                step = step * step % (1 << 64)
            _kept[key] = out
        _kept["n"] = size
    return _kept["p"], _kept["q"]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
    p, q = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * p[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h ^ mix((ends - starts).astype(np.uint64)))


def words_of(data: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of marked bytes inside each row, and each row's first word (n + 1)."""
    inside = mark[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sha_hex(column: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(column, 256)


def hash_filter(keys: DataFrame, column: str, bits: int = 24) -> Callable[[str | Column], Column]:
    """A test that is true for every value of a 64-bit integer column of ``keys``, and for few others.

    It only spares rows a shuffle that would drop them in a join anyway: its size is fixed at 2**bits bits whatever the
    input, so more keys make it let more rows through, never fewer. Null passes.
    """
    size, part = 1 << bits >> 3, min(1 << 14, 1 << bits >> 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[mix(np.array(b.column(0).drop_null()).view(np.uint64)) >> _U(64 - bits)] = True
        parts = np.packbits(seen).reshape(-1, part)
        used = [k for k, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int32()), "marks": pa.array([parts[k].tobytes() for k in used], pa.binary())})

    def merge(rows):
        marks = np.bitwise_or.reduce([np.frombuffer(v.as_buffer(), np.uint8) for v in rows.column("marks")])
        return pa.table({"slice": rows.column("slice")[:1], "marks": pa.array([marks.tobytes()], pa.binary())})

    schema = "slice int, marks binary"
    rows = keys.select(F.col(column).cast("long")).mapInArrow(mark, schema).groupBy("slice").applyInArrow(merge, schema).collect()
    all_marks = np.zeros((size // part, part), np.uint8)
    for r in rows:
        all_marks[r["slice"]] = np.frombuffer(r["marks"], np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(all_marks.ravel())

    @F.arrow_udf("boolean")
    def may_hold(values: pa.Array) -> pa.Array:
        null = values.is_null().to_numpy(zero_copy_only=False)
        at = mix(values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> _U(64 - bits)
        hit = (sent.value[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1
        return pa.array(null | (hit == 1))

    return lambda name: may_hold((F.col(name) if isinstance(name, str) else name).cast("long"))
