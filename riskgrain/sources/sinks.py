"""Writers and all-or-nothing publication through the Hadoop file system API."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from riskgrain.schemas import ID, SPLIT, TARGET

ROW_GROUP_ROWS = 100_000


def write_mart(df: DataFrame, path: str, ordered: bool = True, partitions: int | None = None) -> None:
    """ZSTD Parquet. ``ordered`` lays files out by id range, sorted inside each file."""
    if ordered:
        df = df.repartitionByRange(partitions, ID) if partitions else df.repartitionByRange(ID)
        df = df.sortWithinPartitions(ID)
    df.write.mode("overwrite").option("compression", "zstd").option(
        "parquet.block.row.count.limit", ROW_GROUP_ROWS
    ).parquet(path)


def write_assignments(assignments: DataFrame, path: str) -> None:
    """Id-ascending CSV with a header (global order across files by range partitioning)."""
    assignments.select(ID, TARGET, SPLIT).orderBy(ID).write.mode("overwrite").option("header", True).option(
        "lineSep", "\n"
    ).csv(path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return hadoop, target.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(
    spark: SparkSession,
    writers: Mapping[str, Callable[[str], None]],
    check: Callable[[dict[str, str]], None] | None = None,
) -> None:
    """Write every output beside its destination, check all of them, then swap them in.

    Nothing visible changes when a writer or the check fails. The last output named is swapped last,
    so a summary placed there marks a complete publication.
    """
    tag = uuid.uuid4().hex[:12]
    staged = {final: f"{final.rstrip('/')}.staging-{tag}" for final in writers}
    moved: list[tuple[str, str | None]] = []

    def path(p: str):
        hadoop, fs = _fs(spark, p)
        return fs, hadoop.Path(p)

    def rename(a: str, b: str) -> None:
        fs, source = path(a)
        if not fs.rename(source, path(b)[1]):
            raise OSError(f"cannot rename {a} to {b}")

    try:
        for final, write in writers.items():
            write(staged[final])
        if check is not None:
            check(staged)
        for final, temporary in staged.items():
            fs, target = path(final)
            backup = None
            if fs.exists(target):
                backup = f"{final.rstrip('/')}.previous-{tag}"
                rename(final, backup)
            moved.append((final, backup))
            rename(temporary, final)
    except BaseException:
        for final, backup in reversed(moved):
            fs, target = path(final)
            fs.delete(target, True)
            if backup is not None:
                rename(backup, final)
        for temporary in staged.values():
            fs, target = path(temporary)
            fs.delete(target, True)
        raise
    for _, backup in moved:
        if backup is not None:
            fs, target = path(backup)
            fs.delete(target, True)
