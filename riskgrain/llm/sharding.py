"""Sharding by extendible hashing: oversized buckets split on one more hash bit until every shard fits its byte limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrain.llm.common import free_name, settle

#: Bits of a row's hash.
HASH_BITS = 60
#: Directory levels built at once beyond those the total size asks for.
SPARE_BITS = 4
LIMIT_BYTES = 64 << 20
#: Copies of one key and size numbered from one list.
_CHUNK = 1 << 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(h), HASH_BITS - depth)


def directory(cells: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(depth, prefix, bytes, parted) of the buckets between two depths, from ``cells`` (cell of ``high`` bits, bytes).

    A bucket splits only if it exceeds the limit. Buckets at depth ``high`` that still do have ``parted`` true.
    """
    depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    levels = cells.select("cell", "bytes", depths).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, cast({high} - depth as int))"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    parents = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    children = sums.withColumn("parent", F.expr("shiftrightunsigned(prefix, 1)"))
    split = children.join(parents, ["depth", "parent"], "left_semi").unionByName(children.where(F.col("depth") == low))
    final = split.where((F.col("bytes") <= limit) | (F.col("depth") == high))
    return final.select("depth", "prefix", "bytes", (F.col("bytes") > limit).alias("parted"))


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """(key, copy, bytes, depth, shard, shard_bytes): the shard of every row.

    A row's size is its text's UTF-8 bytes, null as none. Its hash comes from key and copy number, which counts the rows
    that share key and size from 0, so a repeated key spreads over shards like any other rows. ``shard`` is the bucket's
    hash prefix in bits (empty: no split was needed). A row larger than the limit alone is a shard of its own, named
    ``+key#copy``, the only case in which ``shard_bytes`` exceeds the limit; so is, by name only, each row of a bucket
    that all bits of the hash cannot split. A null key counts as an empty one. No rows give no shards.
    """
    sizes = df.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("bytes"))
    counted = sizes.groupBy("key", "bytes").agg(F.count("*").alias("copies"))
    # copies in two levels, so that no row holds a list as long as a hot key's rows
    counted = counted.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_CHUNK})")))
    ends = F.least(F.col("copies"), (F.col("chunk") + 1) * _CHUNK) - 1
    rows = counted.withColumn("copy", F.explode(F.sequence(F.col("chunk") * _CHUNK, ends))).select("key", "bytes", "copy")
    own = F.coalesce(F.col("key").cast("string"), F.lit(""))
    name = F.when(F.col("copy") == 0, own).otherwise(F.concat_ws("#", own, F.col("copy").cast("string"), F.col("bytes").cast("string")))
    rows = settle(rows.withColumn("h", hash_bits(name)))
    alone = [rows.where(F.col("bytes") > limit)]
    open_rows, low, placed = rows.where(F.col("bytes") <= limit), 0, []
    while True:
        total = open_rows.agg(F.sum("bytes")).first()[0] or 0
        high = min(HASH_BITS, low + max(total // max(limit, 1), 1).bit_length() + SPARE_BITS)
        cells = open_rows.groupBy(_prefix("h", high).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        found = settle(directory(cells, limit, low, high))
        # the directory proper: one entry for every cell of the deepest level, many pointing to one bucket
        first, end = (F.expr(f"shiftleft(prefix + {k}, cast({high} - depth as int))") for k in (0, 1))
        entries = found.withColumn("cell", F.explode(F.sequence(first, end - 1)))
        entries = entries.select("cell", "depth", "prefix", F.col("bytes").alias("shard_bytes"), "parted")
        met = open_rows.withColumn("cell", _prefix("h", high)).join(entries, "cell")
        placed.append(met.where(~F.col("parted")).select("key", "copy", "bytes", "depth", "prefix", "shard_bytes"))
        rest = met.where("parted").select("key", "bytes", "copy", "h")
        if found.where("parted").limit(1).count() == 0:
            break
        if high == HASH_BITS:
            alone.append(rest)
            break
        open_rows, low = settle(rest), high
    bits = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), HASH_BITS, "0")
    out = None
    for p in placed:
        shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.substring("bits", F.lit(HASH_BITS + 1) - F.col("depth"), F.col("depth")))
        p = p.withColumn("bits", bits).select("key", "copy", "bytes", "depth", shard.alias("shard"), "shard_bytes")
        out = p if out is None else out.unionByName(p)
    for p in alone:
        shard = F.concat(F.lit("+"), own, F.lit("#"), F.col("copy").cast("string"))
        out = out.unionByName(p.select("key", "copy", "bytes", F.lit(HASH_BITS).alias("depth"), shard.alias("shard"), F.col("bytes").alias("shard_bytes")))
    return out.select(F.col("key").alias(key), *out.columns[1:])


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """Write the rows of ``df`` as Parquet under ``path/shard=.../`` and return the assignment; keys must be unique."""
    found = settle(assign_shards(df, key, text, limit))
    column, tag = free_name(df, "shard"), free_name(df, "shard_key")
    named = found.select(F.col(key).alias(tag), F.concat(F.lit("s"), F.col("shard")).alias(column))
    joined = df.join(named, F.col(key).eqNullSafe(F.col(tag))).drop(tag)
    joined.repartition(F.col(column)).write.partitionBy(column).parquet(path)
    return found
