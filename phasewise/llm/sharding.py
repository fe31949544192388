"""Sharding by extendible hashing: a directory of hash prefixes, split where it must be.

All documents start in one bucket. A bucket over its byte limit is split on the next bit of
the hash, the others stay; so a shard is a hash prefix of its own length. Every round looks
at a few more bits of the rows still in oversized buckets: sums by prefix say which prefix
is short enough, and a directory, indexed by all bits seen so far, sends each row to its
shard or on to the next round. Only sums are gathered, never rows; all steps are DataFrame
operations.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasewise.llm.staging import carried, stage

LIMIT_BYTES = 1 << 20
HASH_BITS = 60
#: Bits looked at in a round; a directory has 2**ROUND_BITS entries per bucket at most.
ROUND_BITS = 8
#: Directories of up to so many entries are broadcast.
BROADCAST_ENTRIES = 100_000


def _prefix(depth):
    return F.expr(f"shiftright(hash, {HASH_BITS} - {depth})")


def _directory(rows: DataFrame, seen: int, limit: int) -> DataFrame:
    """entry, depth, shard_bytes, shard_docs; depth is null where a bucket must split on."""
    end = min(seen + ROUND_BITS, HASH_BITS)
    bins = rows.groupBy(_prefix(end).alias("entry")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"),
        F.min("hash").alias("low"), F.max("hash").alias("high"))
    bins = stage(bins, "shard-bins")
    # The bucket that led here was too large at depth ``seen``, except for the very first.
    depths = F.explode(F.sequence(F.lit(seen + 1 if seen else 0), F.lit(end))).alias("depth")
    at = F.expr(f"shiftright(entry, {end} - depth)").alias("prefix")
    levels = bins.select("*", depths).select("*", at)
    buckets = levels.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    # Rows with equal hashes cannot be told apart by more bits.
    fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high")))
    found = levels.select("entry", "depth", "prefix").join(
        fits.select("depth", "prefix", "shard_bytes", "shard_docs"), ["depth", "prefix"])
    leaf = found.groupBy("entry").agg(F.min_by(
        F.struct("depth", "shard_bytes", "shard_docs"), "depth").alias("leaf"))
    return stage(bins.select("entry").join(leaf, "entry", "left").select("entry", "leaf.*"),
                 "shard-directory")


def _hashed(docs: DataFrame):
    """Columns bytes and hash of a row; the hash is over id and text."""
    text = F.coalesce(docs["text"], F.lit(""))
    doc_id = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    identity = F.concat(doc_id, F.lit("\x1f"), text)
    digits = F.substring(F.md5(identity.cast("binary")), 1, HASH_BITS // 4)
    return (F.octet_length(text).cast("long").alias("bytes"),
            F.conv(digits, 16, 10).cast("long").alias("hash"))


def _digits(depth):
    return F.lpad(F.bin(_prefix(depth)), F.col(depth), F.lit("0"))


def _rounds(rows: DataFrame, limit: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Per round: the bits seen, its directory, and the rows in it with their entries' columns.

    ``rows`` has bytes and hash; directories that are small come with a broadcast hint.
    """
    columns, seen = rows.columns, 0
    while True:
        end = min(seen + ROUND_BITS, HASH_BITS)
        directory = _directory(rows, seen, limit)
        known = F.broadcast(directory) if directory.count() <= BROADCAST_ENTRIES else directory
        placed = rows.withColumn("entry", _prefix(end)).join(known, "entry")
        yield end, known, placed
        if end == HASH_BITS or directory.filter("depth is null").isEmpty():
            return
        rows = stage(placed.filter("depth is null").select(*columns), "shard-rest")
        seen = end


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the shard it belongs to.

    Columns: doc_id, shard (the hash prefix as binary digits; empty for the only shard),
    depth (their number), shard_bytes and shard_docs. Bytes are those of the UTF-8 text; a
    null or empty text has none. The hash is over id and text, so rows that repeat a doc_id
    spread, too. A shard exceeds the limit only if it holds a single row or rows equal in id
    and text. Null doc_ids are hashed as empty ids. Other columns are not read. An empty
    table has no shards.
    """
    rows = stage(docs.select("doc_id", *_hashed(docs)), "shard-rows")
    out = None
    for _, _, placed in _rounds(rows, limit_bytes):
        done = placed.filter("depth is not null").select(
            "doc_id", _digits("depth").alias("shard"), "depth", "shard_bytes", "shard_docs")
        out = done if out is None else out.unionByName(done)
    return out


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """Write all rows of documents as Parquet folders, one per shard, each by one task.

    Every row is hashed where it is read and looks its shard up in the directories, so rows
    without doc_id and rows that repeat one are written once, to the shard that
    ``assign_shards`` gives them. All columns are written; none may be named shard. The
    folder of the only shard is named by a null value.
    """
    rows = stage(docs.select(*_hashed(docs)), "shard-rows")
    directories = [(end, known) for end, known, _ in _rounds(rows, limit_bytes)]
    placed = docs.select(carried(docs), _hashed(docs)[1])
    depths = []
    for end, known in directories:
        depths.append(f"depth_{end}")
        leaf = known.select(F.col("entry").alias(f"entry_{end}"), F.col("depth").alias(depths[-1]))
        placed = placed.join(leaf, _prefix(end) == F.col(f"entry_{end}"), "left")
    # A later directory has entries for what the earlier ones send on only.
    placed = placed.withColumn("depth", F.coalesce(*depths))
    placed = placed.select("carried.*", _digits("depth").alias("shard"))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
