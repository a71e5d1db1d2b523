"""Exact dedup over an extendible-hash index on shared files (DataFrame functions only).

1. One pass gives every document its 64-bit key, digest and length: small rows in the shared folder.
2. The directory starts at the depth at which buckets should fit and doubles as long as a bucket is overfull:
   only keys of overfull buckets are counted again, one key bit deeper. Copies of a text have one key, which counts once.
3. Texts go to the owner of their bucket's keys. Copies are merged in the task that reads them (partial aggregate), so
   a text that a third of all rows share travels once per task. Rows group by the bytes of the text, not by hashes: texts that share
   a key but differ become links of that key's chain.
4. The index (bucket, key, chain link, digest, kept id, group size) is written sorted by key, each bucket by its owner,
   and every document looks its class up by key and digest.

Null text counts as empty; empty texts form one group. Of equal rows with equal ids one stays; a null id comes after all
others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmill.session import stored

#: Text bytes that one bucket may hold before it is split, and the directory's greatest depth (2^20 slots, 16 MB).
BUCKET_BYTES, MAX_DEPTH = 32 << 20, 20


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; runs that already are one space are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}", " ")


def slot(key: str | Column, depth: int | Column) -> Column:
    """The directory slot of a key: its leading ``depth`` bits (1 to 63)."""
    return F.expr(f"shiftrightunsigned({key}, {64 - depth})")


def directory(keys: DataFrame, bucket_bytes: int, max_depth: int) -> tuple[DataFrame, int]:
    """(slot at the final depth, bucket, depth of the bucket) and the final depth; ``keys`` has one row per key: h, bytes."""
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = min(max_depth, max(1, math.ceil(math.log2(max(1, total) / bucket_bytes) + 1)))
    live, settled = keys, None
    while True:
        level = stored(live.groupBy(slot("h", depth).alias("slot")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "directory")
        overfull = (F.col("bytes") > bucket_bytes) & (F.col("n") > 1)
        last = depth == max_depth or level.filter(overfull).isEmpty()
        done = (level if last else level.filter(~overfull)).select("slot", F.lit(depth).alias("depth"))
        settled = done if settled is None else settled.union(done)
        if last:
            break
        live = live.join(level.filter(overfull).select(F.col("slot").alias("full")), slot("h", depth) == F.col("full"), "left_semi")
        depth += 1
    low = F.expr(f"shiftleft(slot, {depth} - depth)")
    high = F.expr(f"shiftleft(slot + 1, {depth} - depth) - 1")
    table = settled.select(F.explode(F.sequence(low, high)).alias("slot"), (F.col("slot") * 64 + F.col("depth")).alias("bucket"), "depth")
    return stored(table, "directory"), depth


def index(docs: DataFrame, keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index over ``docs`` (doc_id, norm): bucket, depth, h, chain, sha, keep_id, group_size."""
    table, depth = directory(keys, bucket_bytes, max_depth)
    # At most 2^max_depth rows of 20 bytes whatever the input.
    owned = docs.select("doc_id", "norm", F.xxhash64("norm").alias("h"))
    classes = owned.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    placed = classes.join(F.broadcast(table), slot("h", depth) == table.slot).select("bucket", "depth", *classes.columns)
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha"))
    owners = placed.repartition("bucket").withColumn("chain", chain)
    return stored(owners.sortWithinPartitions("bucket", "h", "chain"), "exact-index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    entries = stored(norm.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("bigint").alias("bytes")), "exact-entries")
    keys = stored(entries.groupBy("h").agg(F.max("bytes").alias("bytes")), "exact-keys")
    classes = index(norm, keys, bucket_bytes, max_depth).select("bucket", "h", "sha", "keep_id", "group_size")
    same = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("h"))
    rows = entries.withColumn("same", same).join(classes, ["h", "sha"])
    return rows.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("same") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"), "bucket")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest id; columns stay as they are."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    first = exact_groups(docs, id_col, text_col).filter("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__id", key).withColumn("__sha", F.sha2(normalised(F.col(text_col)), 256))
    once = F.row_number().over(Window.partitionBy("__id", "__sha").orderBy("__sha"))
    return keyed.withColumn("__n", once).filter("__n = 1").join(first, ["__id", "__sha"], "left_semi").select(docs.columns)
