"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

1. Every row goes into the index once: its own columns, a row number, the 64-bit key of its normalised text
   (ASCII white space deleted) and the text's SHA-256, written to the shared folder.
2. The directory starts at the depth at which an average bucket is full and doubles while a bucket holds more
   than ``capacity`` distinct keys; a bucket that need not split is shared by the slots below its prefix. It doubles
   up to ``DEEPEST``, so that it has 2^18 slots at most and can be sent to every task; buckets of a table too large
   for that hold more keys.
3. Each entry looks its bucket up in the directory and is dealt by it: one owner task takes whole buckets. Rows of one
   key form a chain there whose texts are compared byte by byte: they are grouped by the text itself.
4. A key that fills more than a bucket with its rows and holds more than one part in ``MOST_HOT`` of all text (so there
   are fewer than ``MOST_HOT`` of them) has its copies folded in each task before they are sent to their owner.

Null texts are empty texts, and all empty texts are equal. Of equal texts the row with the most code points in its
original text stays, then the one with the smallest id, a missing id last; of rows that repeat both, the first one
read. An empty table gives an empty result. Other columns, whatever their names, are carried in ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtriage.llm.tables import written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
CAPACITY = 1024
DEEPEST = 18
MOST_HOT = 1024
_LAST_ID = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of the input), ``uid``, ``doc_id``, ``key``, ``sha``, ``points``, as written files."""
    text = normalised(docs[text_col])
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        F.monotonically_increasing_id().alias("uid"),
        docs[id_col].cast("long").alias("doc_id"),
        F.xxhash64(text).alias("key"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("points"),
    )
    return written(rows, "dedup-index")


def count_keys(index: DataFrame) -> DataFrame:
    """``key``, its ``rows``, and ``size``: the code points of their texts and one for each row."""
    counts = index.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.col("points") + 1).alias("size"))
    return written(counts, "dedup-keys")


def build_directory(keys: DataFrame, capacity: int = CAPACITY, deepest: int = DEEPEST) -> tuple[DataFrame, int]:
    """``slot, bucket, depth`` for every slot in use, and the directory's depth. ``bucket`` is the prefix of
    ``depth`` bits that the slots of one bucket share."""
    first = depth = min(deepest, max(0, math.floor(math.log2(max(1, keys.count()) / capacity))))
    levels = []
    while True:
        level = keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
        levels.append(level)
        fullest = level.agg(F.max("n")).first()[0] or 0
        if fullest <= capacity or depth == deepest:
            break
        depth += 1
    slots = levels[-1].select("slot")
    bucket, local = F.col("slot"), F.lit(depth)
    for i in reversed(range(len(levels) - 1)):
        up = depth - first - i
        level = levels[i].select(F.col("slot").alias("above"), F.col("n").alias(f"n{i}"))
        slots = slots.join(level, F.shiftrightunsigned("slot", up) == F.col("above")).drop("above")
        fits = F.col(f"n{i}") <= capacity
        bucket = F.when(fits, F.shiftrightunsigned("slot", up)).otherwise(bucket)
        local = F.when(fits, F.lit(first + i)).otherwise(local)
    return slots.select("slot", bucket.alias("bucket"), local.alias("depth")), depth


def hot_keys(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The keys, fewer than ``MOST_HOT``, whose copies are folded before they are sent."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    return keys.where((F.col("rows") > capacity) & (F.col("size") > total / MOST_HOT)).select("key")


def _chains(entries: DataFrame) -> DataFrame:
    """An entry for each distinct text of a bucket: its greatest ``place``, and how many rows hold it."""
    return (
        entries.groupBy("bucket", "depth", "key", "sha", "bytes")
        .agg(F.max("place").alias("place"), F.count("*").alias("group_size"))
        .drop("bytes")
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per input row: ``row``, ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and the
    ``bucket`` of the index with its ``depth``."""
    index = build_index(docs, id_col, text_col)
    keys = count_keys(index)
    directory, depth = build_directory(keys, capacity)
    hot = F.broadcast(written(hot_keys(keys, capacity), "dedup-hot"))
    # One number for "most code points, then least id": fixed in width, so that Spark's hash aggregation can hold it.
    shift = F.lit("1" + "0" * 20).cast("decimal(21,0)")
    order = F.col("points").cast("decimal(10,0)") * shift - F.coalesce("doc_id", F.lit(_LAST_ID)).cast("decimal(20,0)")
    directory = F.broadcast(written(directory, "dedup-directory"))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(directory, _slot(F.col("key"), depth) == F.col("slot"))
        bytes_ = normalised(F.col(f"row.{text_col}")).alias("bytes")
        return rows.select("bucket", "depth", "key", "sha", bytes_, order.alias("place"))

    owned = placed(index.join(hot, "key", "left_anti")).repartition("bucket", "depth")
    folded = placed(index.join(hot, "key", "left_semi"))
    entries = written(_chains(owned).unionByName(_chains(folded)), "dedup-entries")
    rows = index.select("uid", "doc_id", "key", "sha", order.alias("place"))
    best = (
        rows.join(entries.select("key", "sha", "place"), ["key", "sha", "place"])
        .groupBy("key", "sha")
        .agg(F.min("uid").alias("keep_uid"), F.min("doc_id").alias("keep_id"))
    )
    groups = written(entries.drop("place").join(best, ["key", "sha"]), "dedup-groups")
    return index.join(groups, ["key", "sha"]).select(
        "row",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "depth",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    found = exact_duplicates(docs, id_col, text_col).where("kept")
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))
