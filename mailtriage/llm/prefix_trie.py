"""The trie of conversations' prefixes, with shared prefixes found by a count-min screen.

1. *Rows.* A turn is the hash of its role and text and the text's size; texts go no further. Turns are numbered and their
   prefixes digested in two levels: within a range of the sorted turns, and by running totals over the ranges a
   conversation covers. A conversation of any length is spread over tasks. The digest of a prefix is the exclusive or
   of a 128-bit hash of each turn with its place: a place's digest is undone to get the digest of the parent.
2. *Rebuilding.* A conversation takes its first turns from the head of the first conversation of its family. A head has at
   most eight turns and is one short array on a row of the conversation.
3. *Screen.* A count-min sketch over the digests of all prefixes is added up from the tasks' parts. An estimate of one
   proves that a prefix is a single conversation's, and so are the longer ones: these rows are nodes already, and are
   emitted where they are. The sketch grows with the number of turns up to a bound, beyond which it proves less and more
   rows are grouped; the result is the same.
4. *Grouping.* Only rows that may be shared are shuffled, by digest, with partial sums first. What a node sums over its
   subtree is summed over its members instead: a leaf counts for its least member, and a member saves the turns from the
   node to where it stops following a smaller conversation.
5. *Hot groups.* The least conversation of the root is one value. The ids that end at a node are joined in blocks of
   neighbouring ids, and the blocks are hashed one after the other as they come sorted: no group is held in memory.

A null role or text counts as empty. Turns are ordered by turn, null first, and equal ones by the hash of role and text;
repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. An empty table
gives an empty result. Extra columns are not read. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailtriage.llm.tables import written
from mailtriage.llm.words import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILY = 5  # conversations share the head of the first of so many ids
HEADS = 9  # a head has fewer turns
SKETCH_ROWS = 3
LEAST_CELLS, MOST_CELLS = 1 << 12, 1 << 27  # of a row of the sketch
SEGMENT = 1 << 16  # cells that are added up together
DIGESTED_TOGETHER = 1 << 20  # rows
BLOCK = 4096  # neighbouring ids
NOTHING = hashlib.sha256(b"").hexdigest()


def head_size(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def _hashes(place: Column, turn: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), place.cast("long"), turn) for i in (1, 2)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, j, turn_hash, bytes``: the turns in order, numbered from 1. ``part``: the range that holds it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_hash"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ("conv_id", F.asc_nulls_first("turn"), "turn_hash")
    ranged = written(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:])).cast("long")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    parts = parts.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = ranged.withColumn("own", own).join(parts, ["conv_id", "part"])
    return written(
        placed.select("conv_id", "part", (F.col("own") + F.col("before")).alias("j"), "turn_hash", "bytes"), "numbered-turns"
    )


def _folded(head: Column, n: Column) -> list[Column]:
    """Digest and bytes of the first ``n`` turns of a head."""

    def over(part):
        return F.aggregate(F.slice(head, 1, n), F.lit(0).cast("long"), part)

    return [
        over(lambda acc, t: acc.bitwiseXOR(_hashes(t["j"], t["turn_hash"])[0])),
        over(lambda acc, t: acc.bitwiseXOR(_hashes(t["j"], t["turn_hash"])[1])),
        over(lambda acc, t: acc + t["bytes"]),
    ]


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, h, kept, n_turns, head, head1, head2, head_bytes``: what each conversation takes from its family."""
    first = F.when(F.col("j") < HEADS, F.struct("j", "turn_hash", "bytes"))
    own = turns.groupBy("conv_id").agg(F.max("j").alias("n"), F.collect_list(first).alias("first"))
    heads = own.select(F.col("conv_id").alias("family"), F.array_sort("first").alias("first"))
    family = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    found = own.select("conv_id", "n", family.alias("family"), head_size(F.col("conv_id")).alias("h"))
    found = found.join(heads, "family", "left")
    kept = F.least("h", F.coalesce(F.size("first"), F.lit(0)))
    empty = F.array().cast("array<struct<j:bigint,turn_hash:binary,bytes:bigint>>")
    found = found.withColumn("kept", F.when(F.col("first").isNull(), 0).otherwise(kept))
    found = found.withColumn("head", F.when(F.col("kept") > 0, F.slice("first", F.lit(1), F.col("kept"))).otherwise(empty))
    head = _folded(F.col("head"), F.col("kept"))
    return written(
        found.select(
            "conv_id",
            "h",
            "kept",
            (F.col("kept") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("n_turns"),
            "head",
            *(c.alias(name) for c, name in zip(head, ("head1", "head2", "head_bytes"), strict=True)),
        ),
        "conversations",
    )


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each prefix of a rebuilt conversation but the empty one: ``conv_id, depth``, its digest ``g1, g2``, the
    parent's ``p1, p2``, the ``bytes`` of its last turn and ``above`` it, and whether the conversation ``ends`` here."""
    head = F.col("head")
    at = F.explode(F.sequence(F.lit(1), F.col("kept"))).alias("i")
    heads = convs.where("kept > 0").select("conv_id", "n_turns", "head", at)
    turn = F.element_at(head, F.col("i"))
    whole, own = _folded(head, F.col("i")), _hashes(turn["j"], turn["turn_hash"])
    heads = heads.select(
        "conv_id",
        F.col("i").cast("long").alias("depth"),
        *(c.alias(f"g{i}") for i, c in enumerate(whole[:2], 1)),
        *(w.bitwiseXOR(o).alias(f"p{i}") for i, (w, o) in enumerate(zip(whole[:2], own, strict=True), 1)),
        turn["bytes"].alias("bytes"),
        (whole[2] - turn["bytes"]).alias("above"),
        (F.col("i") == F.col("n_turns")).alias("ends"),
    )
    keys = ["conv_id", "part"]
    parts = turns.select(*keys).distinct().join(convs.drop("head"), "conv_id")
    tails = turns.join(parts, keys).where(F.col("j") > F.col("h"))
    tails = tails.withColumn("depth", F.col("j") - F.col("h") + F.col("kept"))
    own = _hashes(F.col("depth"), F.col("turn_hash"))
    tails = tails.select("*", *(c.alias(f"x{i}") for i, c in enumerate(own, 1)))
    inside = Window.partitionBy(*keys).orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = written(
        tails.select(
            *keys,
            "depth",
            "x1",
            "x2",
            "bytes",
            (F.col("depth") == F.col("n_turns")).alias("ends"),
            F.bit_xor("x1").over(inside).alias("r1"),
            F.bit_xor("x2").over(inside).alias("r2"),
            F.sum("bytes").over(inside).alias("rb"),
        ),
        "tails",
    )
    sums = tails.groupBy(*keys).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(
        *keys,
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("o1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("o2"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("ob"),
    ).join(convs.select("conv_id", "head1", "head2", "head_bytes"), "conv_id")
    tails = tails.join(start, keys)
    digests = [F.col(f"r{i}").bitwiseXOR(F.col(f"o{i}")).bitwiseXOR(F.col(f"head{i}")) for i in (1, 2)]
    tails = tails.select(
        "conv_id",
        "depth",
        *(g.alias(f"g{i}") for i, g in enumerate(digests, 1)),
        *(g.bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i, g in enumerate(digests, 1)),
        "bytes",
        (F.col("rb") - F.col("bytes") + F.col("ob") + F.col("head_bytes")).alias("above"),
        "ends",
    )
    return written(heads.unionByName(tails), "prefixes")


def _cells(g1: np.ndarray, g2: np.ndarray, width: int) -> np.ndarray:
    """The cell of each digest in each row of the sketch; rows follow each other."""
    mask = np.uint64(width - 1)
    return np.stack(
        [(mixed(g1 + np.uint64(2 * r + 1) * g2) & mask).astype(np.int64) + r * width for r in range(SKETCH_ROWS)]
    )


def _digests(batch: pa.RecordBatch, names: tuple[str, str]) -> list[np.ndarray]:
    return [batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64) for name in names]


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Packed bits: the cells of the sketch that count two prefixes or more."""

    def dealt(cells: np.ndarray) -> pa.RecordBatch:
        """The cells that some rows hold, by segment: once, and again if there are more of them in these rows."""
        found, counts = np.unique(cells, return_counts=True)
        segment, first = np.unique(found // SEGMENT, return_index=True)
        low = (found % SEGMENT).astype(np.uint16)
        once, more = [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(found)], strict=True):
            many = counts[a:b] > 1
            once.append(low[a:b][~many].tobytes())
            more.append(low[a:b][many].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(segment, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
            names=["segment", "once", "more"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(_cells(*_digests(batch, ("g1", "g2")), width).ravel())
            n += batch.num_rows
            if n >= DIGESTED_TOGETHER:
                yield dealt(np.concatenate(kept))
                kept, n = [], 0
        if n:
            yield dealt(np.concatenate(kept))

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SEGMENT, np.uint8)
        for batch in batches:
            for once, more in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True):
                at = np.frombuffer(once, np.uint16)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(more, np.uint16)] = 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()])],
            names=["segment", "bits"],
        )

    parts = rows.select("g1", "g2").mapInArrow(gather, "segment long, once binary, more binary")
    added = parts.groupBy("segment").applyInArrow(add, "segment long, bits binary").toArrow()
    bits = np.zeros(SKETCH_ROWS * width // 8, np.uint8)  # at most MOST_CELLS / 8 bytes a row
    size = SEGMENT // 8
    for segment, own in zip(added.column("segment").to_pylist(), added.column("bits").to_pylist(), strict=True):
        at = segment * size
        bits[at : at + size] = np.frombuffer(own, np.uint8)[: len(bits) - at]
    return bits


def screened(rows: DataFrame, width: int, bits: Broadcast) -> DataFrame:
    """Adds ``alone`` and ``parent_alone``: whether the sketch proves that the prefix, or its parent, is one
    conversation's."""

    def prove(batch: pa.RecordBatch, names: tuple[str, str]) -> np.ndarray:
        cells = _cells(*_digests(batch, names), width)
        return ~(bits.value[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(axis=0).astype(bool)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = batch.column("depth").to_numpy() == 1
            flags = [prove(batch, ("g1", "g2")), prove(batch, ("p1", "p2")) & ~root]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.bool_()) for x in flags)], names=[*batch.schema.names, "alone", "parent_alone"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{kinds}, alone boolean, parent_alone boolean")


def end_hashes(ending: DataFrame) -> DataFrame:
    """``g1, g2, depth, ends_sha256`` from ``g1, g2, depth, conv_id``: the hash of the ids that end at a node, ascending."""
    keys = ["g1", "g2", "depth"]
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ending.groupBy(*keys, block).agg(ids.alias("ids"))
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            arrays = [pa.array([x], pa.int64()) for x in node]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([state.hexdigest()])], names=[*keys, "ends_sha256"])

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in keys]
            for own, ids in zip(zip(*columns, strict=True), batch.column("ids").to_pylist(), strict=True):
                if own == node:
                    state.update(b",")
                else:
                    if node is not None:
                        yield row()
                    node, state = own, hashlib.sha256()
                state.update(ids.encode())
        if node is not None:
            yield row()

    return dealt.select(*keys, "ids").mapInArrow(work, "g1 long, g2 long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for every node."""
    context = conversations.sparkSession.sparkContext
    turns = numbered_turns(conversations)
    convs = conversations_of(turns)
    found = prefixes(turns, convs)
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * found.count()).bit_length()))
    bits = context.broadcast(sketch(found, width))
    rows = written(screened(found, width, bits), "screened-prefixes")
    bits.destroy()
    node, parent = ["g1", "g2", "depth"], ["p1", "p2"]
    single, shared = rows.where("alone"), rows.where("not alone")

    # What each conversation is the least member of, and whether that ends in a leaf.
    n_ends = F.count_if("ends")
    owned = shared.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.first("above").alias("above"), (n_ends == F.count("*")).alias("leaf")
    )
    ended = shared.where("ends").select("conv_id", (F.col("above") + F.col("bytes")).alias("whole"))
    facts = (
        owned.select("conv_id", "depth", "above", "leaf")
        .unionByName(single.select("conv_id", "depth", "above", F.col("ends").alias("leaf")))
        .unionByName(ended, allowMissingColumns=True)
        .groupBy("conv_id")
        .agg(F.min_by("above", "depth").alias("own"), F.max("whole").alias("whole"), F.max("leaf").alias("leaf"))
    )
    own = F.coalesce("own", "whole", F.lit(0))  # bytes before the first node that is its own
    facts = written(facts.select("conv_id", own.alias("own"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")), "owned")

    nodes = written(
        shared.join(facts, "conv_id")
        .groupBy(*node)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.first("p1").alias("p1"),
            F.first("p2").alias("p2"),
            F.first("parent_alone").alias("parent_alone"),
            F.count("*").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.greatest(F.lit(0), F.col("own") - F.col("above"))).alias("saved_tokens"),
        ),
        "shared-nodes",
    )
    kin = nodes.select("conv_id", *parent, "depth").unionByName(
        single.where("not parent_alone").select("conv_id", *parent, "depth")
    )
    children = kin.where("depth > 1").groupBy(
        F.col("p1").alias("g1"), F.col("p2").alias("g2"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count("*").alias("n_children"))
    turnless = convs.where("n_turns = 0").select(*(F.lit(0).cast("long").alias(c) for c in node), "conv_id")
    ends = written(end_hashes(shared.where("ends").select(*node, "conv_id").unionByName(turnless)), "ends")

    least = convs.agg(F.min("conv_id")).first()[0]
    above = nodes.select(
        F.col("g1").alias("p1"), F.col("g2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up")
    )
    up = F.when(F.col("depth") == 1, F.lit(least).cast("long")).when(F.col("parent_alone"), F.col("conv_id")).otherwise(F.col("up"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def with_parent(table: DataFrame) -> DataFrame:
        return table.join(above, [*parent, "depth"], "left").withColumn("parent_conv_id", up)

    several = with_parent(nodes.join(children, node, "left").join(ends, node, "left"))
    several = several.withColumns(
        {"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))}
    )
    alone = single.withColumns(
        {
            "n_convs": one,
            "n_children": F.when(F.col("ends"), zero).otherwise(one),
            "n_leaves": one,
            "saved_tokens": zero,
            "ends_sha256": F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)),
        }
    )
    tops = with_parent(alone.where("not parent_alone"))
    tails = alone.where("parent_alone").withColumn("parent_conv_id", F.col("conv_id"))
    return (
        several.select(*columns)
        .unionByName(tops.select(*columns))
        .unionByName(tails.select(*columns))
        .unionByName(_root(convs, facts, kin, ends).select(*columns))
    )


def _root(convs: DataFrame, facts: DataFrame, kin: DataFrame, ends: DataFrame) -> DataFrame:
    """The root's row, or none if there is no conversation: four rows of sums, put together."""
    rows = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    for part in (
        facts.agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved")),
        kin.where("depth = 1").agg(F.count("*").alias("children")),
        ends.where("depth = 0").agg(F.max("ends_sha256").alias("ends")),
    ):
        rows = rows.unionByName(part, allowMissingColumns=True)
    root = rows.agg(*(F.max(c).alias(c) for c in rows.columns)).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    return root.select(
        "conv_id",
        zero.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.col("children").alias("n_children"),
        F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )
