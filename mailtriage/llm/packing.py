"""Sequence packing by best-two-fit.

Documents become token ids with an end id; those longer than a sequence are cut into full pieces after a first piece
that may be shorter. Packing depends on nothing but the lengths, so it is planned on their histogram, whose size is
the sequence length whatever the input: a bin is filled greedily with the longest pieces that still fit; then, if
its shortest piece can be swapped for two unpacked ones that fill the widened gap further, it is. A bin so made is
repeated as long as the lengths it takes last, so the plan is a list of patterns with counts.

Pieces learn their place without any window over a hot length: a piece has a rank among those of its length in its
batch, batches have running totals for each length, and the rank so made is looked up in the plan, which is
broadcast (its size is bounded by the sequence length).

A null text is empty and gives the end id alone. Repeated rows are packed each for itself. An empty table gives an
empty result. Extra columns are not read. Texts of any length are encoded whole. The file's added tokens are found in texts
as the tokenizer finds them: their strings become their ids.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailtriage.llm.tables import texts, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def load_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a ``tokenizers`` file: the same ids, several times faster."""
    import public_tokenizers

    model = json.loads(Path(path).read_text(encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary shows as they are
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
    ranks = {
        bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special
    }
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoded(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text, those of added tokens where their strings stand."""
    return encoding.encode(text, allowed_special="all")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` ids."""
    first = n if n <= most else n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def tokenize(
    docs: DataFrame,
    path: str | None = None,
    most: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, with ``ids`` if asked for, and ``chunk, place``: the batch and the
    rank among the pieces of that length in it."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, place long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        first_chunk = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            rows: list[tuple] = []
            seen = [0] * (most + 1)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoded(encoding, text), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), most)):
                    own = ids[start : start + length].tobytes()
                    row = (doc_id, piece, start, length, zlib.crc32(own), first_chunk + number, seen[length])
                    rows.append((*row, np.frombuffer(own, "<u4").tolist()) if with_ids else row)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * with_ids]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[*schema.replace(",", "").split()[::2], *["ids"] * with_ids],
            )

    return texts(docs, id_col, text_col).mapInArrow(work, schema + ", ids array<long>" * with_ids)


def fill(counts: Sequence[int], capacity: int) -> tuple[list[int], int]:
    """One bin from a histogram (``counts[n]`` pieces of length n), longest first, and the length that the swap gave
    back, or 0. The histogram is left as it is."""
    left = np.array(counts)
    sizes = np.arange(len(left))

    def floors() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    bin_, gap, floor = [], capacity, floors()
    while gap and (size := int(floor[min(gap, len(floor) - 1)])):
        bin_.append(size)
        left[size] -= 1
        gap -= size
        if not left[size]:
            floor = floors()
    if not gap or not bin_:
        return bin_, 0
    smallest = bin_[-1]
    wide = min(gap + smallest, len(left) - 1)
    once = np.maximum.accumulate(np.where(left > 0, sizes, 0))
    longer = np.flatnonzero(left[: wide + 1] > 0)
    longer = longer[longer > 0]
    room = np.minimum(gap + smallest - longer, longer)
    shorter = np.where(room > 0, once[np.maximum(room, 0)], 0)
    twice = (shorter == longer) & (left[longer] < 2)
    shorter = np.where(twice, once[np.maximum(longer - 1, 0)], shorter)
    total = np.where(shorter > 0, longer + shorter, 0)
    if len(total) and total.max() > smallest:
        best = int(total.argmax())
        return sorted([*bin_[:-1], int(longer[best]), int(shorter[best])], reverse=True), smallest
    return bin_, 0


def plan(counts: Sequence[int], capacity: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns and how often each is repeated; all pieces of the histogram are used."""
    left = np.array(counts, dtype=np.int64)
    runs = []
    while left[1:].any():
        pattern, swapped = fill(left, capacity)
        sizes, needs = np.unique(pattern, return_counts=True)
        times = left[sizes] // needs
        if swapped in sizes:  # the piece that was given back has to be there each time
            at = int(np.flatnonzero(sizes == swapped)[0])
            times[at] = (left[swapped] - 1) // needs[at]
        repeat = max(1, int(times.min()))
        left[sizes] -= needs * repeat
        runs.append((pattern, repeat))
    return runs


class Places:
    """Sequence and offset of the piece of a length with a rank."""

    def __init__(self, runs: Sequence[tuple[list[int], int]], capacity: int):
        self.runs: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        used, first = [0] * (capacity + 1), 0
        for pattern, repeat in runs:
            offsets: dict[int, list[int]] = {}
            at = 0
            for size in pattern:
                offsets.setdefault(size, []).append(at)
                at += size
            for size, own in offsets.items():
                self.runs[size].append((used[size], first, own))
                used[size] += len(own) * repeat
            first += repeat
        self.starts = [np.array([r[0] for r in own], np.int64) for own in self.runs]

    def find(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.starts[size], ranks, "right") - 1
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for r in np.unique(run).tolist():
            start, first, own = self.runs[size][r]
            at = np.flatnonzero(run == r)
            nth = ranks[at] - start
            sequence[at] = first + nth // len(own)
            offset[at] = np.array(own, np.int64)[nth % len(own)]
        return sequence, offset


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` in place of ``chunk`` and ``place``. ``pieces``: a written table."""
    totals = written(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "packing-totals")
    counts = np.zeros(capacity + 1, np.int64)
    for row in totals.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        counts[row["length"]] = row["n"]
    places = Places(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["chunk", "length"]).withColumn("place", F.col("place") + F.col("before"))
    kept = [c for c in pieces.columns if c not in ("chunk", "place")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    sequence[own], offset[own] = places.find(int(length[own[0]]), rank[own])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    return ranked.select(*kept, "place").mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    most: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and the token ids if asked for."""
    pieces = written(tokenize(docs, path, most, end_id, with_ids, id_col, text_col), "packing-pieces")
    return pack(pieces, most)
