"""Benchmark decontamination with spaced seeds.

Words are runs between white space, in lower case and without ASCII punctuation. A document overlaps an item if, on one
diagonal, ``WINDOW`` consecutive words agree but for at most ``SUBSTITUTIONS``. An item shorter than the window has to
occur whole: with one word substituted at most from ``SPACED`` words on, unchanged below. Fewer than ``SHORT`` words are
everyday phrases, which clean documents hold too: such an item overlaps only a document that has no other words.

Two fixed masks of six words each ignore the other places of the window; together they hit every such window. A mask of
every other word, laid at an item's first and second word, does so for the short items that bear a substitution (a test
goes through all patterns of substitutions for both), so no overlap is missed. Hashes of the masked windows of all items
are sorted arrays, documents probe them in Arrow batches, and around each hit the whole diagonal is compared word by word.

Items are taken in blocks of at most ``most_seeds`` hashes, each broadcast in its turn to a scan of the documents, so
neither side is shuffled and what is broadcast has that bound.

A null text is empty and overlaps nothing. Rows without an id are carried like others; repeated rows are judged alike.
Items without an id are not looked for; rows that repeat an item's id are looked for each and reported under the id. An
empty table on either side gives an empty result. Texts of any length are read whole. Extra columns are not read.
"""

from __future__ import annotations

import string
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtriage.llm.tables import slices, texts, written
from mailtriage.llm.words import WordHashes, hashed, windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
SUBSTITUTIONS = 2
SPACED = 8
SHORT = 5
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 7, 9, 10))
SHORT_MASK = (0, 2, 4, 6)  # for items from SPACED words up to the window, at their first two words
_WHOLE = tuple(range(SHORT))  # for items from SHORT words up to SPACED, at their first word
MOST_SEEDS = 1 << 21
_CHAINED = 4
_NO_PUNCTUATION = string.punctuation.encode()
_FOUND = "array<struct<item_id:long,start:int,end:int,item_start:int,matched:int>>"
_FOUND_ARROW = pa.list_(
    pa.struct([("item_id", pa.int64()), *((x, pa.int32()) for x in ("start", "end", "item_start", "matched"))])
)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(None, _NO_PUNCTUATION).split()


def allowance(n: int) -> tuple[int, int]:
    """The window of an item of ``n`` words, and how many of its words may be others."""
    return (WINDOW, SUBSTITUTIONS) if n >= WINDOW else (n, int(n >= SPACED))


def seeds_of(n: int) -> list[tuple[tuple[int, ...], int | None]]:
    """The masks for an item of ``n`` words, each with the number of places it is laid at (none: at all)."""
    if n >= WINDOW:
        return [(mask, None) for mask in MASKS]
    if n >= SPACED:
        return [(SHORT_MASK, 2)]
    return [(_WHOLE, 1)] if n >= SHORT else []


class Seeds:
    """Masked windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        memo = WordHashes()
        self.ids = [i for i, _ in items]
        self.items = [hashed([words(t)], memo)[0] for _, t in items]
        self.tables = []
        self.phrases: dict[bytes, list[int]] = {}
        seeds: dict[tuple, tuple[list, list, list]] = {}
        for n, item in enumerate(self.items):
            if 0 < len(item) < SHORT:
                self.phrases.setdefault(item.tobytes(), []).append(n)
            for mask, places in seeds_of(len(item)):
                own = windows(item, mask)[:places]
                for column, x in zip(
                    seeds.setdefault(mask, ([], [], [])), (own, np.full(len(own), n), np.arange(len(own))), strict=True
                ):
                    column.append(x)
        for mask, columns in seeds.items():
            values, owner, place = (np.concatenate(x) for x in columns)
            order = np.argsort(values, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.tables.append((mask, marks, values[order], owner[order], place[order]))

    def diagonals(self, values: np.ndarray) -> set[tuple[int, int]]:
        """Item number and shift (place in the text less place in the item) of every hit."""
        found: set[tuple[int, int]] = set()
        for mask, marks, hashes, owner, place in self.tables:
            own = windows(values, mask)
            at = np.flatnonzero(marks[(own & np.uint64(0xFFFFF)).astype(np.int64)])
            low = np.searchsorted(hashes, own[at], "left")
            high = np.searchsorted(hashes, own[at], "right")
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                found.update(zip(owner[a:b].tolist(), (i - place[a:b]).tolist(), strict=True))
        return found

    def overlap(self, values: np.ndarray, start: int, end: int, n: int, shift: int) -> list[tuple[int, int, int, int]]:
        """Stretches of the text (words ``start`` to ``end`` of the batch) that overlap the item on this diagonal: start
        and end in the text, start in the item, words that agree."""
        item = self.items[n]
        low, high = max(start, shift), min(end, shift + len(item))
        window, allowed = allowance(len(item))
        if high - low < window:
            return []
        agree = np.concatenate([[0], np.cumsum(values[low:high] == item[low - shift : high - shift])])
        good = np.flatnonzero(agree[window:] - agree[:-window] >= window - allowed)
        if not len(good):
            return []
        breaks = np.flatnonzero(np.diff(good) > window)
        firsts = good[np.concatenate([[0], breaks + 1])]
        lasts = good[np.concatenate([breaks, [len(good) - 1]])] + window
        return [
            (int(low - start + a), int(low - start + b), int(low - shift + a), int(agree[b] - agree[a]))
            for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)
        ]

    def search(self, batch: list[str | None], memo: WordHashes) -> list[list[dict]]:
        values, starts = hashed([words(t) for t in batch], memo)
        found: list[dict[tuple, dict]] = [{} for _ in batch]
        if self.phrases:
            sizes = np.diff(starts)
            for row in np.flatnonzero((sizes > 0) & (sizes < SHORT)).tolist():
                end = int(sizes[row])
                for n in self.phrases.get(values[starts[row] : starts[row + 1]].tobytes(), ()):
                    found[row][(self.ids[n], 0, end, 0)] = dict(
                        item_id=self.ids[n], start=0, end=end, item_start=0, matched=end
                    )
        for n, shift in sorted(self.diagonals(values)):
            # A diagonal may run through several texts: each that lies under the item is looked at.
            row = max(0, int(np.searchsorted(starts, shift, "right")) - 1)
            while row < len(batch) and starts[row] < shift + len(self.items[n]):
                for a, b, item_start, matched in self.overlap(values, int(starts[row]), int(starts[row + 1]), n, shift):
                    found[row][(self.ids[n], a, b, item_start)] = dict(
                        item_id=self.ids[n], start=a, end=b, item_start=item_start, matched=matched
                    )
                row += 1
        return [[own[k] for k in sorted(own)] for own in found]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most_seeds: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``most_seeds`` masked windows, each bounded."""
    items = texts(benchmark, id_col, text_col).where("doc_id is not null")
    size = F.size(F.split("text", r"\s+")) * len(MASKS)
    total = items.agg(F.sum(size)).first()[0] or 0
    n = -(-total // most_seeds)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n)))
    for i in range(n):
        rows = items.where(part == i).toArrow()
        yield list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def find_overlaps(
    rows: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    found_col: str = "found",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    most_seeds: int = MOST_SEEDS,
) -> DataFrame:
    """The rows with ``found_col``: an array of ``item_id, start, end, item_start, matched`` (places count words)."""
    spark = rows.sparkSession
    found = F.lit(None).cast(_FOUND)
    carried = rows.select(F.struct(*(rows[c] for c in rows.columns)).alias("row"), found.alias("found"))
    schema = carried.schema
    for number, items in enumerate(blocks(benchmark, item_id_col, item_text_col, most_seeds)):
        block = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            seeds, memo = Seeds(block.value), WordHashes()
            for batch in slices(batches, lambda b: b.column(0).field(text_col)):
                own = seeds.search(batch.column(0).field(text_col).to_pylist(), memo)
                before = batch.column(1).to_pylist()
                both = [(a or []) + b for a, b in zip(before, own, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both, _FOUND_ARROW)], names=["row", "found"])

        carried = carried.mapInArrow(search, schema)
        if (number + 1) % _CHAINED == 0:
            carried = written(carried, "decontamination")
    return carried.select(
        *(F.col("row")[c].alias(c) for c in rows.columns),
        F.coalesce("found", F.array().cast(_FOUND)).alias(found_col),
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_seeds: int = MOST_SEEDS
) -> DataFrame:
    """``doc_id, item_id, start, end, item_start, matched``: one row per stretch of a document that an item covers."""
    found = find_overlaps(texts(docs, id_col, text_col), benchmark, most_seeds=most_seeds)
    return found.select("doc_id", F.inline("found"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that overlap no item, with the columns they came with."""
    name = "found"
    while name in docs.columns:
        name += "_"
    return find_overlaps(docs, benchmark, text_col, name).where(F.size(name) == 0).drop(name)
