from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from mailtriage.llm import sharding as s


def test_table_is_even():
    counts = Counter(s.fill_table(s.SHARDS))
    assert set(counts) == set(range(len(s.SHARDS)))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_table_by_preference_lists():
    """The same fill from written-out preference lists."""
    import zlib

    names, size = ["c", "a", "d", "b"], 31
    prefer = {}
    for n in names:
        start, step = zlib.crc32(b"start:" + n.encode()) % size, zlib.crc32(b"step:" + n.encode()) % (size - 1) + 1
        prefer[n] = [(start + i * step) % size for i in range(size)]
        assert sorted(prefer[n]) == list(range(size))
    owner: dict[int, str] = {}
    while len(owner) < size:
        for n in sorted(names):
            if len(owner) < size:
                owner[next(x for x in prefer[n] if x not in owner)] = n
    assert [names[i] for i in s.fill_table(names, size)] == [owner[i] for i in range(size)]


def test_a_shard_that_goes_moves_little():
    before = [s.SHARDS[i] for i in s.fill_table(s.SHARDS)]
    left = [x for x in s.SHARDS if x != "shard-017"]
    after = [left[i] for i in s.fill_table(left)]
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != "shard-017")
    assert moved < 0.1 * len(before)


@pytest.mark.parametrize("names, size", [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(names, size):
    with pytest.raises(ValueError):
        s.fill_table(names, size)


def test_rows(awkward):
    table = s.fill_table(s.SHARDS)
    found = s.place(awkward, "doc_id")
    assert set(found.columns) == set(awkward.columns) | {"shard"}
    rows = found.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % s.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, s.SHARDS[table[slot]])
    assert not re.search("Python|Arrow|Pandas|Exchange hash", found._jdf.queryExecution().toString())


def test_empty_table(no_rows):
    assert s.place(no_rows, "doc_id").count() == 0


def test_files(spark, tmp_path, documents):
    placed = s.place(documents.select("doc_id"), "doc_id", [f"s{i}" for i in range(4)], 101)
    s.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "shard").collect())) == sorted(
        map(tuple, placed.select("doc_id", "shard").collect())
    )
