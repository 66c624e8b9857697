from __future__ import annotations

import hashlib
import re

import pytest

from mailtriage.llm import exact_dedup as x
from mailtriage.llm.queries import op9_exact_dedup

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute_force(rows):
    groups: dict[str, list] = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((doc_id, len(text or ""), i))
    out = []
    for text, own in groups.items():
        keep = min(own, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = [r is keep for r in own]
        # Rows that repeat id and length cannot be told apart: which of them stays is open.
        ties = [r for r in own if r[:2] == keep[:2]]
        out += [(r[0], keep[0], len(own), k if len(ties) == 1 else None, sha) for r, k in zip(own, kept, strict=True)]
    return sorted(out, key=repr)


def result(found, rows):
    want = brute_force(rows)
    got = [tuple(r[c] for c in COLUMNS) for r in found.select(*COLUMNS).collect()]
    assert len({r[4] for r in got}) == sum(r[3] for r in got)  # one row of each group stays
    open_ = {r[4] for r in want if r[3] is None}
    got = sorted(((*r[:3], None if r[4] in open_ else r[3], r[4]) for r in got), key=repr)
    assert got == want


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    found = x.exact_duplicates(awkward)
    result(found, rows)
    assert x.drop_copies(awkward).columns == awkward.columns
    assert x.drop_copies(awkward).count() == len({r[4] for r in brute_force(rows)})


def test_documents(spark, documents):
    result(x.exact_duplicates(documents), [(r.doc_id, r.text) for r in documents.collect()])


def test_ties_and_lengths(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a  b"), (2, "a \tb"), (9, "c"), (8, "c")]
    result(x.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_empty_table(no_rows):
    assert x.exact_duplicates(no_rows).count() == 0
    assert x.drop_copies(no_rows).columns == no_rows.columns


@pytest.mark.parametrize("capacity", [1, 4, 16])
def test_directory_splits_overfull_buckets(spark, capacity):
    rows = spark.range(300).selectExpr("id % 200 as doc_id", "concat('text ', id % 150) as text")
    index = x.build_index(rows)
    directory, depth = x.build_directory(x.count_keys(index), capacity)
    placed = {r["slot"]: (r["bucket"], r["depth"]) for r in directory.collect()}
    keys = [r["key"] & (2**64 - 1) for r in index.select("key").distinct().collect()]
    held: dict = {}
    for key in keys:
        bucket, local = placed[key >> (64 - depth) if depth else 0]
        assert bucket == (key >> (64 - local) if local else 0)
        held[bucket, local] = held.get((bucket, local), 0) + 1
    assert max(held.values()) <= capacity
    result(x.exact_duplicates(rows, capacity=capacity), [(r.doc_id, r.text) for r in rows.collect()])


def test_directory_stays_within_its_bound(spark):
    rows = spark.range(300).selectExpr("id as doc_id", "concat('text ', id % 150) as text")
    keys = x.count_keys(x.build_index(rows))
    directory, depth = x.build_directory(keys, capacity=1, deepest=3)
    assert depth == 3 and directory.count() <= 8
    assert {r.depth for r in directory.collect()} == {3}


def test_a_split_moves_keys_to_other_owners(spark):
    rows = spark.range(400).selectExpr("id as doc_id", "concat('text ', id % 250) as text")
    few, many = (x.exact_duplicates(rows, capacity=c).select("text_sha256", "bucket", "depth") for c in (1000, 16))
    assert {(r.bucket, r.depth) for r in few.collect()} == {(0, 0)}
    owners = {r.text_sha256: (r.bucket, r.depth) for r in many.collect()}
    assert len(set(owners.values())) > 8


def test_hot_keys_are_folded_first_and_others_dealt_by_bucket(spark):
    texts = "case when id % 3 = 0 then 'hot text' when id % 3 = 1 then concat('pair ', id div 6) else concat('one ', id) end"
    rows = spark.range(3000).selectExpr("id as doc_id", f"{texts} as text")
    keys = x.count_keys(x.build_index(rows))
    assert x.hot_keys(keys, 64).count() == 1 and x.hot_keys(keys, 1000).count() == 0
    result(x.exact_duplicates(rows, capacity=64), [(r.doc_id, r.text) for r in rows.collect()])


def test_a_bucket_has_one_owner(spark, monkeypatch):
    plans = {}
    written = x.written

    def record(table, name):
        plans[name] = table._jdf.queryExecution().executedPlan().toString()
        return written(table, name)

    monkeypatch.setattr(x, "written", record)
    rows = spark.range(400).selectExpr("id as doc_id", "concat('text ', id % 250) as text")
    x.exact_duplicates(rows, capacity=16)
    plan = plans["dedup-entries"]
    dealt = [re.sub(r"#\d+L?", "", d) for d in re.findall(r"Exchange hashpartitioning\((.*), \d+\), \w+", plan)]
    # Texts cross once, to their bucket's owner or, already folded, by the text itself.
    assert sorted(dealt) == ["bucket, depth", "bucket, depth, key, sha, bytes"]


def test_query_is_native(spark):
    plan = op9_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
