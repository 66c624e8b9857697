"""The listing data source, balanced work units, and objects opened by path."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith
from test_jobs import CFG, answer_of, big_tables, mail_of  # noqa: F401

from mailtriage.operators.objects import (
    list_objects,
    listing_summary,
    missing_objects,
    present_objects,
    store_listing,
    work_units,
)
from mailtriage.operators.report import build_status
from mailtriage.plans.triage import replay_outcomes
from mailtriage.sources import mail
from mailtriage.sources.listing import ObjectListing, ObjectReader, list_store


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    for key in ("top", "inbox/a/1", "inbox/a/2", "inbox/ab/1", "inbox/b/x/1", "inbox/b/y z/1%20", "sent/a/1", "inbox/direct"):
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_text(key)
    (root / "empty").mkdir()
    return root


def keys(store):
    return sorted(str(p.relative_to(store)) for p in store.rglob("*") if p.is_file())


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_every_object_once(spark, store, scheme):
    rows = list_store(spark, f"{scheme}{store}").collect()
    assert sorted(r.key for r in rows) == keys(store)
    assert all(r.size == len(r.key) and r.path == f"{scheme}{store}/{r.key}" and r.last_modified.year > 2000 for r in rows)
    assert list_store(spark, f"{store}/empty").count() == 0
    assert list_store(spark, f"{store}/nowhere").count() == 0


@pytest.mark.parametrize("begin", ["", "inbox/", "inbox/a", "inbox/a/", "inbox/b/y z/1%", "sent/a/1", "to", "none/x", "inbox/d"])
def test_prefixes(spark, store, begin):
    listed = list_store(spark, str(store))
    want = [k for k in keys(store) if k.startswith(begin)]
    assert sorted(r.key for r in listed.where(F.startswith("key", F.lit(begin))).collect()) == want
    assert listed.where(F.col("key") == begin).count() == (begin in keys(store))
    assert listing_summary(listed, begin, 3).first().returned == min(3, len(want))
    assert [r.key for r in list_objects(listed, begin, 3).orderBy("key").collect()] == want[:3]


def read(reader):
    """What each task lists, and the keys."""
    listed, entries = [], reader._entries
    reader._entries = lambda folder: listed.append(folder) or entries(folder)
    parts = list(reader.partitions())
    found = sorted(k for part in parts for batch in reader.read(part) for k in batch.column("key").to_pylist())
    return parts, listed, found


def reader_of(store, *filters, **options):
    reader = ObjectListing({"root": str(store), **options}).reader(None)
    return reader, list(reader.pushFilters(list(filters)))


def test_a_pushed_prefix_lists_one_folder(store):
    reader, left = reader_of(store, StringStartsWith(("key",), "inbox/b/x/"))
    parts, listed, found = read(reader)
    assert left == [] and found == ["inbox/b/x/1"]
    assert set(listed) == {"inbox/b/x"} and len(parts) == 1


def test_one_task_a_prefix(store):
    parts, _, found = read(reader_of(store, StringStartsWith(("key",), "inbox/"))[0])
    assert [p.name for p in parts] == ["inbox", "inbox/a", "inbox/ab", "inbox/b"]
    assert found == [k for k in keys(store) if k.startswith("inbox/")]
    parts, listed, found = read(reader_of(store, StringStartsWith(("key",), "inbox/a/"), prefixes="inbox/a\nsent/")[0])
    assert [p.name for p in parts] == ["inbox/a"] and listed == ["inbox/a"] and found == ["inbox/a/1", "inbox/a/2"]


def test_conditions_that_stay_with_spark(store):
    equal, other = EqualTo(("key",), "inbox/a/1"), EqualTo(("size",), 3)
    reader, left = reader_of(store, StringStartsWith(("key",), "inb"), equal, other, StringStartsWith(("key",), "inbox/b"))
    assert left[:2] == [equal, other] and len(left) == 3 and reader.begin == "inbox/a/1"
    assert isinstance(reader, ObjectReader)


def test_units_are_balanced(spark):
    rng = random.Random(2)
    sizes = [(f"k{i:05d}", rng.randrange(20_000)) for i in range(3000)]
    sizes[700] = (sizes[700][0], 40 << 20)
    sizes[5] = (sizes[5][0], None)
    listing = spark.createDataFrame(sizes, "key string, size long").repartition(7)
    most = 1 << 20
    got = {r.key: (r.size, r.unit) for r in work_units(listing, most).collect()}
    before, units = 0, {}
    for key, size in sizes:
        assert got[key] == (size, before // most)
        units.setdefault(before // most, []).append(size or 0)
        before += size or 0
    large = next(u for u in units.values() if 40 << 20 in u)
    assert large[-1] == 40 << 20  # nothing follows it in its unit
    assert all(sum(u[:-1]) < most for u in units.values())
    assert work_units(listing.where("false"), most).count() == 0


def test_a_stored_listing_is_not_shuffled(spark, big_tables):
    listing = spark.range(5000).selectExpr("concat('k', id) as key", "id as size")
    asked = spark.range(0, 9000, 3).selectExpr("concat('k', id) as key")
    stored = store_listing(listing, "kept_listing", 16)
    for join, kind in ((missing_objects, "LeftAnti"), (present_objects, "LeftSemi")):
        found = join(asked, stored)
        assert found.count() == join(asked, listing).count()
        plan = found._jdf.queryExecution().executedPlan().toString()
        listed = plan.split(kind)[1].split("kept_listing")[0].splitlines()
        before = next(i for i in range(len(listed) - 1, -1, -1) if "Range" in listed[i] or "FileScan" not in listed[i] and "Exchange" in listed[i])
        assert plan.count("Exchange hashpartitioning") == 1 and "FileScan" not in listed[before]
        assert "Exchange" not in "".join(listed[before + 1 :])
    spark.sql("drop table kept_listing")


def test_contents_go_on_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mail, "BATCH_BYTES", 1000)
    for i in range(30):
        (tmp_path / str(i)).write_bytes(b"x" * (5000 if i == 3 else 300))
    wanted = spark.createDataFrame([(i, f"{tmp_path}/{i}") for i in range(31)], "msg_id long, path string").coalesce(1)
    found = mail.read_objects(wanted, in_flight=4)
    rows = found.mapInArrow(lambda batches: batches, found.schema).collect()
    assert [(r.msg_id, len(r.content or b"")) for r in rows] == [(i, 5000 if i == 3 else 300 * (i < 30)) for i in range(31)]
    pulled = []
    paths = [str(tmp_path / str(i)) for i in range(30)]
    monkeypatch.setattr(mail, "_read_object", lambda path: pulled.append(path) or (b"", None))
    with mail.ThreadPoolExecutor(4) as pool:
        taken = mail._in_order(pool, paths, 4)
        next(taken)
        assert len(pulled) <= 4


def test_every_request_has_an_outcome(spark, tmp_path):
    for i in (1, 4):
        (tmp_path / f"m{i}.eml").write_text(mail_of(i))
    responses = spark.createDataFrame([("m1.eml", answer_of(1), None)], "msg_id string, body string, error_code string")
    listing = list_store(spark, str(tmp_path)).select(F.col("key").alias("msg_id"), "path")
    asked = spark.createDataFrame([("m1.eml",), ("gone",), ("m4.eml",), ("gone",), ("m1.eml",)], "msg_id string")
    (tmp_path / "m1.eml").touch()
    found = {r.msg_id: (r.status, r.error) for r in build_status(replay_outcomes(listing, asked, CFG, responses)).collect()}
    assert found["m1.eml"] == (200, None) and found["m4.eml"][0] == 500
    assert found["gone"] == (500, "no such object: gone") and len(found) == 3
    with pytest.raises(ValueError):
        replay_outcomes(listing.withColumn("content", F.lit(b"")), asked, CFG, responses)
