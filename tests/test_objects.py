from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mailtriage.operators import objects as o
from mailtriage.sources.mail import listing, scan_mail
from mailtriage.sources.notifications import build_notifications, notification, parse_notifications
from mailtriage.sources.workspace import clear_workspace, shared_folder, workspace
from workload import samples


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(f"in/{i:03d}", i * 600, dt.datetime(2024, 1, 1, (i * 7) % 24, i % 60)) for i in range(50)]
    return spark.createDataFrame(rows + [("out/1", 5, dt.datetime(2020, 1, 1))], "key string, size long, last_modified timestamp")


def test_listing_cuts_in_key_order_and_numbers_by_age(stored):
    got = o.list_objects(stored, "in/", 3, "full", "box").orderBy("number").collect()
    assert [(r.number, r.key) for r in got] == [(1, "in/000"), (2, "in/001"), (3, "in/002")]
    assert got[2].asDict() == {
        "number": 3, "key": "in/002", "size": 1200, "size_label": "1.17 KB",
        "last_modified": "2024-01-01 14:02:00", "path": "s3://box/in/002",
    }
    got = o.list_objects(stored, "in/", 10).orderBy("number").collect()
    want = sorted(range(10), key=lambda i: ((i * 7) % 24, i % 60))
    assert [r.key for r in got] == [f"in/{i:03d}" for i in want]
    assert o.list_objects(stored).count() == 51
    assert o.list_objects(stored).orderBy("number").first().key == "out/1"
    with pytest.raises(ValueError):
        o.list_objects(stored, detail="some")


@pytest.mark.parametrize(
    ("prefix", "limit", "expected"),
    [("in/", 10, (10, False, True)), ("in/", 50, (50, False, False)), ("none/", 10, (0, True, False)), ("", 100, (51, False, False))],
)
def test_listing_summary(stored, prefix, limit, expected):
    assert tuple(o.listing_summary(stored, prefix, limit).first()) == expected


def test_existence(spark, stored):
    asked = spark.createDataFrame([("in/001", 1), ("in/001", 2), ("x", 3)], "key string, n int")
    assert sorted(r.n for r in o.present_objects(asked, stored).collect()) == [1, 2]
    assert [r.n for r in o.missing_objects(asked, stored).collect()] == [3]
    assert [r.key for r in o.requested_objects(stored, asked).collect()] == ["in/001"]


def test_intake(spark):
    mail = spark.createDataFrame([(1, ["a@x.org", "b@x.org"]), (2, ["c@x.org"]), (3, [])], "i int, to_addrs array<string>")
    mail = mail.union(spark.createDataFrame([(4, None)], mail.schema))
    assert [r.i for r in o.intake(mail, ["B@x.org", "z@x.org"]).collect()] == [1, 4]
    assert o.intake(mail, []).count() == 4


def test_notifications(spark, stored):
    built = build_notifications(stored.where("key = 'in/001'"), "box").first()
    record = json.loads(built.event)["Records"][0]
    assert record == {
        "eventVersion": "2.1",
        "eventSource": "aws:s3",
        "awsRegion": "us-east-1",
        "eventTime": "2023-01-01T00:00:00.000Z",
        "eventName": "ObjectCreated:Put",
        "userIdentity": {"principalId": "MANUAL_TRIGGER"},
        "requestParameters": {"sourceIPAddress": "127.0.0.1"},
        "responseElements": {"x-amz-request-id": "manual-request", "x-amz-id-2": "manual-trigger"},
        "s3": {
            "s3SchemaVersion": "1.0",
            "configurationId": "manual-trigger-event",
            "bucket": {"name": "box", "ownerIdentity": {"principalId": "MANUAL_TRIGGER"}, "arn": "arn:aws:s3:::box"},
            "object": {"key": "in/001", "size": 0, "eTag": "manual-trigger", "versionId": None, "sequencer": "manual-trigger"},
        },
    }
    two = json.dumps({"Records": [json.loads(built.event)["Records"][0], {"s3": {"bucket": {"name": "b2"}, "object": {"key": "k2"}}}]})
    events = spark.createDataFrame([(0, built.event), (1, two), (2, '{"Records": []}'), (3, "junk"), (4, None)], "i int, event string")
    got = {r.i: (r.bucket, r.key, r.error is None) for r in parse_notifications(events).collect()}
    assert got == {0: ("box", "in/001", True), 1: ("box", "in/001", True), **{i: (None, None, False) for i in (2, 3, 4)}}
    every = parse_notifications(events, all_records=True).where("i = 1").collect()
    assert [(r.bucket, r.key) for r in every] == [("box", "in/001"), ("b2", "k2")]
    encoded = spark.range(1).select(notification(F.lit("b"), F.lit("a%20b+c")).alias("event"))
    assert parse_notifications(encoded).first().key == "a%20b+c"


def test_listing_never_opens_a_mail(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.eml").write_bytes(b"Subject: x\n\ny")
    (tmp_path / "b.eml").write_bytes(b"Subject: z\n\n")
    (tmp_path / "c.txt").write_bytes(b"no mail")
    mail = scan_mail(spark, str(tmp_path), glob="*.eml", root=str(tmp_path))
    assert {r.msg_id: bytes(r.content) for r in mail.collect()} == {"sub/a.eml": b"Subject: x\n\ny", "b.eml": b"Subject: z\n\n"}
    objects = listing(mail)
    plan = objects._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert {r.key: r.size for r in objects.collect()} == {"sub/a.eml": 13, "b.eml": 12}


def test_workspace_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    one, two = workspace(spark, "x"), workspace(spark, "x")
    assert one != two
    assert shared is None or one.startswith(shared)


def test_the_workspace_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mailtriage.sources.workspace.shared_folder", lambda spark: str(tmp_path))
    (tmp_path / "other").mkdir()
    spark.range(3).write.parquet(workspace(spark, "x"))
    assert len(list(tmp_path.iterdir())) == 2
    clear_workspace(spark)
    assert [x.name for x in tmp_path.iterdir()] == ["other"]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf({"spark.master": master})

    with pytest.raises(ValueError):
        shared_folder(Session("yarn"))
    with pytest.raises(ValueError):
        shared_folder(Session("local-cluster[2,1,512]"))
    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_only_the_root_at_the_front_is_cut_off(spark, tmp_path, scheme):
    root = tmp_path / "mail"
    for year in ("2024", "2025"):
        (root / year / "mail").mkdir(parents=True)
        (root / year / "mail" / "a.eml").write_bytes(year.encode())
    mail = scan_mail(spark, str(root), root=f"{scheme}{root}/")
    assert {r.msg_id for r in mail.collect()} == {"2024/mail/a.eml", "2025/mail/a.eml"}
    inner = scan_mail(spark, str(root), root=f"{scheme}{root}/2024")
    ids = {r.msg_id for r in inner.collect()}
    assert "mail/a.eml" in ids and any(i.endswith("/mail/2025/mail/a.eml") for i in ids)
    assert {r.msg_id for r in scan_mail(spark, str(root), root="/mail").collect()} == {f"file:{root}/{y}/mail/a.eml" for y in ("2024", "2025")}


def test_scans_are_spread_only_on_request(spark):
    def plan():
        return samples.documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan()
    spark.conf.set(samples.TASKS, "3")
    try:
        assert "RoundRobinPartitioning(3)" in plan()
    finally:
        spark.conf.unset(samples.TASKS)
