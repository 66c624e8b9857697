from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mailtriage import TriageConfig
from mailtriage.operators import report as rp

CFG = TriageConfig(catch_all="all@example.com", domain="d.org", ticket_token="t", ticket_owner="o", ticket_repo="r")


def now():
    return F.lit(dt.datetime(2024, 3, 5, 6, 7, 8))


SCHEMA = (
    "msg_id int, reply_to string, reply_subject string, is_phishing boolean, label string, analysis string,"
    " ticket_text string, error string"
)


@pytest.fixture(scope="module")
def triaged(spark):
    return spark.createDataFrame(
        [
            (1, "a@x.org", "[PHISHING Detected] s", True, "PHISHING", "<b>why</b>", None, None),
            (2, "all@example.com", "[CLEAN] s a@b.co", False, "", "ok", "\nFrom: [EMAIL]\n", None),
            (3, None, None, None, None, None, None, 'bad "x"'),
            (4, "All <all@example.com>", "[CLEAN] s", False, "CLEAN", "ok", None, None),
        ],
        SCHEMA,
    )


def test_outbox(triaged):
    rows = {r.msg_id: r for r in rp.build_outbox(triaged, CFG).collect()}
    assert sorted(rows) == [1, 2, 4]
    assert (rows[1].sender, rows[1].recipient, rows[1].config_set) == ("noreply@d.org", "a@x.org", "AWS-SES-Send-Email")
    assert "<b>why</b>" in rows[1].body_html and "#c62828" in rows[1].body_html
    assert rows[1].body_text == (
        "Warning: this message is phishing\n\nWhat we found\n\nwhy\n\nAn automated review produced this report.\n\n"
        "Please ask your IT help desk if anything is unclear."
    )
    assert "#2e7d32" in rows[2].body_html and "{" + "analysis}" not in rows[2].body_html


def test_text_only_outbox(triaged):
    row = rp.build_outbox(triaged, CFG, is_html=False).where("msg_id = 1").first()
    assert row.body_html is None and row.body_text.startswith("<html>")


def test_tickets(triaged):
    rows = rp.build_tickets(triaged, CFG, now()).collect()
    assert [r.msg_id for r in rows] == [2]
    assert rows[0].title == "[CLEAN] [CLEAN] s a@b.co"
    assert rows[0].labels == ["phishing-email", "catch-all"]
    for part in ("Classification: CLEAN", "2024-03-05 06:07:08", "```\n\nFrom: [EMAIL]\n\n```"):
        assert part in rows[0].body


@pytest.mark.parametrize("name", ["ticket_token", "ticket_owner", "ticket_repo"])
def test_no_tickets_unless_fully_configured(triaged, name):
    settings = {"ticket_token": "t", "ticket_owner": "o", "ticket_repo": "r", name: ""}
    assert rp.build_tickets(triaged, TriageConfig(catch_all="all@example.com", **settings), now()).count() == 0


def test_status(triaged):
    rows = {r.msg_id: r for r in rp.build_status(triaged).collect()}
    assert (rows[1].status, json.loads(rows[1].status_body)) == (200, "Email processed successfully")
    assert (rows[3].status, json.loads(rows[3].status_body)) == (500, 'Error processing email: bad "x"')


def test_sender_address(spark):
    rows = spark.createDataFrame([("s", "d"), ("", "d"), (None, "d"), ("", ""), (None, None)], "s string, d string")
    got = [r[0] for r in rows.select(rp.sender_address(F.col("s"), F.col("d"))).collect()]
    assert got == ["s", "noreply@d", "noreply@d", "noreply@example.com", "noreply@example.com"]


def test_config():
    with pytest.raises(ValueError):
        TriageConfig(catch_all="")
    with pytest.raises(ValueError):
        TriageConfig.from_mapping({"domain": "x"})
    cfg = TriageConfig.from_mapping({"catch_all": "c", "sender": "s", "other": 1, "domain": None})
    assert (cfg.catch_all, cfg.reply_sender, cfg.tickets_enabled) == ("c", "s", False)
    assert TriageConfig(catch_all="c").reply_sender == "noreply@example.com"
    assert "secret" not in repr(TriageConfig(catch_all="c", ticket_token="secret"))
