from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mailtriage.operators import mime
from mailtriage.operators.headers import HEAD_BYTES, header_scan

PLAIN = b"From: a.b@x.org\nTo: Scan Desk <Scan@X.org>\nSubject: hello there\n\nbody"
NAMES = ["From", "to", "SUBJECT", "Content-Type", "X-Other", "Received", "Content-Disposition", "MIME-Version", "B ad", ""]
VALUES = [
    "a@x.org", "Scan@x.org", "Ann Lee <scan@x.org>", "<scan@x.org>", "a@x.org, scan@x.org", "hello there", "=?utf-8?q?x?=",
    "text/plain", 'text/html; charset="utf-8"', "text/plain; charset=utf-8", "text/plain; charset=nonsense", "Text/HTML",
    'multipart/mixed; boundary="b"', "message/rfc822", "application/octet-stream", 'attachment; filename="m.eml"', "", " ",
    "1.0", "x\n folded", "x\r\n\tfolded", "x\n \n y", "café", "two  blanks", "tab\there", "end ", "lone\rreturn", "\x0b",
]


def rows(spark, raws):
    return spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raws)], "msg_id int, content binary")


def scans(spark, raws):
    found = rows(spark, raws).select("msg_id", header_scan(F.col("content")).alias("s")).orderBy("msg_id").collect()
    return [r.s and r.s.asDict() for r in found]


def random_mail(rng):
    end = rng.choice(["\n", "\n", "\r\n"])
    usual = ["From: a@x.org", "To: scan@x.org", "Subject: hello there", "Content-Type: text/plain; charset=utf-8"]
    lines = [line for line in usual if rng.random() < 0.7]
    for _ in range(rng.choice([0, 0, 1, 2])):
        lines.insert(rng.randint(0, len(lines)), f"{rng.choice(NAMES)}:{rng.choice([' ', '', '  '])}{rng.choice(VALUES)}")
    text = end.join(lines) + rng.choice([end * 2, end * 2, end, "\n\r\n"])
    return (text + rng.choice(["body", "", "--b\n\nTo: other@x.org\n\nin\n--b--\n", "From: z@z.org\n\nx"])).encode("latin-1")


def by_parser(raws, **options):
    """What the parser alone says, mail by mail."""
    wanted = frozenset(r.lower() for r in options.get("recipients", ()))
    rules = mime._caching_policy()
    found = [mime._read_mail(r, rules, False, wanted, False) for r in raws]
    return {i: f for i, f in enumerate(found) if f is not None}


def test_plain_headers(spark):
    want = dict(n_headers=3, content_type="text/plain", to_addrs=["scan@x.org"], to="Scan Desk <Scan@X.org>")
    (found,) = scans(spark, [PLAIN])
    assert found == {**want, "from": "a.b@x.org", "subject": "hello there"}


def test_other_headers_are_left_to_the_parser(spark):
    raws = [
        None, b"", b"no headers", b"\n\nbody", b"From: a@x.org\nTo: b@x.org",  # no end of headers
        b"To: a@x.org,\n b@x.org\n\n", b"To: caf\xe9@x.org\n\n", b"X: caf\xe9\n\n", b"Subject: =?utf-8?q?x?=\n\n",
        b"From x\nTo: a@x.org\n\n", b"To: a@x.org\rCc: b@x.org\n\n", b" folded: first\n\n",
        b"To: a@x.org\nX: " + b"y" * HEAD_BYTES + b"\n\n",
    ]
    assert scans(spark, raws) == [None] * len(raws)
    kinds = ['multipart/mixed; boundary="b"', "message/rfc822", "text/plain; charset=koi8-r", 'text/plain; name="a.eml"']
    found = scans(spark, [f"To: a@x.org\nContent-Type: {k}\n\n".encode() for k in kinds])
    assert [(s["to_addrs"], s["content_type"]) for s in found] == [(["a@x.org"], None)] * len(kinds)


def test_long_headers_use_no_stack(spark):
    dots = b"a." * 30_000 + b"a@x.org"
    many = b"X: y\n" * 12_000
    found = scans(spark, [b"To: " + dots + b"\n\n", b"Subject:" + b" a" * 30_000 + b"\n\n", many + b"\n", b"To: " + b"A " * 30_000 + b"\n\n"])
    assert found[0]["to_addrs"] == [dots.decode()] and found[1]["subject"].startswith("a a")
    assert found[2]["n_headers"] == 12_000 and found[3] is None


@pytest.mark.parametrize("recipients", [(), ("Scan@x.org",)])
def test_same_rows_as_the_parser(spark, recipients):
    rng = random.Random(5)
    raws = [random_mail(rng) for _ in range(3000)]
    known = [s for s in scans(spark, raws) if s]
    assert len(known) > 800 and sum(s["content_type"] is not None for s in known) > 500
    want = by_parser(raws, recipients=recipients)
    got = {r.msg_id: r for r in mime.parse_mail(rows(spark, raws), recipients=recipients, with_texts=False).collect()}
    assert got.keys() == want.keys()
    for i, (parts, to_addrs, _, error) in want.items():
        assert (got[i].to_addrs, got[i].error) == (to_addrs, error), raws[i]
        found = got[i].parts and [p.asDict() for p in got[i].parts]
        names = [f.name for f in mime.PART.fields]
        assert found == (parts and [{n: p.get(n) for n in names} for p in parts]), raws[i]
    full = {r.msg_id for r in mime.parse_mail(rows(spark, raws), recipients=recipients).select("msg_id").collect()}
    assert full == want.keys()


def test_plain_mail_sends_no_content_to_python(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("content was sent")

    monkeypatch.setattr(mime, "_read_mail", refuse)
    plain = rows(spark, [PLAIN, b"To: other@x.org\n\n"])
    found = mime.parse_mail(plain, with_texts=False).orderBy("msg_id").collect()
    assert [(r.to_addrs, r.error, len(r.parts)) for r in found] == [(["scan@x.org"], None, 1), (["other@x.org"], None, 1)]
    assert mime.parse_mail(plain, recipients=["none@x.org"]).count() == 0
    divided = rows(spark, [PLAIN.replace(b"\n\n", b"\nContent-Type: message/rfc822\n\n")])
    with pytest.raises(Exception, match="content was sent"):
        mime.parse_mail(divided, with_texts=False).collect()


def test_scan_is_evaluated_once(spark):
    parsed = mime.parse_mail(rows(spark, [PLAIN]), recipients=["scan@x.org"], with_texts=False)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ISO-8859-1") == 1
