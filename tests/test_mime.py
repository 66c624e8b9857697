from __future__ import annotations

import base64
import random
from email import message_from_bytes, policy

import pytest
from pyspark.sql import functions as F

from mailtriage.operators import mime
from mailtriage.operators.mime import _PLAIN_HEADERS, _caching_policy, explode_parts, parse_mail
from mailtriage.operators.selection import assemble_mail, select_original, text_dump

CATCH_ALL = "all@example.com"
NO_HEADERS = ("N/A", "N/A", "No Subject Detected")


def head(name, kind="text/plain", extra=""):
    return f"From: {name}@x.org\nTo: to-{name}@x.org\nSubject: about {name}\nContent-Type: {kind}\n{extra}\n"


def multi(mark, *parts, name="outer", kind="mixed"):
    body = "".join(f"--{mark}\n{part}\n" for part in parts)
    return head(name, f'multipart/{kind}; boundary="{mark}"') + body + f"--{mark}--\n"


def eml(name, content, file="m.eml"):
    data = base64.encodebytes(content.encode()).decode()
    return (
        "Content-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n"
        f'Content-Disposition: attachment; filename="{file}"\n\n{data}'
    )


NOTE = "Content-Type: text/plain\n\nnote"
INNER = head("inner") + "inner body"


def assemble(spark, raws, **options):
    raws = [r.encode() if isinstance(r, str) else r for r in raws]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "msg_id int, content binary")
    mail = assemble_mail(parse_mail(rows.repartition(4), **options), CATCH_ALL)
    return [r for r in mail.orderBy("msg_id").collect()]


def one(spark, raw):
    return assemble(spark, [raw])[0]


def test_forward_as_message(spark):
    row = one(spark, multi("b", NOTE, "Content-Type: message/rfc822\n\n" + INNER))
    assert row.asDict() == {
        "msg_id": 0,
        "reply_to": "outer@x.org",
        "from": "inner@x.org",
        "to": "to-inner@x.org",
        "subject": "about inner",
        "body": "inner body",
        "envelope": "\nFrom: inner@x.org\nTo: to-inner@x.org\nSubject: about inner\n\ninner body\n",
        "error": None,
    }


def test_last_embedded_message_wins(spark):
    nested = multi("n", "Content-Type: message/rfc822\n\n" + INNER, name="middle")
    raw = multi("b", "Content-Type: message/rfc822\n\n" + head("first") + "1", eml("x", nested))
    assert one(spark, raw).subject == "about inner"
    raw = multi("b", eml("x", nested), "Content-Type: message/rfc822\n\n" + head("second") + "2")
    assert (one(spark, raw).subject, one(spark, raw).body) == ("about second", "2")


def test_embedded_message_without_headers_is_ignored(spark):
    row = one(spark, multi("b", NOTE, "Content-Type: message/rfc822\n\n\nbody only"))
    assert (row.subject, row.body) == ("about outer", "note")
    encoded = "Content-Type: message/rfc822\nContent-Transfer-Encoding: base64\n\n"
    encoded += base64.b64encode(INNER.encode()).decode()
    row = one(spark, multi("b", NOTE, encoded))
    assert (row.subject, row.body) == ("about outer", "note")


def test_header_less_last_message_does_not_fall_back_to_the_one_before(spark):
    raw = multi("b", NOTE, "Content-Type: message/rfc822\n\n" + INNER, "Content-Type: message/rfc822\n\n\nx")
    assert one(spark, raw).subject == "about outer"


def test_body_part_without_headers_means_all_plain_parts(spark):
    row = one(spark, multi("b", "\nplain without headers", "Content-Type: text/html\n\n<p>h</p>"))
    assert row.body == "plain without headers"


def test_attachments_only_are_concatenated(spark):
    part = "Content-Type: text/plain\nContent-Disposition: attachment\n\n"
    assert one(spark, multi("b", part + "AAA", part + "BBB")).body == "AAABBB"


def test_outer_body_takes_in_plain_parts_of_header_less_forwards(spark):
    attached = "Content-Type: text/plain\nContent-Disposition: attachment\n\nAAA"
    raw = multi("b", attached, eml("x", "\nIN EML"), "Content-Type: message/rfc822\n\n\nINSIDE")
    assert one(spark, raw).body == "AAAINSIDE"


def test_html_is_used_without_plain(spark):
    raw = multi("b", 'Content-Type: text/html; charset="iso-8859-1"\n\n<p>x</p>', kind="alternative")
    assert one(spark, raw).body == "<p>x</p>"


def test_declared_charset_counts_in_multipart_only(spark):
    part = b'Content-Type: text/plain; charset="iso-8859-1"\nContent-Transfer-Encoding: 8bit\n\nca\xe9'
    raw = head("outer", 'multipart/mixed; boundary="b"').encode() + b"--b\n" + part + b"\n--b--\n"
    assert one(spark, raw).body == "caé"
    assert one(spark, part).body == "ca�"


def test_unknown_charset_fails_the_mail_only_where_it_is_used(spark):
    bogus = "Content-Type: text/plain; charset=bogus-1\n\nx"
    row = one(spark, multi("b", bogus))
    assert row.error == "unknown encoding: bogus-1"
    assert row.reply_to is None and row.envelope is None
    assert one(spark, bogus).body == "x"
    assert one(spark, multi("b", NOTE, bogus)).body == "note"


def test_file_name_of_embedded_mail_is_case_sensitive(spark):
    assert one(spark, multi("b", NOTE, eml("x", INNER, "a.EML"))).subject == "about outer"
    assert one(spark, multi("b", NOTE, eml("x", INNER, "a.eml"))).subject == "about inner"


@pytest.mark.parametrize("raw", ["", "From:\nTo:\nSubject:\n\n"])
def test_defaults(spark, raw):
    row = one(spark, raw)
    assert row.reply_to == CATCH_ALL
    assert (row["from"], row.to, row.subject) == NO_HEADERS
    assert row.body == "" and row.error is None


def test_no_header_is_borrowed_from_the_outer_mail(spark):
    row = one(spark, multi("b", "Content-Type: message/rfc822\n\nSubject: only\n\nx"))
    assert (row.reply_to, row["from"], row.to, row.subject) == ("outer@x.org", "N/A", "N/A", "only")


def test_display_name_is_kept_and_encoded_headers_are_read(spark):
    raw = "From: =?utf-8?q?J=C3=BC?= <j@x.org>\nSubject: =?utf-8?b?w6TDtg==?=\n folded\n\nx"
    row = one(spark, raw)
    assert (row.reply_to, row.subject) == ("Jü <j@x.org>", "äö folded")


def test_undecodable_surrogates_do_not_stop_the_job(spark):
    raw = multi("b", "Content-Type: text/plain; charset=utf-7\n\nx+2AA-y")
    row = one(spark, raw)
    assert row.error is None and row.body.startswith("x") and row.body.endswith("y")


def test_null_content_is_an_error_of_that_mail(spark):
    rows = spark.createDataFrame([(0, None), (1, bytearray(b"Subject: s\n\nx"))], "msg_id int, content binary")
    got = {r.msg_id: r for r in assemble_mail(parse_mail(rows), CATCH_ALL).collect()}
    assert got[0].error and got[1].subject == "s"
    kept = explode_parts(parse_mail(rows)).orderBy("msg_id").collect()
    assert [r.msg_id for r in kept] == [0, 1] and kept[0].content_type is None


def test_recipients_of_the_outer_mail(spark):
    raw = 'To: "A" <A@X.org>, b@y.org\nTo: c@z.org\n\n'
    rows = spark.createDataFrame([(0, bytearray(raw.encode()))], "msg_id int, content binary")
    assert parse_mail(rows).first().to_addrs == ["a@x.org", "b@y.org", "c@z.org"]


def test_dump(spark):
    forward = "Content-Type: message/rfc822\n\n" + INNER
    raws = [multi("b", NOTE, "Content-Type: text/html\n\n<b>", forward, eml("x", head("e") + "E")), INNER]
    rows = spark.createDataFrame([(i, bytearray(r.encode())) for i, r in enumerate(raws)], "msg_id int, content binary")
    parsed = parse_mail(rows, with_source=True)
    assert [r.dump for r in text_dump(parsed).orderBy("msg_id").collect()] == [
        "note\n<b>\n" + INNER + "\ninner body",
        "inner body",
    ]
    raw = text_dump(parsed, raw=True).orderBy("msg_id").collect()
    assert [r.dump for r in raw] == [str(message_from_bytes(r.encode(), policy=policy.default)) for r in raws]


def test_one_mail_is_one_row_without_shuffle(spark):
    rows = spark.createDataFrame([(0, bytearray(INNER.encode()))], "msg_id int, content binary")
    plan = assemble_mail(parse_mail(rows), CATCH_ALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def random_tree(rng, depth=0):
    name = rng.choice("abcdef") + str(depth)
    pick = rng.random()
    texts = ["plain", "plain; charset=utf-8", "plain; charset=iso-8859-1", "html", "plain; charset=bogus-1"]
    if depth > 3 or pick < 0.45:
        bare = rng.random() < 0.15
        kind = "text/" + rng.choice(texts)
        attached = rng.choice(["", "Content-Disposition: attachment\n", ""])
        top = "" if bare else f"Content-Type: {kind}\n{attached}"
        return f"{top}\ntext {name} é {rng.random()}"
    if pick < 0.7:
        mark = f"m{depth}{rng.randrange(10**6)}"
        kind = rng.choice(["mixed", "alternative", "related", "digest"])
        parts = [random_tree(rng, depth + 1) for _ in range(rng.randrange(0, 4))]
        body = "".join(f"--{mark}\n{part}\n" for part in parts)
        return f'Content-Type: multipart/{kind}; boundary="{mark}"\n\n{body}--{mark}--\n'
    if pick < 0.85:
        coding = rng.choice(["", "", "Content-Transfer-Encoding: base64\n"])
        return f"Content-Type: message/rfc822\n{coding}\n{random_mail(rng, depth + 1)}"
    if pick < 0.95:
        return eml(name, random_mail(rng, depth + 1), rng.choice(["a.eml", "a.eml", "a.EML", "b.txt"]))
    return f"Content-Type: message/delivery-status\n\nReporting-MTA: dns; {name}\n\nStatus: 5.0.0\n"


def random_mail(rng, depth=0):
    lines = [f"{h}: {h.lower()}{rng.randrange(99)}@x.org\n" for h in ("From", "To", "Subject") if rng.random() < 0.8]
    tree = random_tree(rng, depth)
    if rng.random() < 0.1:
        return "\n" + tree
    return "".join(lines) + tree


def embedded(message):
    """Embedded messages of a parsed mail in visit order."""
    kind = message.get_content_type()
    if kind == "message/rfc822":
        inside = [message.get_payload(0)]
    elif message.is_multipart():
        for child in message.get_payload():
            yield from embedded(child)
        return
    elif kind == "application/octet-stream" and (message.get_filename() or "").endswith(".eml"):
        inside = [message_from_bytes(message.get_payload(decode=True), policy=policy.default)]
    else:
        return
    for found in inside:
        yield found
        yield from embedded(found)


def plain_assemble(raw):
    """The rules once more, on the parser's objects: (reply_to, from, to, subject, body) or an error."""
    outer = message_from_bytes(raw, policy=policy.default)
    candidates = list(embedded(outer))
    chosen = candidates[-1] if candidates and len(candidates[-1]) else outer
    try:
        if not chosen.is_multipart():
            body = chosen.get_payload(decode=True).decode(errors="replace")
        else:
            preferred = chosen.get_body(preferencelist=("plain", "html"))
            if preferred is not None and len(preferred):
                body = preferred.get_content()
            else:
                plain = (p for p in chosen.walk() if p.get_content_type() == "text/plain")
                body = "".join(p.get_content() for p in plain)
    except Exception as problem:
        return str(problem)
    values = (chosen[h] or d for h, d in zip(("From", "To", "Subject"), NO_HEADERS, strict=True))
    return (outer["From"] or CATCH_ALL, *map(str, values), body)


def test_random_trees(spark):
    rng = random.Random(11)
    raws = [random_mail(rng).encode(rng.choice(["utf-8", "latin-1"])) for _ in range(3000)]
    expected = [plain_assemble(r) for r in raws]
    assert sum(isinstance(e, str) for e in expected) > 50
    assert sum(bool(list(embedded(message_from_bytes(r, policy=policy.default)))) for r in raws) > 800
    for raw, want, row in zip(raws, expected, assemble(spark, raws), strict=True):
        got = row.error if row.error is not None else (row.reply_to, row["from"], row.to, row.subject, row.body)
        assert got == want, raw


def random_header(rng, name):
    if name == "content-type":
        mark = "".join(rng.choice("aZ09'()+_,./:=-\" ") for _ in range(rng.randrange(1, 9)))
        return f'multipart/{rng.choice(["mixed", "alternative", "x-y"])};{rng.choice(["", " ", chr(10) + chr(9)])}boundary="{mark}"'
    if name == "subject":
        atoms = ["a", "Re:", "[x]", " ", "  ", "=?utf-8?q?x?=", "(", '"', "\\", "<a@b>", ",", "\t", "é"]
        return "".join(rng.choice(atoms) for _ in range(rng.randrange(0, 9)))
    local, domain = (".".join(rng.choice(["a", "b-c", "_", "", "x+1", "9"]) for _ in range(rng.randrange(1, 4))) for _ in "ld")
    form = rng.choice(["{}@{}", "Al Bo <{}@{}>", "A <{}@{}>", "<{}@{}>", '"A" <{}@{}>', "A  B <{}@{}>", "{}@{}, c@d"])
    return form.format(local, domain)


def test_plain_headers_read_as_parsed_ones(spark):
    rng, rules = random.Random(2), _caching_policy()
    plain = dict.fromkeys(_PLAIN_HEADERS, 0)
    for name in [*_PLAIN_HEADERS] * 5000:
        value = random_header(rng, name)
        plain[name] += bool(_PLAIN_HEADERS[name].fullmatch(value))
        raw = f"{name}: {value}\n\nx".encode()
        got, want = (message_from_bytes(raw, policy=p) for p in (rules, policy.default))
        if name == "content-type":
            for message in (got, want):
                message.seen = (message.get_content_type(), message.get_boundary(), message.is_multipart())
            assert got.seen == want.seen, raw
        else:
            assert str(got[name]) == str(want[name]), raw
    assert min(plain.values()) > 400


def test_parts_table(spark):
    raw = multi("b", NOTE, eml("x", INNER), "Content-Type: message/rfc822\n\n" + INNER)
    rows = spark.createDataFrame([(7, bytearray(raw.encode()))], "msg_id int, content binary")
    parts = explode_parts(parse_mail(rows)).orderBy("visit_no")
    got = [(p.message_no, p.is_root, p.in_eml, p.content_type, p.body_pref) for p in parts.collect()]
    assert got == [
        (0, True, False, "multipart/mixed", False),
        (0, False, False, "text/plain", True),
        (0, False, False, "application/octet-stream", False),
        (1, True, True, "text/plain", False),
        (0, False, False, "message/rfc822", False),
        (2, True, False, "text/plain", False),
    ]
    chosen = select_original(parse_mail(rows)).select(F.col("chosen.message_no")).first()
    assert chosen[0] == 2


def test_few_contents_wait_as_objects(spark, monkeypatch):
    to_batch = mime._to_batch

    def checked(names, kept, rows):
        assert sum(len(part.get("raw_text") or "") for parts, *_ in rows for part in parts) < 2 << 20
        return to_batch(names, kept, rows)

    monkeypatch.setattr(mime, "_to_batch", checked)
    rows = [(i, (head(f"u{i}") + "x" * 100_000).encode()) for i in range(40)]
    parsed = parse_mail(spark.createDataFrame(rows, "msg_id int, content binary").coalesce(1))
    got = {r.msg_id: r.n for r in parsed.select("msg_id", F.length(F.col("parts")[0]["raw_text"]).alias("n")).collect()}
    assert got == dict.fromkeys(range(40), 100_000)
