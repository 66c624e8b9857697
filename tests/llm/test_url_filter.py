from __future__ import annotations

import random
import re

import pytest

from mailtriage.llm import url_filter as u
from mailtriage.llm.queries import op6_url_filter

ENTRIES = [(r, v) for r, v in u.RULES] + [(x, "listed") for x in u.BLOCK_LIST]


def brute_force(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]

    def fits(entry):
        h, _, p = entry.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

    found = max((r for r, _ in rules if fits(r)), key=len, default=None)
    verdict = dict(rules)[found] if found else "block" if any(map(fits, listed)) else "allow"
    return host, path, found, verdict


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "http://ORG/x", "http://a.Example.org/es/1",
    "http://example.org/en/15?x=1", "http://xexample.org/en/15", "https://fr.com/fr/", "ftp://a.com/de/#t", "http://a.com/de",
    "http://com/de/?://org/", "http://ads-track.example.com/", "http://m.ads-track.example.com/fr/2", "http://adult-x.example.com/de/",
    "http://x.adult-x.example.com", "http://.org/", "http://a..org//", "http://exa?mple.org/es/", "http://é.org/ü", "x://" + "a." * 5000 + "org/" + "p" * 9000,
]


@pytest.fixture(scope="module")
def pages(spark):
    random.seed(5)
    made = ["".join(random.choices(["http://", ".", "/", "org", "com", "example", "fr", "de", "es", "en", "1", "?", "#", "A"], k=9)) for _ in range(400)]
    made += ["s://" + "".join(random.choices(["a.", "example.", "org/", "com/", "en/", "1", "de/", "fr/", "es/"], k=5)) for _ in range(600)]
    return spark.createDataFrame([(i, url, "x", 1) for i, url in enumerate(URLS + made)], "page_id long, url string, host string, rule int")


@pytest.mark.parametrize("most", [2, u.MOST_ENTRIES])
def test_against_brute_force(pages, most):
    for r in u.judge_urls(pages, most_entries=most).join(pages.select("page_id", "url"), "page_id").collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_force(r.url, u.RULES, u.BLOCK_LIST), r.url


def test_keys_that_collide_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(u.xxhash, "xxh64_intdigest", lambda raw: len(raw))
    (tmp_path / "list").write_bytes(u.pack([("aa/", 2), ("bb/", 4), ("cc/", 1), ("longer/", 1)]))
    array = u.DigestArray(str(tmp_path / "list"))
    assert array.find([b"bb/", b"dd/", b"cc/", b"aa/", b"longer/", b"x"]) == [4, 0, 1, 2, 1, 0]


def test_bad_lists(pages):
    for rules in ([("org", "allow")], [("/x", "allow")], [("org/", "allow"), ("ORG/", "block")]):
        with pytest.raises(ValueError):
            u.judge_urls(pages, rules)


def test_no_entries_and_no_rows(pages):
    assert {r.verdict for r in u.judge_urls(pages, [], []).collect()} == {"allow"}
    assert u.judge_urls(pages.where("false")).count() == 0


def test_query(spark, table):
    urls = {r.page_id: r.url for r in table("pages").collect()}
    rows = op6_url_filter(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(urls)
    assert all((r.host, r.path, r.rule, r.verdict) == brute_force(urls[r.page_id], u.RULES, u.BLOCK_LIST) for r in rows)
