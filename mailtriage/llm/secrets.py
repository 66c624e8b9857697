"""Secret scan with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain. Texts
are indexed in segments of bounded size: one pass finds the trigrams that any query names and makes, for each, its
posting list over the segment's texts. Postings are intersected and united as the query says, and only the texts
that remain are searched by the rule itself. A rule without mandatory trigrams searches every text. The index folds
A-Z to lower case, so it can only let through too much, never too little.

A null text is empty and has no spans. Every row gives one row, repeated rows alike; an empty table gives an empty
result. Spans are in code points with the end exclusive; spans of different kinds may overlap. Extra columns are not
read. A text of any length is indexed and searched whole.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from mailtriage.llm.tables import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points of the group below; shorter matches are dropped
    group: int = 0
    base: bool = False


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The base rules, in their order.
BASE_RULES = (
    Rule(
        "assign",
        "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
        True,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", "[0-9a-f]+", 24, 0, True),
)
#: What the method adds: credentials with a form of their own.
MORE_RULES = (
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]{1,64}:[^\x00-\x20/@:]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 64
SEGMENT_BYTES = 4 << 20

# A query is None (anything may match), a trigram, ("and", queries) or ("or", queries).


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts: list) -> object:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_string(text: str) -> object:
    raw = text.encode()
    return _all([raw[i : i + 3] for i in range(len(raw) - 2)])


def _folded(point: int) -> str:
    return chr(point).lower() if point < 128 else chr(point)


def _strings(code: object, value: object) -> set[str] | None:
    """The strings that one element of a parsed pattern stands for, if they are few."""
    if code is op.LITERAL:
        return {_folded(value)}
    if code is op.IN and all(c is op.LITERAL for c, _ in value) and len(value) <= 8:
        return {_folded(v) for _, v in value}
    if code is op.SUBPATTERN:
        return _sequence(value[-1])
    if code is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if code is op.MAX_REPEAT and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence(items: object) -> set[str] | None:
    found = {""}
    for code, value in items:
        step = _strings(code, value)
        if step is None or len(found) * len(step) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in step}
    return found


def _query(items: object) -> object:
    parts, run = [], {""}

    def close() -> None:
        nonlocal run
        parts.append(_any([_of_string(s) for s in sorted(run)]))
        run = {""}

    for code, value in items:
        step = _strings(code, value)
        if step is not None:
            joined = {a + b for a in run for b in step}
            if len(joined) > _MOST_STRINGS:
                close()
                joined = step
            run = joined
            continue
        close()
        if code is op.SUBPATTERN:
            parts.append(_query(value[-1]))
        elif code is op.BRANCH:
            parts.append(_any([_query(p) for p in value[1]]))
        elif code is op.MAX_REPEAT and value[0] >= 1:
            parts.append(_query(value[2]))
    close()
    return _all(parts)


def trigram_query(pattern: str) -> object:
    """What every match of the pattern must contain."""
    return _query(parser.parse(pattern))


def _named(query: object) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class TrigramIndex:
    """Posting lists of the named trigrams over a segment of texts."""

    def __init__(self, named: Sequence[bytes]):
        self.number = {t: i + 1 for i, t in enumerate(sorted(named))}
        self.codes = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.codes[int.from_bytes(t, "big")] = i

    def postings(self, raw: Sequence[bytes]) -> np.ndarray:
        """``[trigram, text]``: whether the text holds the trigram."""
        data = b"\xff\xff".join(raw).lower()  # these bytes never occur in UTF-8
        found = np.zeros((len(self.number) + 1, len(raw)), bool)
        starts = np.cumsum([0, *(len(x) + 2 for x in raw)])[:-1]
        values = np.frombuffer(data, np.uint8)
        for at in range(0, max(0, len(values) - 2), SEGMENT_BYTES):
            part = values[at : at + SEGMENT_BYTES + 2].astype(np.uint32)
            hits = self.codes[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(hits)
            found[hits[where], np.searchsorted(starts, where + at, "right") - 1] = True
        return found

    def candidates(self, query: object, postings: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.number[query]]
        lists = [self.candidates(part, postings) for part in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(lists)


def rule_spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap, without those that are too short."""
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def _segments(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, x in enumerate(raw):
        if size and size + len(x) > SEGMENT_BYTES:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(raw):
        yield start, len(raw)


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``found``, an array of ``kind, start, end, base`` by start, then in the order of the rules."""
    # A run of one class that must be long: asking for the length at once finds the same matches.
    patterns = [re.sub(r"\]\+$", f"]{{{r.least},}}", r.pattern) if r.pattern.count("]") == 1 and r.pattern[0] == "[" else r.pattern for r in rules]
    queries = [trigram_query(p) for p in patterns]
    named = sorted(set().union(*map(_named, queries)))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(named)
        compiled = [re.compile(p) for p in patterns]
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            for first, end in _segments(raw):
                segment = raw[first:end]
                postings = index.postings(segment)
                found: list[list] = [[] for _ in segment]
                decoded: dict[int, str] = {}
                for n, (rule, search, query) in enumerate(zip(rules, compiled, queries, strict=True)):
                    for i in np.flatnonzero(index.candidates(query, postings)).tolist():
                        if i not in decoded:
                            decoded[i] = segment[i].decode()
                        found[i] += [(s, n, e) for s, e in rule_spans(rule, search, decoded[i])]
                rows = [
                    [{"kind": rules[n].kind, "start": s, "end": e, "base": rules[n].base} for s, n, e in sorted(x)]
                    for x in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(rows, pa.list_(span))],
                    names=["doc_id", "found"],
                )

    return texts(docs, id_col, text_col).mapInArrow(
        scan, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean>>"
    )


def digest(spans: Sequence[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
