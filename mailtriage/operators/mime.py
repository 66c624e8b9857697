"""Raw mail bytes to part rows: the one step that needs Python, in Arrow batches.

The standard library's parser runs inside ``mapInArrow``; which message and which body count is
decided afterwards by native expressions (see ``selection``). A mail that cannot be parsed yields an
``error`` instead of failing its task.
"""

from __future__ import annotations

import email
import functools
import re
import sys
from collections.abc import Iterator, Sequence
from email import policy
from email.message import EmailMessage

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailtriage.operators.headers import header_scan

# Executors need no installed copy of this package: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = T.StructType(
    [
        T.StructField("visit_no", T.IntegerType()),  # depth-first order over the whole tree
        T.StructField("message_no", T.IntegerType()),  # 0 is the outer mail, then embedded ones as visited
        T.StructField("is_root", T.BooleanType()),  # first part of its message
        T.StructField("in_eml", T.BooleanType()),  # reached through an attached .eml file
        T.StructField("content_type", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("n_headers", T.IntegerType()),
        T.StructField("from", T.StringType()),  # headers: roots only
        T.StructField("to", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("root_error", T.StringType()),  # counts only if this message is chosen
        T.StructField("is_multipart", T.BooleanType()),
        T.StructField("body_pref", T.BooleanType()),  # the parser's preferred body of its message
        T.StructField("text", T.StringType()),  # decoded with the declared charset: possible bodies only
        T.StructField("text_error", T.StringType()),  # counts only if this text is used
        T.StructField("same_text", T.BooleanType()),  # ``text`` would repeat ``raw_text`` and is left out
        T.StructField("raw_text", T.StringType()),  # decoded as UTF-8: text parts and undivided messages
        T.StructField("source", T.StringType()),  # embedded messages as source, on request
    ]
)
PARTS = T.ArrayType(PART)

_PARTS_ARROW = pa.list_(
    pa.struct(
        [
            (
                f.name,
                {T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}[
                    type(f.dataType)
                ],
            )
            for f in PART.fields
        ]
    )
)
_FLUSH_BYTES = 1 << 20  # of contents whose parts wait as Python objects, or one mail that is larger
_SCANNED = (None, None, None, None)  # a mail whose columns the JVM has found already
_CACHED_HEADERS = 4096
_CACHED_HEADER_LENGTH = 512
# Header values that parsing would give back as they are (a boundary parameter: with the same meaning).
_ADDRESS = r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
_PLAIN_ADDRESS = re.compile(rf"{_ADDRESS}|[A-Za-z]+(?: [A-Za-z]+)* <{_ADDRESS}>")
_PLAIN_HEADERS = {
    "from": _PLAIN_ADDRESS,
    "to": _PLAIN_ADDRESS,
    "subject": re.compile(r"[!-<>-~]+(?: [!-<>-~]+)*"),
    "content-type": re.compile(r"""multipart/[a-z]+;\s*boundary="[0-9A-Za-z'()+_,./:=-]+\""""),
}


def parse_mail(
    mail: DataFrame,
    content_col: str = "content",
    keep: Sequence[str] = ("msg_id",),
    with_source: bool = False,
    recipients: Sequence[str] = (),
    with_texts: bool = True,
) -> DataFrame:
    """The ``keep`` columns with ``parts`` (see :data:`PART`), ``to_addrs`` (lower-case addresses of
    the outer mail; null if they are not known), ``source`` (the outer mail as text, only
    ``with_source``) and ``error``.

    One row per mail in, one row per mail out: a mail and its parts are never shuffled. With
    ``recipients``, mail to none of them is left out and read no further than its headers; mail whose
    recipients cannot be read stays, with an error. Without ``with_texts`` no body is built or sent.

    Plain headers are read in the JVM (see ``headers``): with ``recipients``, mail to others whose headers are plain
    ends there; if only headers are asked for, undivided mail with plain headers sends no content to Python."""
    keep = list(keep)
    wanted = frozenset(r.lower() for r in recipients)
    headers_only = not with_texts and not with_source
    added = [
        T.StructField("parts", PARTS),
        T.StructField("to_addrs", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
    picked = mail.select(*keep, F.col(content_col).alias("_content"))
    if wanted or headers_only:
        # A generator of one row, so that the scan is evaluated once and not in the filter again.
        picked = picked.select("*", F.inline(F.array(F.struct(header_scan(F.col("_content")).alias("_scan")))))
    if wanted:
        told = F.array(*(F.lit(r) for r in sorted(wanted)))
        picked = picked.where(F.col("_scan").isNull() | F.arrays_overlap("_scan.to_addrs", told))
    if headers_only:
        undivided = F.col("_scan.content_type").isNotNull()
        known = F.when(undivided, F.col("_scan")).alias("_scan")
        picked = picked.select(*keep, known, F.when(~F.coalesce(undivided, F.lit(False)), F.col("_content")).alias("_content"))
        keep.append("_scan")
    else:
        picked = picked.select(*keep, "_content")
    schema = T.StructType([*(picked.schema[name] for name in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _caching_policy()
        for batch in batches:
            content = batch.column(len(keep))
            scanned = batch.column(len(keep) - 1).is_valid() if headers_only else None
            taken, pending, size = [], [], 0
            for row in range(batch.num_rows):
                raw = content[row].as_py()
                if scanned is not None and scanned[row].as_py():
                    found = _SCANNED
                else:
                    found = _read_mail(raw, rules, with_source, wanted, with_texts)
                if found is not None:
                    taken.append(row)
                    pending.append(found)
                    size += len(raw or b"")
                if pending and (size >= _FLUSH_BYTES or row + 1 == batch.num_rows):
                    kept = [batch.column(i).take(pa.array(taken, pa.int64())) for i in range(len(keep))]
                    yield _to_batch(keep, kept, pending)
                    taken, pending, size = [], [], 0

    parsed = picked.mapInArrow(run, schema)
    if not headers_only:
        return parsed
    scan = F.col("_scan")
    return parsed.select(
        *keep[:-1],
        F.when(scan.isNotNull(), F.array(_only_part(scan))).otherwise(F.col("parts")).alias("parts"),
        F.when(scan.isNotNull(), scan["to_addrs"]).otherwise(F.col("to_addrs")).alias("to_addrs"),
        "source",
        "error",
    )


def _only_part(scan: Column) -> Column:
    """The part row of an undivided mail, without its text, from its scanned headers."""
    known = {
        "visit_no": F.lit(0),
        "message_no": F.lit(0),
        "is_root": F.lit(True),
        "in_eml": F.lit(False),
        "is_multipart": F.lit(False),
        "body_pref": F.lit(False),
        **{name: scan[name] for name in ("content_type", "n_headers", "from", "to", "subject")},
    }
    return F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields))


def explode_parts(parsed: DataFrame, keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """One row per part, in the order of ``visit_no``; an unreadable mail keeps one row with its error."""
    rows = parsed.select(*keep, "error", F.explode_outer("parts").alias("part")).select(*keep, "part.*", "error")
    return rows.withColumn("text", F.when(F.col("same_text"), F.col("raw_text")).otherwise(F.col("text"))).drop("same_text")


def _to_batch(names: list[str], kept: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
    parts, to_addrs, source, error = zip(*rows, strict=True)
    arrays = [
        *kept,
        pa.array(parts, _PARTS_ARROW),
        pa.array(to_addrs, pa.list_(pa.string())),
        pa.array(source, pa.string()),
        pa.array(error, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, [*names, "parts", "to_addrs", "source", "error"])


def _caching_policy() -> policy.EmailPolicy:
    """The default policy with less work: structured parsing of a header is most of the cost of a mail,
    and the parser repeats it each time it is asked about a part. Plain values skip it, others are
    parsed once and remembered, as most mails carry the same few MIME headers."""
    parsed = functools.lru_cache(maxsize=_CACHED_HEADERS)(policy.default.header_fetch_parse)

    class CachingPolicy(policy.EmailPolicy):
        def header_fetch_parse(self, name: str, value: str) -> str:
            plain = _PLAIN_HEADERS.get(name.lower())
            if plain is not None and plain.fullmatch(value):
                return value
            if len(value) > _CACHED_HEADER_LENGTH:
                return super().header_fetch_parse(name, value)
            return parsed(name, value)

    return CachingPolicy()


def _read_mail(
    raw: bytes | None, rules: policy.EmailPolicy, with_source: bool, wanted: frozenset[str], with_texts: bool
) -> tuple | None:
    """Parts, addresses, source and error of a mail; nothing if it is addressed to none of the wanted recipients."""
    to_addrs = None
    try:
        outer = email.message_from_bytes(raw, policy=rules)
        outer.get("From")
        try:
            to_addrs = _addresses(outer)
        except Exception as problem:
            if wanted:
                return None, None, None, _sendable(f"recipients cannot be read: {problem}")
        if wanted and wanted.isdisjoint(to_addrs):
            return None
        parts = list(_part_rows(outer, with_source, with_texts))
        return parts, to_addrs, _whole_source(outer) if with_source else None, None
    except Exception as problem:  # any defect of one mail becomes that mail's status
        return None, to_addrs, None, _sendable(str(problem))


def _part_rows(outer: EmailMessage, with_source: bool, with_texts: bool = True) -> Iterator[dict]:
    waiting = [(outer, None, False)]
    visits = messages = 0
    preferred: set[int] = set()
    while waiting:
        part, owner, in_eml = waiting.pop()
        is_root = owner is None
        if is_root:
            owner, messages = messages, messages + 1
        kind = part.get_content_type()
        row = {
            "visit_no": visits,
            "message_no": owner,
            "is_root": is_root,
            "in_eml": in_eml,
            "content_type": _sendable(kind),
            "n_headers": len(part),
            "is_multipart": part.is_multipart(),
        }
        visits += 1
        if is_root:
            headers, body = _root_columns(part)
            row.update(headers)
            preferred.add(id(body))
        row["body_pref"] = id(part) in preferred
        may_be_body = row["body_pref"] or kind == "text/plain"
        inner: list[EmailMessage] = []
        embedded = False
        if kind == "message/rfc822":
            inner, embedded = [part.get_payload(0)], True
        elif row["is_multipart"]:
            inner = part.get_payload()
        else:
            can_embed = kind == "application/octet-stream"
            row["filename"] = _sendable(part.get_filename() if can_embed else _filename(part))
            if can_embed and (row["filename"] or "").endswith(".eml"):
                attached = part.get_payload(decode=True)
                inner, embedded = [email.message_from_bytes(attached, policy=part.policy)], True
                in_eml = True
            if is_root or kind.startswith("text/"):
                row.update(_texts(part, is_root, may_be_body) if with_texts else _text_errors(part, may_be_body))
        if with_source and "message/rfc822" in kind:
            row["source"] = _source(part)
        yield row
        waiting.extend((m, None if embedded else owner, in_eml) for m in reversed(inner))


def _root_columns(message: EmailMessage) -> tuple[dict, EmailMessage | None]:
    columns: dict = {}
    try:
        for name in ("From", "To", "Subject"):
            value = message.get(name)
            columns[name.lower()] = None if value is None else _sendable(str(value))
        body = message.get_body(preferencelist=("plain", "html")) if message.is_multipart() else None
        return columns, body
    except Exception as problem:
        return {**columns, "root_error": _sendable(str(problem))}, None


def _filename(part: EmailMessage) -> str | None:
    try:
        return part.get_filename()
    except Exception:  # no rule looks at the name of such a part
        return None


def _texts(part: EmailMessage, is_root: bool, declared: bool) -> dict:
    """The undivided part's ``raw_text`` and, if ``declared``, its ``text`` by the declared charset."""
    try:
        data = part.get_payload(decode=True)
    except Exception as problem:
        return {"root_error" if is_root else "text_error": _sendable(str(problem))}
    raw = data.decode(errors="replace")
    if not declared:
        return {"raw_text": raw}
    try:
        charset = part.get_param("charset", "ASCII")
        if charset in ("utf-8", "UTF-8"):
            return {"raw_text": raw, "same_text": True}
        text = _sendable(data.decode(charset, errors="replace"))
        return {"raw_text": raw, "same_text": True} if text == raw else {"raw_text": raw, "text": text}
    except Exception as problem:
        return {"raw_text": raw, "text_error": _sendable(str(problem))}


def _text_errors(part: EmailMessage, declared: bool) -> dict:
    """What would be wrong with an undivided part's text, without building it."""
    try:
        if declared:
            b"x".decode(part.get_param("charset", "ASCII"), errors="replace")
        return {}
    except Exception as problem:
        return {"text_error": _sendable(str(problem))}


def _whole_source(outer: EmailMessage) -> str | None:
    try:
        return _sendable(str(outer))
    except Exception:
        return None


def _source(part: EmailMessage) -> str | None:
    try:
        return _sendable("\n".join(m.as_string() for m in part.get_payload()))
    except Exception:  # a message that cannot be written back is left out of the dump only
        return None


def _addresses(message: EmailMessage) -> list[str]:
    found: list[str] = []
    for header in message.get_all("To", []):
        if _PLAIN_ADDRESS.fullmatch(header):
            found.append(header.rpartition("<")[2].rstrip(">").lower())
        else:
            found.extend(_sendable(a.addr_spec.lower()) for a in header.addresses)
    return found


def _sendable(text: str | None) -> str | None:
    """Text that Arrow accepts: lone surrogates, which some codecs produce, become U+FFFD."""
    if text is None or text.isascii():
        return text
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
