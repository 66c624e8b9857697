"""Mail, responses, objects and notifications that Spark composes from the driver's tables.

Every document becomes one mail whose chosen From, Subject and body are known from its columns; the
shape of the mail goes by ``doc_id``. All rows and whole texts are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtriage.config import TriageConfig
from mailtriage.sources.workspace import workspace

CONFIG = TriageConfig(
    catch_all="unknown@example.com",
    domain="triage.example.com",
    ticket_token="token",
    ticket_owner="owner",
    ticket_repo="repo",
)
RECIPIENT = "scan@example.com"
BUCKET = "mailbox"
TASKS = "spark.mailtriage.tasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int | None:
    """Over how many tasks the session's owner wants scans spread, whatever their size; none unless it is set."""
    wanted = spark.conf.get(TASKS, None)
    return int(wanted) if wanted else None


def _spread(scan: DataFrame) -> DataFrame:
    wanted = tasks(scan.sparkSession)
    return scan.repartition(wanted) if wanted else scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(table(spark, sf_dir, "pages"))


def run_date() -> Column:
    return F.to_date(F.lit("2024-03-05"))


def run_ts() -> Column:
    return F.to_timestamp(F.lit("2024-03-05 06:07:08"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def mail_text(doc_id: Column, text: Column, lang: Column, source: Column) -> Column:
    """The mail of a document as text; its six shapes are chosen by ``doc_id``."""
    number = doc_id.cast("string")
    mark = _text("b", number)
    utf8 = 'charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'
    headers = _text(
        "From: u", number, "@", source, ".example.com\nTo: inbox@example.com\nSubject: doc ", number, " ", lang
    )
    plain = _text(headers, "\nMIME-Version: 1.0\nContent-Type: text/plain; ", utf8, text)
    html = _text(headers, "\nMIME-Version: 1.0\nContent-Type: text/html; ", utf8, text)
    alternative = _text(
        headers,
        '\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="',
        mark,
        '"\n\n--',
        mark,
        "\nContent-Type: text/plain; " + utf8,
        text,
        "\n--",
        mark,
        "\nContent-Type: text/html; " + utf8 + "<p>",
        lang,
        "</p>\n--",
        mark,
        "--\n",
    )

    def forward(kind: str, payload: Column) -> Column:
        return _text(
            "From: user",
            number,
            f"@example.com\nTo: {RECIPIENT}\nSubject: Fwd\nMIME-Version: 1.0\n"
            'Content-Type: multipart/mixed; boundary="f',
            mark,
            '"\n\n--f',
            mark,
            "\nContent-Type: text/plain; " + utf8 + "please check\n--f",
            mark,
            "\n" + kind + "\n\n",
            payload,
            "\n--f",
            mark,
            "--\n",
        )

    as_message = forward("Content-Type: message/rfc822", plain)
    as_file = forward(
        "Content-Type: application/octet-stream\n"
        'Content-Disposition: attachment; filename="m.eml"\nContent-Transfer-Encoding: base64',
        F.base64(F.encode(plain, "UTF-8")),
    )
    nested = _text("Subject: Fwd\nMIME-Version: 1.0\nContent-Type: message/rfc822\n\n", as_message)
    shape = F.pmod(doc_id, F.lit(6))
    return (
        F.when(shape == 0, plain)
        .when(shape == 1, alternative)
        .when(shape == 2, html)
        .when(shape == 3, as_message)
        .when(shape == 4, as_file)
        .otherwise(nested)
    )


def compose_mail(docs: DataFrame) -> DataFrame:
    """``msg_id, content`` for a batch or a stream of documents."""
    whole = mail_text(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"))
    return docs.select(F.col("doc_id").alias("msg_id"), F.encode(whole, "UTF-8").alias("content"))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose_mail(documents(spark, sf_dir))


def edge_mail_content(doc_id: Column, text: Column, lang: Column) -> Column:
    """Six rarer shapes, by ``doc_id``: a forward without headers, attachments only, no headers that count, a single
    part in Latin-1, an encoded subject, and an attached mail whose name ends in capitals."""
    number = doc_id.cast("string")
    utf8 = 'charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'
    outer = _text("From: user", number, f"@example.com\nTo: {RECIPIENT}\nSubject: Fwd\nMIME-Version: 1.0\n")
    mixed = 'Content-Type: multipart/mixed; boundary="b"\n\n'
    note = "--b\nContent-Type: text/plain; " + utf8 + "please check\n"
    forward = _text(outer, mixed, note, "--b\nContent-Type: message/rfc822\n\n\n", text, "\n--b--\n")
    attached = "--b\nContent-Disposition: attachment\nContent-Type: text/plain; " + utf8
    files = _text(outer, mixed, attached, text, "\n", attached, lang, "\n--b--\n")
    bare = _text("MIME-Version: 1.0\nContent-Type: text/plain; ", utf8, text)
    latin = _text(outer, 'Content-Type: text/plain; charset="iso-8859-1"\nContent-Transfer-Encoding: 8bit\n\n', text)
    word = F.base64(F.encode(_text("Übung ", number), "UTF-8"))
    encoded = _text("From: a@x.org\nTo: b@x.org\nSubject: =?utf-8?b?", word, "?=\nContent-Type: text/plain; ", utf8, text)
    capitals = _text(
        outer,
        mixed,
        note,
        '--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename="m.EML"\n\nSubject: no\n\n',
        text,
        "\n--b--\n",
    )
    shape = F.pmod(doc_id, F.lit(6))
    return (
        F.when(shape == 0, F.encode(forward, "UTF-8"))
        .when(shape == 1, F.encode(files, "UTF-8"))
        .when(shape == 2, F.encode(bare, "UTF-8"))
        .when(shape == 3, F.encode(latin, "ISO-8859-1"))
        .when(shape == 4, F.encode(encoded, "UTF-8"))
        .otherwise(F.encode(capitals, "UTF-8"))
    )


def edge_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = edge_mail_content(F.col("doc_id"), F.col("text"), F.col("lang"))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("msg_id"), content.alias("content"))


_STORES: dict[tuple[str, str, str], str] = {}


def store(spark: SparkSession, sf_dir: str) -> str:
    """A folder that holds the documents' mail as objects ``<doc_id>.eml``, written by the tasks once in an application:
    the store is there before the jobs that read it."""
    name = F.concat(F.col("msg_id").cast("string"), F.lit(".eml"))
    return _store("mail-store", lambda: mail(spark, sf_dir).select(name.alias("key"), "content"), spark, sf_dir)


def keyed_store(spark: SparkSession, sf_dir: str) -> str:
    """A folder that holds the documents' texts as objects under the keys of :func:`objects`, in folders by source."""
    key = object_key(F.col("doc_id"), F.col("source"))
    content = F.encode("text", "UTF-8").alias("content")
    return _store("keyed-store", lambda: documents(spark, sf_dir).select(key.alias("key"), content), spark, sf_dir)


def _store(name: str, make: Callable[[], DataFrame], spark: SparkSession, sf_dir: str) -> str:
    application = (name, spark.sparkContext.applicationId, sf_dir)
    if application not in _STORES:
        _STORES[application] = _write_store(make(), workspace(spark, name))
    return _STORES[application]


def _write_store(contents: DataFrame, folder: str) -> str:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made = set()
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{key}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    files.create_dir(parent, recursive=True)
                    made.add(parent)
                with files.open_output_stream(path) as out:
                    out.write(content)
            yield batch.select([0])

    contents.mapInArrow(write, "key string").write.format("noop").mode("overwrite").save()
    return folder


def answer_text(doc_id: Column, text: Column) -> Column:
    """The model's answer to a document's mail: ten variants around its whole text."""
    red, close = "[SECTION]RED FLAGS[/SECTION]\n", "[/SECTION]\n"
    clean = "[SECTION]CLEAN INDICATORS[/SECTION]\n"
    tips = "[SECTION]HOW TO IDENTIFY SIMILAR THREATS" + close
    variant = F.pmod(doc_id, F.lit(10))
    return (
        F.when(variant == 0, _text("PHISHING\n\n", red, "- **Urgent** ", text, "\n• second\n", tips, "* tip"))
        .when(variant == 1, _text("CLEAN\n\n", clean, "- ", text))
        .when(variant == 2, _text("CLEAN\n", clean, "- No phishing signs\n- ok\n", text))
        .when(variant == 3, _text("**CLEAN**\n", clean, "- ", text))
        .when(variant == 4, _text("Verdict: suspicious\n", red, "- ", text))
        .when(variant == 5, _text("CLEAN\n", red, "- ", text))
        .when(variant == 6, _text("filler\n" * 20, "PHISHING\n", text))
        .when(variant == 8, _text("PHISHING\n", red, "- a\n", red, "- b\n", text))
        .when(variant == 9, _text("PHISHING\n", red, "- This is PHISHING mail\n**Lead** x\n- kept\n", text))
        .otherwise(_text("  \n", text))
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, text``: one answer text per document."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("msg_id"), answer_text(F.col("doc_id"), F.col("text")).alias("text")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, body, error_code``: the model service's responses. Documents with ``doc_id % 10 = 7``
    have none, or an error where ``doc_id % 20 = 7``."""
    doc_id = F.col("doc_id")
    answer = F.struct(
        F.lit("text").alias("type"), answer_text(doc_id, F.col("text")).alias("text")
    )
    body = F.to_json(F.struct(F.array(answer).alias("content")))
    refused = F.pmod(doc_id, F.lit(20)) == 7
    return (
        documents(spark, sf_dir)
        .where(refused | (F.pmod(doc_id, F.lit(10)) != 7))
        .select(
            doc_id.alias("msg_id"),
            F.when(~refused, body).alias("body"),
            F.when(refused, F.lit("ThrottlingException")).alias("error_code"),
        )
    )


def object_key(doc_id: Column, source: Column) -> Column:
    return _text("inbox/", source, "/", F.lpad(doc_id.cast("string"), 8, "0"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, size, last_modified``: the object listing of the documents' mail."""
    doc_id = F.col("doc_id")
    age = F.pmod(doc_id * 7919, F.lit(100000))
    return table(spark, sf_dir, "documents").select(
        object_key(doc_id, F.col("source")).alias("key"),
        F.col("n_chars").alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + age).alias("last_modified"),
    )


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, doc_id``: labelled documents as requested objects. Labels with ``toxic = 1`` ask for a key
    that is not stored."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    key = object_key(F.col("doc_id"), F.col("source"))
    asked = F.when(F.col("toxic") == 1, _text(key, ".gone")).otherwise(key)
    return labels.join(docs, "doc_id").select(asked.alias("key"), "doc_id")
