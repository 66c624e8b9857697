"""One query per operator: ``(spark, sf_dir) -> DataFrame``, over whole tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailtriage import constants as k
from mailtriage.functions import text as t
from mailtriage.functions import verdict as v
from mailtriage.operators import ledger, mime, objects, report, scoring, selection, verdicts
from mailtriage.plans.outputs import compact, read_counts, read_output, write_outputs
from mailtriage.plans.triage import (
    read_mail,
    replay,
    replay_outcomes,
    requests_for,
    triage,
    triage_notifications,
)
from mailtriage.sources import notifications
from mailtriage.sources.listing import list_store
from mailtriage.sources.mail import scan_listing, scan_mail, stream_mail
from mailtriage.sources.workspace import workspace
from mailtriage.streaming.triage_stream import event_stream, triage_stream
from workload import samples as s

PREFIX = "inbox/"
MAX_ITEMS = 100
PREVIEW = 200
UNIT_BYTES = 50_000
LEDGER_BUCKETS = 16
LISTING_BUCKETS = 16


def _stored_id() -> Column:
    """The document of a stored object."""
    return F.regexp_extract("msg_id", r"^(\d+)\.eml$", 1).cast("long")


def email_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of a mail store, opened by a scan."""
    folder = s.store(spark, sf)
    mail = scan_mail(spark, folder, "*.eml", folder)
    return mail.select(
        _stored_id().alias("msg_id"), F.col("size").cast("int").alias("size"), F.md5("content").alias("checksum")
    )


def triage_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of a mail store as an arrival stream, triaged batch by batch into tables; the written decisions."""
    folder = s.store(spark, sf)
    arrivals = stream_mail(spark, folder, "*.eml", folder).withColumn("msg_id", _stored_id())
    out = workspace(spark, "triage-stream")
    triage_stream(
        arrivals,
        s.CONFIG,
        out,
        f"{out}/checkpoint",
        responses=lambda session: s.responses(session, sf),
        run_ts=s.run_ts(),
        tasks=s.tasks(spark),
    ).awaitTermination()
    return read_output(spark, out, "triage").drop("run", "batch_id", "error", "ticket_text")


def object_listing(spark: SparkSession, sf: str) -> DataFrame:
    return objects.list_objects(s.objects(spark, sf), PREFIX, MAX_ITEMS, "full", s.BUCKET)


def listing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return objects.listing_summary(s.objects(spark, sf), PREFIX, MAX_ITEMS)


def size_label(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("n_chars")
    docs = s.table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        t.size_label(size).alias("label"),
        t.size_label(size * 1000).alias("label_thousand"),
        t.size_label(size * 1000000).alias("label_million"),
    )


def missing_objects(spark: SparkSession, sf: str) -> DataFrame:
    return objects.missing_objects(s.requested(spark, sf), s.objects(spark, sf))


def present_objects(spark: SparkSession, sf: str) -> DataFrame:
    return objects.present_objects(s.requested(spark, sf), s.objects(spark, sf))


def notification_parse(spark: SparkSession, sf: str) -> DataFrame:
    def short(*keys: Column) -> Column:
        records = (
            F.struct(
                F.struct(
                    F.struct(F.lit(s.BUCKET).alias("name")).alias("bucket"),
                    F.struct(key.alias("key")).alias("object"),
                ).alias("s3")
            )
            for key in keys
        )
        return F.to_json(F.struct(F.array(*records).alias("Records")))

    shape = F.pmod("doc_id", F.lit(4))
    key = s.object_key(F.col("doc_id"), F.col("source"))
    event = (
        F.when(shape == 0, notifications.notification(F.lit(s.BUCKET), key))
        .when(shape == 1, short(key, F.lit("second")))
        .when(shape == 2, F.lit('{"Records": []}'))
        .otherwise(short(F.concat(key, F.lit("%20x"))))
    )
    events = s.table(spark, sf, "documents").select("doc_id", event.alias("event"))
    return notifications.parse_notifications(events).drop("event")


def replay_manifest(spark: SparkSession, sf: str) -> DataFrame:
    manifest = notifications.build_notifications(s.objects(spark, sf), s.BUCKET)

    def read(path: str) -> Column:
        return F.get_json_object("event", f"$.Records[0].{path}")

    return manifest.select(
        "key",
        read("s3.object.key").alias("object_key"),
        read("s3.bucket.name").alias("bucket"),
        read("s3.bucket.arn").alias("arn"),
        read("eventName").alias("event_name"),
        read("eventTime").alias("event_time"),
        read("userIdentity.principalId").alias("principal"),
        read("s3.object.size").alias("size"),
        F.contains("event", F.lit('"versionId":null')).alias("null_version"),
    )


def replay_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The requested objects of a mail store, found in its listing and opened one by one."""
    folder = s.store(spark, sf)
    listing = scan_listing(spark, folder, root=folder).withColumn("msg_id", _stored_id())
    asked = objects.present_objects(s.requested(spark, sf), s.objects(spark, sf))
    asked = asked.select(F.col("doc_id").alias("msg_id"))
    decided = replay(listing.select("msg_id", "path"), asked, s.CONFIG, s.responses(spark, sf))
    return report.build_status(decided).drop("error")


def notification_status(spark: SparkSession, sf: str) -> DataFrame:
    """A notification for every document: of its stored mail, without any record, or of an object that is not stored."""
    folder = s.store(spark, sf)
    shape, name = F.pmod("doc_id", F.lit(4)), F.concat(F.col("doc_id").cast("string"), F.lit(".eml"))
    event = (
        F.when(shape == 1, F.lit('{"Records": []}'))
        .when(shape == 2, notifications.notification(F.lit(s.BUCKET), F.concat(name, F.lit(".gone"))))
        .otherwise(notifications.notification(F.lit(s.BUCKET), name))
    )
    events = s.table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), event.alias("event"))

    def locate(bucket: Column, key: Column) -> Column:
        return F.concat(F.lit(f"{folder}/"), key)

    decided = triage_notifications(events, s.CONFIG, locate, s.responses(spark, sf), tasks=s.tasks(spark))
    return report.build_status(decided).select("msg_id", "status")


def intake_status(spark: SparkSession, sf: str) -> DataFrame:
    """Mail to one recipient; every fifth mail is lost, so that its recipients are not known."""
    content = F.when(F.pmod("msg_id", F.lit(5)) != 0, F.col("content"))
    mail = s.mail(spark, sf).withColumn("content", content)
    cfg = replace(s.CONFIG, recipients=(s.RECIPIENT,))
    return report.build_status(triage(mail, cfg, s.responses(spark, sf), unique=True)).select("msg_id", "status")


def score_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer in the job that answers by the number in the subject: right, as no text, or with a refusal."""

    def make_scorer(model_id: str | None) -> Callable[[str], str]:
        def score(request: str) -> str:
            subject = json.loads(request)["messages"][0]["content"].split("Subject: doc ")[1]
            shape = int(subject.split(" ")[0]) % 4
            if shape == 3:
                problem = RuntimeError("too many requests")
                problem.service_code = 429
                raise problem
            answer = f"PHISHING by {model_id} \ud800" if shape == 0 else "CLEAN"
            body = {"content": [{"type": "text", "text": answer}]}
            return body if shape == 2 else json.dumps(body, ensure_ascii=False)

        return score

    cfg = replace(s.CONFIG, model_id="example-model", in_flight=4)
    decided = triage(s.mail(spark, sf), cfg, make_scorer=make_scorer, run_date=s.run_date())
    return decided.select("msg_id", "is_phishing", "label", "score_error")


def edge_mail(spark: SparkSession, sf: str) -> DataFrame:
    assembled = read_mail(s.edge_mail(spark, sf), s.CONFIG)
    return assembled.select(
        "msg_id", "reply_to", F.col("from").alias("sender"), F.col("to").alias("recipient"), "subject", "body"
    )


def recipient_filter(spark: SparkSession, sf: str) -> DataFrame:
    parsed = mime.parse_mail(s.mail(spark, sf), recipients=[s.RECIPIENT], with_texts=False)
    return parsed.select("msg_id")


def email_parts(spark: SparkSession, sf: str) -> DataFrame:
    return mime.explode_parts(mime.parse_mail(s.mail(spark, sf))).select(
        "msg_id",
        "visit_no",
        "message_no",
        "is_root",
        "in_eml",
        "content_type",
        "filename",
        "n_headers",
        "is_multipart",
        "body_pref",
        "text",
        "raw_text",
    )


def original_message(spark: SparkSession, sf: str) -> DataFrame:
    chosen = selection.select_original(mime.parse_mail(s.mail(spark, sf), with_texts=False))
    return chosen.select(
        "msg_id",
        F.col("chosen.message_no").alias("message_no"),
        F.col("chosen.n_headers").alias("n_headers"),
        F.col("chosen.is_multipart").alias("is_multipart"),
    )


def _mail(spark: SparkSession, sf: str) -> DataFrame:
    return read_mail(s.mail(spark, sf), s.CONFIG)


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    return read_mail(s.mail(spark, sf), s.CONFIG, with_texts=False)


def mail_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _headers(spark, sf).select(
        "msg_id", F.col("from").alias("sender"), F.col("to").alias("recipient"), "subject"
    )


def reply_address(spark: SparkSession, sf: str) -> DataFrame:
    return _headers(spark, sf).select("msg_id", "reply_to")


def mail_body(spark: SparkSession, sf: str) -> DataFrame:
    return _mail(spark, sf).select("msg_id", "body")


def mail_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _mail(spark, sf).select("msg_id", "envelope")


def body_preview(spark: SparkSession, sf: str) -> DataFrame:
    return _mail(spark, sf).select("msg_id", t.preview(F.col("body"), PREVIEW).alias("preview"))


def text_parts(spark: SparkSession, sf: str) -> DataFrame:
    return selection.text_dump(mime.parse_mail(s.mail(spark, sf), with_source=True)).drop("error")


def raw_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Mail as it would be written again, so of ASCII texts only: others are written in base64."""
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    mail = s.compose_mail(s.documents(spark, sf).withColumn("text", text))
    return selection.text_dump(mime.parse_mail(mail, with_source=True), raw=True).drop("error")


def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.build_prompts(_mail(spark, sf), s.run_date(), s.CONFIG).select("msg_id", "prompt")


def model_request(spark: SparkSession, sf: str) -> DataFrame:
    prompts = scoring.build_prompts(_mail(spark, sf), s.run_date(), s.CONFIG)
    requests = scoring.build_requests(prompts, s.CONFIG)
    return requests.select(
        "msg_id",
        F.get_json_object("request", f"$.{k.REQUEST_VERSION_FIELD}").alias("version"),
        F.get_json_object("request", "$.max_tokens").cast("int").alias("max_tokens"),
        F.get_json_object("request", "$.temperature").cast("double").alias("temperature"),
        F.get_json_object("request", "$.messages[0].role").alias("role"),
        F.get_json_object("request", "$.messages[0].content").alias("content"),
    )


def score_join(spark: SparkSession, sf: str) -> DataFrame:
    mail = _mail(spark, sf).select("msg_id", "subject")
    scored = scoring.join_responses(mail, s.responses(spark, sf))
    return scored.select("msg_id", "subject", F.col("body").isNotNull().alias("answered"), "error_code")


def response_text(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.response_texts(s.responses(spark, sf)).select("msg_id", "text")


def scored_errors(spark: SparkSession, sf: str) -> DataFrame:
    ids = s.documents(spark, sf).select(F.col("doc_id").alias("msg_id"))
    return verdicts.judge_responses(scoring.join_responses(ids, s.responses(spark, sf))).select(
        "msg_id", "is_phishing", "label", "score_error"
    )


def verdict_flag(spark: SparkSession, sf: str) -> DataFrame:
    return s.answers(spark, sf).select("msg_id", v.phishing_flag(F.col("text")).alias("is_phishing"))


def verdict_label(spark: SparkSession, sf: str) -> DataFrame:
    return s.answers(spark, sf).select("msg_id", v.verdict_label(F.col("text")).alias("label"))


def section_items(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.section_items(s.answers(spark, sf))


def bold_items(spark: SparkSession, sf: str) -> DataFrame:
    lines = s.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "pos", v.item_html(t.strip(F.col("line"))).alias("item"))


def section_html(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.judge(s.answers(spark, sf)).select("msg_id", "analysis")


def reply_subject(spark: SparkSession, sf: str) -> DataFrame:
    return _triage(spark, sf).select("msg_id", "reply_subject")


def report_html(spark: SparkSession, sf: str) -> DataFrame:
    judged = verdicts.judge(s.answers(spark, sf))
    html = report.report_html(F.col("is_phishing"), F.col("analysis"))
    return judged.select("msg_id", html.alias("report"))


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return s.pages(spark, sf).select("page_id", t.html_to_text(F.col("html")).alias("text"))


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    doc_id = F.col("doc_id")
    text = F.concat(
        F.col("text"),
        F.lit(" call 555-"),
        F.lpad(F.pmod(doc_id, F.lit(1000)).cast("string"), 3, "0"),
        F.lit("-4567 ssn 123-45-"),
        F.lpad(F.pmod(doc_id, F.lit(10000)).cast("string"), 4, "0"),
        F.lit(" see https://ex.example.com/"),
        doc_id.cast("string"),
    )
    return s.documents(spark, sf).select("doc_id", t.redact(text).alias("redacted"))


def redact_pages(spark: SparkSession, sf: str) -> DataFrame:
    return s.pages(spark, sf).select("page_id", t.redact(F.col("html")).alias("redacted"))


def _triage(spark: SparkSession, sf: str) -> DataFrame:
    return triage(s.mail(spark, sf), s.CONFIG, s.responses(spark, sf), run_date=s.run_date(), unique=True)


def triage_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _triage(spark, sf).drop("error", "ticket_text")


def catch_all_routed(spark: SparkSession, sf: str) -> DataFrame:
    routed = _headers(spark, sf).where(report.goes_to_catch_all(F.col("reply_to"), s.CONFIG))
    return routed.select("msg_id", "reply_to", "subject")


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    built = report.build_tickets(_triage(spark, sf), s.CONFIG, s.run_ts())
    return built.withColumn("labels", F.array_join("labels", ","))


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    return report.build_outbox(_triage(spark, sf), s.CONFIG)


def processing_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth document's mail declares an unknown charset; that fails where the charset counts."""
    broken = F.encode(
        F.replace(F.decode("content", "UTF-8"), F.lit('charset="utf-8"'), F.lit('charset="bogus-1"')), "UTF-8"
    )
    mail = s.mail(spark, sf).withColumn(
        "content", F.when(F.pmod("msg_id", F.lit(5)) == 0, broken).otherwise(F.col("content"))
    )
    return report.build_status(triage(mail, s.CONFIG, s.responses(spark, sf)))


def outbox_text(spark: SparkSession, sf: str) -> DataFrame:
    return report.build_outbox(_triage(spark, sf), s.CONFIG, is_html=False).drop("config_set", "sender")


def sender_default(spark: SparkSession, sf: str) -> DataFrame:
    doc_id, source = F.col("doc_id"), F.col("source")
    sender = (
        F.when(F.pmod(doc_id, F.lit(3)) == 0, F.concat(source, F.lit("@example.org")))
        .when(F.pmod(doc_id, F.lit(3)) == 1, F.lit(""))
        .otherwise(F.lit(None))
    )
    domain = F.when(F.pmod(doc_id, F.lit(2)) == 0, F.concat(source, F.lit(".example.net"))).otherwise("")
    return s.table(spark, sf, "documents").select(
        "doc_id", report.sender_address(sender, domain).alias("sender")
    )


def event_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of notifications in two batches: of stored mail, of mail that is not there, without a record, and repeats
    of every eighth one; the written decisions. Events are numbered by twice the document, and one more for a repeat."""
    folder, doc_id = s.store(spark, sf), F.col("doc_id")
    shape, name = F.pmod(doc_id, F.lit(4)), F.concat(doc_id.cast("string"), F.lit(".eml"))
    event = (
        F.when(shape == 1, F.lit('{"Records": []}'))
        .when(shape == 2, notifications.notification(F.lit(s.BUCKET), F.concat(name, F.lit(".gone"))))
        .otherwise(notifications.notification(F.lit(s.BUCKET), name))
    )
    times = F.explode(F.when(F.pmod(doc_id, F.lit(8)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    told = s.table(spark, sf, "documents").select("doc_id", event.alias("event"), times.alias("again"))
    out = workspace(spark, "event-stream")
    told.select((doc_id * 2 + F.col("again")).alias("msg_id"), "event").repartition(4).write.json(f"{out}/events")
    events = spark.readStream.schema("msg_id long, event string").option("maxFilesPerTrigger", 2).json(f"{out}/events")
    answers = s.responses(spark, sf).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    event_stream(
        events,
        s.CONFIG,
        lambda bucket, key: F.concat(F.lit(f"{folder}/"), key),
        out,
        f"{out}/checkpoint",
        responses=lambda session: answers.withColumn("msg_id", F.col("msg_id") * 2 + F.col("again")).drop("again"),
        run_ts=s.run_ts(),
        tasks=s.tasks(spark),
    ).awaitTermination()
    decided = read_output(spark, out, "triage").withColumnRenamed("msg_id", "event_id")
    return decided.select("event_id", F.col("error").isNull().alias("processed"), "reply_to", "reply_subject", "is_phishing")


def object_listing_source(spark: SparkSession, sf: str) -> DataFrame:
    """A store's objects, listed by tasks; the prefix is pushed into the listing."""
    listed = list_store(spark, s.keyed_store(spark, sf)).where(F.startswith("key", F.lit(PREFIX)))
    return listed.select("key", "size", t.size_label(F.col("size")).alias("label"))


def replay_outcomes_query(spark: SparkSession, sf: str) -> DataFrame:
    """An outcome for every object that is asked for; every second label asks for one that is not stored."""
    listing = list_store(spark, s.store(spark, sf)).select(F.col("key").alias("msg_id"), "path")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, ".gone").otherwise(".eml"))
    asked = s.table(spark, sf, "labels").select(name.alias("msg_id"))
    answers = s.responses(spark, sf).withColumn("msg_id", F.concat(F.col("msg_id").cast("string"), F.lit(".eml")))
    decided = replay_outcomes(listing, asked, s.CONFIG, answers, tasks=s.tasks(spark))
    return report.build_status(decided).select("msg_id", "status", "status_body")


def work_units_query(spark: SparkSession, sf: str) -> DataFrame:
    return objects.work_units(s.objects(spark, sf), UNIT_BYTES).select("key", "size", "unit")


def stored_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Which requests are stored and which are not, asked of a listing that is kept in buckets."""
    listing = objects.store_listing(s.objects(spark, sf), f"listing_{uuid.uuid4().hex}", LISTING_BUCKETS)
    asked = s.requested(spark, sf)
    found = objects.present_objects(asked, listing).withColumn("stored", F.lit(True))
    return found.unionByName(objects.missing_objects(asked, listing).withColumn("stored", F.lit(False)))


def score_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer that fails for every third document, run twice on one ledger; which run has the answer."""
    path = f"{workspace(spark, 'scoring')}/ledger"
    requests = requests_for(_mail(spark, sf), s.CONFIG, s.run_date())

    def maker(run: int, fails: bool) -> Callable[[str | None], Callable[[str], str]]:
        def make_scorer(model_id: str | None) -> Callable[[str], str]:
            def score(request: str) -> str:
                subject = json.loads(request)["messages"][0]["content"].split("Subject: doc ")[1]
                number = int(subject.split(" ")[0])
                if fails and number % 3 == 0:
                    raise RuntimeError("no answer")
                return json.dumps({"content": [{"text": f"{'PHISHING' if number % 2 else 'CLEAN'} run {run}"}]})

            return score

        return make_scorer

    ledger.score_once(requests, maker(1, True), path, in_flight=4, buckets=LEDGER_BUCKETS)
    answers = ledger.score_once(requests, maker(2, False), path, in_flight=4, buckets=LEDGER_BUCKETS)
    text = scoring.response_texts(answers)
    run = F.regexp_extract("text", r"run (\d)", 1).cast("int")
    return text.select("msg_id", v.verdict_label(F.col("text")).alias("label"), run.alias("run"))


def _batches(spark: SparkSession, sf: str) -> str:
    """Decided mail written as four batches."""
    out = workspace(spark, "batches")
    decided = _triage(spark, sf)
    for batch in range(4):
        own = decided.where(F.pmod("msg_id", F.lit(4)) == batch)
        write_outputs(own, s.CONFIG, out, s.run_ts(), "run", batch)
    return out


def compacted_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of four batches, of which three are then rewritten into one."""
    out = _batches(spark, sf)
    compact(spark, out, "run")
    return read_output(spark, out, "outbox").drop("run", "config_set", "sender", "body_html")


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many mails of each batch succeeded and failed, as counted by the jobs that wrote them. Every fifth mail is lost."""
    out = workspace(spark, "counted")
    content = F.when(F.pmod("msg_id", F.lit(5)) != 0, F.col("content"))
    decided = triage(s.mail(spark, sf).withColumn("content", content), s.CONFIG, s.responses(spark, sf), unique=True)
    for batch in range(2):
        write_outputs(decided.where(F.pmod("msg_id", F.lit(2)) == batch), s.CONFIG, out, s.run_ts(), "run", batch)
    rows = [(batch, counts["succeeded"], counts["failed"]) for ((_, batch),), counts in read_counts(spark, out)]
    return spark.createDataFrame(rows, "batch_id long, succeeded long, failed long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "email_scan": email_scan,
    "triage_stream": triage_stream_query,
    "object_listing": object_listing,
    "listing_summary": listing_summary,
    "size_label": size_label,
    "missing_objects": missing_objects,
    "present_objects": present_objects,
    "notification_parse": notification_parse,
    "replay_manifest": replay_manifest,
    "replay_batch": replay_batch,
    "recipient_filter": recipient_filter,
    "email_parts": email_parts,
    "original_message": original_message,
    "mail_headers": mail_headers,
    "reply_address": reply_address,
    "mail_body": mail_body,
    "mail_envelope": mail_envelope,
    "body_preview": body_preview,
    "text_parts": text_parts,
    "prompt_table": prompt_table,
    "model_request": model_request,
    "score_join": score_join,
    "response_text": response_text,
    "scored_errors": scored_errors,
    "verdict_flag": verdict_flag,
    "verdict_label": verdict_label,
    "section_items": section_items,
    "bold_items": bold_items,
    "section_html": section_html,
    "reply_subject": reply_subject,
    "report_html": report_html,
    "html_to_text": html_to_text,
    "redact_documents": redact_documents,
    "redact_pages": redact_pages,
    "catch_all_routed": catch_all_routed,
    "tickets": tickets,
    "processing_status": processing_status,
    "outbox": outbox,
    "outbox_text": outbox_text,
    "notification_status": notification_status,
    "intake_status": intake_status,
    "score_hook": score_hook,
    "edge_mail": edge_mail,
    "raw_dump": raw_dump,
    "sender_default": sender_default,
    "triage_batch": triage_batch,
    "event_stream": event_stream_query,
    "object_listing_source": object_listing_source,
    "replay_outcomes": replay_outcomes_query,
    "work_units": work_units_query,
    "stored_listing": stored_listing,
    "score_resumed": score_resumed,
    "compacted_outbox": compacted_outbox,
    "outcome_counts": outcome_counts,
}
