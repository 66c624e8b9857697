"""Committed batches, compaction, the event stream, and scoring that is taken up again."""

from __future__ import annotations

import json
import shutil
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_jobs import CFG, answer_of, mail_of, now

from mailtriage.operators.ledger import score_once
from mailtriage.operators.report import build_status
from mailtriage.plans import outputs
from mailtriage.plans.commits import commit, committed
from mailtriage.plans.outputs import clear_replaced, compact, read_counts, read_output, write_outputs
from mailtriage.plans.triage import decide, decide_light, read_notified, triage
from mailtriage.sources.notifications import notification
from mailtriage.streaming import triage_stream
from mailtriage.streaming.triage_stream import event_stream


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame([(i, answer_of(i), None) for i in range(40)], "msg_id long, body string, error_code string")


@pytest.fixture(scope="module")
def mails(spark, responses):
    """Decided rows of the given mails."""

    def decided(*ids, subject=None):
        content = lambda i: mail_of(i) if subject is None else f"From: a@x.org\nSubject: {subject}\n\nx"
        rows = [(i, bytearray(content(i).encode())) for i in ids]
        return triage(spark.createDataFrame(rows, "msg_id long, content binary"), CFG, responses)

    return decided


def ids(spark, out, table="triage"):
    return sorted((r.run, r.batch_id, r.msg_id) for r in read_output(spark, out, table).collect())


def test_a_write_that_is_killed_half_way_shows_nothing(spark, mails, tmp_path, monkeypatch):
    out = str(tmp_path)

    def lost(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(outputs, "build_status", lost)
        with pytest.raises(RuntimeError):
            write_outputs(mails(1), CFG, out, now(), "r", 0)
        with pytest.raises(ValueError, match="no batch is committed"):
            read_output(spark, out, "triage")
    write_outputs(mails(1, 2), CFG, out, now(), "r", 0)
    with monkeypatch.context() as broken:
        broken.setattr(outputs, "build_tickets", lost)
        for batch in (0, 1):
            with pytest.raises(RuntimeError):
                write_outputs(mails(7), CFG, out, now(), "r", batch)
    for table in ("triage", "outbox", "status"):
        assert ids(spark, out, table) == [("r", 0, 1), ("r", 0, 2)]
    assert clear_replaced(spark, out) == 7  # three tables of the first killed write, two of each of the others
    assert ids(spark, out) == [("r", 0, 1), ("r", 0, 2)]


def test_a_record_that_was_not_put_in_place_does_not_count(spark, mails, tmp_path):
    out = str(tmp_path)
    write_outputs(mails(1), CFG, out, now(), "r", 0)
    (tmp_path / "commits" / "_half").write_text('{"seq": 9, "id": "x", "batches": [{"run": "r", "ba')
    assert ids(spark, out) == [("r", 0, 1)]


def test_of_two_records_of_one_number_one_counts(spark, tmp_path):
    out = str(tmp_path)
    for name in ("one", "two"):
        commit(spark, out, [("r", 0)], {"triage": name}, {}, {})
    for path in (tmp_path / "commits").glob("0*.json"):
        record = json.loads(path.read_text())
        path.write_text(json.dumps({**record, "seq": 1}))
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert len(committed(spark, out)) == 1


def test_compaction(spark, mails, tmp_path):
    out = str(tmp_path)
    for batch in range(5):
        write_outputs(mails(3 * batch, 3 * batch + 1, 3 * batch + 4), CFG, out, now(), "r", batch)
    write_outputs(mails(30), CFG, out, now(), "other", 0)
    tables = ("triage", "outbox", "tickets", "status")
    before = {t: sorted(map(tuple, read_output(spark, out, t).collect()), key=repr) for t in tables}
    planned = read_output(spark, out, "outbox")  # by a reader that still has the old folders
    files = len(read_output(spark, out, "triage").inputFiles())
    assert compact(spark, out, "r") == 4
    assert {t: sorted(map(tuple, read_output(spark, out, t).collect()), key=repr) for t in tables} == before
    assert len(read_output(spark, out, "triage").inputFiles()) < files
    assert sorted(map(tuple, planned.collect()), key=repr) == before["outbox"]
    assert compact(spark, out, "r") == 0  # one set is left beside the newest batch
    # A batch inside the compacted files is written again, and then compacted again with the rest.
    write_outputs(mails(39), CFG, out, now(), "r", 2)
    want = sorted([r for r in [(x[-2], x[-1], x[0]) for x in before["triage"]] if r[:2] != ("r", 2)] + [("r", 2, 39)])
    assert ids(spark, out) == want
    assert compact(spark, out, "r", newest=0) == 3
    assert ids(spark, out) == want
    assert clear_replaced(spark, out) > 0
    assert ids(spark, out) == want and ids(spark, out, "status") == want


def test_outcomes_are_counted_by_the_job_that_writes(spark, mails, tmp_path):
    out = str(tmp_path)
    write_outputs(mails(*range(10)), CFG, out, now(), "r", 0)
    status = {r.status: r["count"] for r in read_output(spark, out, "status").groupBy("status").count().collect()}
    assert read_counts(spark, out) == [((("r", 0),), {"succeeded": status[200], "failed": status[500]})]


def event(spark, key):
    return spark.range(1).select(notification(F.lit("box"), F.lit(key)).alias("e")).first().e


def test_events_as_a_stream(spark, responses, tmp_path):
    store, told = tmp_path / "store", tmp_path / "events"
    store.mkdir()
    told.mkdir()
    for i in (1, 4, 6):
        (store / f"m{i}.eml").write_text(mail_of(i))
    (store / "never told of").write_text(mail_of(1))
    rows = {1: event(spark, "m1.eml"), 2: event(spark, "gone"), 3: '{"Records": []}', 4: event(spark, "m4.eml"), 5: None, 6: event(spark, "m6.eml"), 7: event(spark, "m1.eml")}
    for i, text in rows.items():
        (told / f"{i}.json").write_text(json.dumps({"msg_id": i, "event": text}))
    locate = lambda bucket, key: F.concat(F.lit(f"{store}/"), key)
    out, checkpoint = str(tmp_path / "out"), tmp_path / "checkpoint"

    def run():
        events = spark.readStream.schema("msg_id long, event string").option("maxFilesPerTrigger", 3).json(str(told))
        event_stream(events, CFG, locate, out, str(checkpoint), responses=lambda _: responses, run_ts=now()).awaitTermination()
        return sorted(tuple(r) for r in read_output(spark, out, "triage").collect())

    first = run()
    got = {r.msg_id: r.status for r in read_output(spark, out, "status").collect()}
    assert got == {1: 200, 2: 500, 3: 500, 4: 500, 5: 500, 6: 200, 7: 200}
    assert run() == first
    # The stream lost its note that the last batch was done: it runs again and replaces its rows.
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    records = len(list((Path(out) / "commits").glob("*.json")))
    assert run() == first
    assert len(list((Path(out) / "commits").glob("*.json"))) == records + 1
    batch = spark.createDataFrame(list(rows.items()), "msg_id long, event string")
    plan = decide(read_notified(batch, CFG, locate), CFG, responses)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "MapInArrow" in plan


def test_a_batch_of_events_moves_only_its_own_responses(spark, tmp_path, monkeypatch):
    told, moved = tmp_path / "events", []
    told.mkdir()
    for i in range(4):
        (told / f"{i}.json").write_text(json.dumps({"msg_id": i, "event": event(spark, "gone")}))
    answers = spark.range(5000).selectExpr("id as msg_id", "repeat('x', 2000) as body", "string(null) as error_code")

    def noted(assembled, cfg, responses, *rest):
        moved.append(responses.count())
        return decide(assembled, cfg, responses, *rest)

    def shuffled():  # bytes that are on disk
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [found.apply(i) for i in range(found.size())]
        return sum(f.length() for f in files if str(f.getName()).startswith("shuffle_"))

    monkeypatch.setattr(triage_stream, "decide", noted)
    events = spark.readStream.schema("msg_id long, event string").option("maxFilesPerTrigger", 2).json(str(told))
    out = str(tmp_path / "out")
    event_stream(events, CFG, lambda b, key: key, out, str(tmp_path / "c"), responses=lambda _: answers, run_ts=now()).awaitTermination()
    assert len(moved) == 2 and all(2 <= n < 100 for n in moved)
    assert read_output(spark, out, "triage").count() == 4
    kept = shuffled()
    responses = spark.range(3000).selectExpr("id as msg_id", "repeat(uuid(), 50) as body", "string(null) as error_code")
    mail = spark.range(3000).selectExpr("id as msg_id", "'a' reply_to", "'s' subject", "string(null) ticket_text", "string(null) error")
    write_outputs(decide_light(mail, CFG, responses), CFG, out, now(), "again", 0)
    until = time.time() + 20
    while shuffled() > kept + 10000 and time.time() < until:  # what the write has shuffled goes with it
        time.sleep(0.2)
    assert shuffled() <= kept + 10000


def test_late_responses_to_events(spark, responses, tmp_path):
    told = tmp_path / "events"
    told.mkdir()
    (tmp_path / "m1.eml").write_text(mail_of(1))
    known = [responses.where("false"), responses]

    def run(number):
        (told / f"{number}.json").write_text(json.dumps({"msg_id": 1 + 6 * number, "event": event(spark, "m1.eml")}))
        events = spark.readStream.schema("msg_id long, event string").json(str(told))
        event_stream(events, CFG, lambda b, key: F.concat(F.lit(f"{tmp_path}/"), key), str(tmp_path / "out"), str(tmp_path / "c"), responses=lambda _: known[number], run_ts=now(), wait=2).awaitTermination()
        return {r.msg_id: r.is_phishing for r in read_output(spark, str(tmp_path / "out"), "triage").collect()}

    assert run(0) == {}
    assert run(1) == {1: True, 7: True}


@pytest.fixture
def asked(tmp_path):
    """A scorer that notes whom it was asked about, one file each; it fails as told."""
    folder = tmp_path / "asked"
    folder.mkdir()

    def make(fails):
        def make_scorer(model_id):
            def score(request):
                import uuid

                if fails == "all after some" and len(list(folder.iterdir())) > 25:
                    raise KeyboardInterrupt  # the task dies
                if fails == "some" and int(request) % 3 == 0:
                    raise RuntimeError("no answer")
                if fails == "refused" and int(request) % 3 == 0:
                    problem = RuntimeError()
                    problem.service_code = "Busy"
                    raise problem
                (folder / f"{request}-{uuid.uuid4().hex}").touch()
                return f"answer {request}"

            return score

        return make_scorer

    return folder, make


def counts(folder):
    found: dict = {}
    for path in folder.iterdir():
        found[int(path.name.split("-")[0])] = found.get(int(path.name.split("-")[0]), 0) + 1
    return found


@pytest.mark.parametrize("in_flight", [1, 3])
def test_scoring_is_taken_up_again(spark, tmp_path, asked, in_flight):
    folder, make = asked
    requests = spark.createDataFrame([(i, str(i)) for i in [*range(60), 5, 5, 6]] + [(99, None)], "msg_id long, request string").repartition(3)
    ledger = str(tmp_path / "ledger")
    run = lambda fails, **more: score_once(requests, make(fails), ledger, buckets=4, flush=7, in_flight=in_flight, **more)
    with pytest.raises(Exception, match="KeyboardInterrupt"):
        run("all after some")
    done = counts(folder)
    assert 0 < len(done) < 60
    some = run("some")
    assert {r.msg_id for r in some.collect()} == {i for i in range(60) if i % 3 or i in done}
    refused = {r.msg_id: r.error_code for r in run("refused").collect() if r.body is None}
    assert refused == {i: "Busy" for i in range(60) if i % 3 == 0 and i not in done}
    final = run(None)
    assert sorted((r.msg_id, r.body) for r in final.collect()) == [(i, f"answer {i}") for i in range(60)]
    # No id is asked twice that got an answer; an answer that came in as its task died counts as none.
    assert set(counts(folder)) == set(range(60))
    assert all(n == 1 for i, n in counts(folder).items() if i not in done)
    assert sum(n - 1 for n in counts(folder).values()) <= 4 * in_flight
    before = counts(folder)
    run(None)
    assert counts(folder) == before


def test_the_ledger_is_not_shuffled(spark, tmp_path, asked):
    _, make = asked
    requests = spark.range(50).selectExpr("id as msg_id", "string(id) as request")
    ledger = str(tmp_path / "ledger")
    score_once(requests, make(None), ledger, buckets=3)
    shutil.rmtree(tmp_path / "ledger" / "bucket=0")  # its answers are asked for again, the others are not
    answers = score_once(requests, make(None), ledger, buckets=3)
    assert answers.count() == 50
    again = [i for i, n in counts(asked[0]).items() if n == 2]
    bucket = {r.msg_id: r.b for r in requests.selectExpr("msg_id", "pmod(xxhash64(msg_id), 3) as b").collect()}
    assert sorted(again) == sorted(i for i, b in bucket.items() if b == 0)
    scored = build_status(decide_with(spark, answers))
    assert scored.count() == 50


def decide_with(spark, answers):
    mail = spark.range(50).selectExpr("id as msg_id", "encode('Subject: x\n\ny', 'UTF-8') as content")
    return triage(mail, CFG, answers, unique=True)
