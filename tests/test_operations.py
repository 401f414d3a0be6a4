import json
import socket
import threading
from datetime import datetime as D
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import audit, lifecycle, operations, sinks, store, verdict
from inkwarden.operators import query as Q
from inkwarden.operators import rules as R
from inkwarden.sources import readers
from inkwarden.streaming import ingest

LINE = "job_id string, line_number int, page_number int, line_on_page int, lines_on_page int, text string, source string, confidence float"


def lines(spark, texts, job="j"):
    return spark.createDataFrame([(job, i, 1, i, len(texts), t, "native", None) for i, t in enumerate(texts)], LINE)


# --- verdicts ---


def test_every_job_has_a_verdict_and_doubt_is_quarantined(spark):
    df = lines(spark, ["mail a@b.com"]).union(lines(spark, ["  ", "\u00a0", None], "blank")).union(lines(spark, ["fine"], "bad"))
    facts = spark.createDataFrame(
        [("j", 1, 0, 0, False, None), ("silent", 2, 2, 0, False, None), ("bad", 1, 0, 0, True, None), ("part", 3, 1, 1, True, None),
         ("broken", None, None, None, True, "unreadable"), ("none", 0, 0, 0, None, None)],
        "job_id string, page_count int, ocr_page_count int, failed_page_count int, degraded boolean, error string",
    )
    got = {r.job_id: (r.disposition, r.reason) for r in verdict.assess(df, R.scan(df, list(R.DEFAULT_RULES), b"k"), facts).collect()}
    q = "quarantine"
    assert got == {
        "j": ("archive", None), "blank": (q, "no_text_extracted"), "silent": (q, "no_text_extracted"), "bad": (q, "degraded_extraction"),
        "part": (q, "degraded_extraction"), "broken": ("failed", "unreadable"), "none": ("archive", None),
    }
    lax = {r.job_id: r.disposition for r in verdict.assess(df, R.scan(df, list(R.DEFAULT_RULES), b"k"), facts, strict=False).collect()}
    assert lax["bad"] == lax["silent"] == "archive" and lax["broken"] == "failed"
    rows = verdict.assess(df, R.scan(df, list(R.DEFAULT_RULES), b"k"), facts)
    assert [r.job_id for r in verdict.failed_jobs(rows).collect()] == ["broken"]
    jobs = spark.createDataFrame([("j", D(2026, 1, 2), "s"), ("broken", D(2026, 1, 2), "s")], "job_id string, received_at timestamp, source_name string")
    one = verdict.index_rows(rows, jobs, "v", "2026-01-03 00:00:00").collect()
    assert [(r.job_id, r.archive_path, r.assessment_seq) for r in one] == [("j", "archive/dt=2026-01-02/j.pdf", 1)]
    assert tuple(one[0].asDict()) == verdict.INDEX_COLUMNS


def test_page_facts(spark):
    pages = [("j", 1, "native", 3, None), ("j", 1, "native", 3, None), ("j", 2, "blank", 0, None), ("j", 3, "ocr", 2, None), ("k", 1, "ocr", 0, None), ("m", 1, None, None, "boom"), ("n", 1, "mixed", 1, None)]
    got = {r.job_id: tuple(r)[1:] for r in verdict.page_facts(spark.createDataFrame(pages, "job_id string, page_number int, kind string, lines int, error string")).collect()}
    assert got == {"j": (3, 2, 0, 1, False), "k": (1, 1, 0, 0, True), "m": (1, 0, 1, 0, True), "n": (1, 1, 0, 0, False)}


def test_reassessment_never_launders_a_degraded_document(spark):
    df = lines(spark, ["plain"]).union(lines(spark, ["plain"], "k")).union(lines(spark, ["plain"], "m"))
    prior = spark.createDataFrame(
        [("j", 1, "quarantine", "degraded_extraction", 1, True), ("k", 1, "quarantine", "dlp_hit", 1, False), ("m", 3, "failed", "x", 1, False), ("gone", 1, "archive", None, 1, False)],
        "job_id string, assessment_seq int, disposition string, reason string, page_count int, degraded boolean",
    )
    fresh = verdict.assess(df, R.scan(df, list(R.DEFAULT_RULES), b"k"), lifecycle.carried_facts(prior.withColumn("ocr_page_count", F.lit(0)), df))
    prior = prior.withColumns({"hits": F.lit(None).cast(fresh.schema["hits"].dataType), "ruleset_version": F.lit("v"), "received_at": F.lit("2026-01-01").cast("timestamp"),
                               "release_pending": F.lit(None).cast("boolean"), "archive_path": F.lit("quarantine/x.pdf"), "source_name": F.lit("s")})
    got = {r.job_id: (r.direction, r.new_disposition) for r in lifecycle.reassess(prior, fresh, "v").collect()}
    assert got == {"j": ("unchanged", "quarantine"), "k": ("deescalate", "archive"), "m": ("changed", "archive"), "gone": ("content_unavailable", None)}
    rows = {r.job_id: r for r in lifecycle.reassessment_rows(lifecycle.reassess(prior, fresh, "v"), "v", "2026-02-01").collect()}
    assert set(rows) == {"k", "m"} and rows["k"].release_pending and rows["m"].assessment_seq == 4 and rows["k"].degraded is False
    good, refused = lifecycle.guarded(spark.createDataFrame([("k", 1), ("m", 2)], "job_id string, supersedes_seq int"), prior)
    assert [r.job_id for r in good.collect()] == ["k"] and [r.job_id for r in refused.collect()] == ["m"]
    failed = fresh.withColumn("disposition", F.lit("failed"))
    assert {r.direction for r in lifecycle.reassess(prior, failed, "v").collect()} == {"error", "content_unavailable"}
    again = lifecycle.reassess(prior.withColumn("disposition", F.lit("archive")), fresh.withColumns({"disposition": F.lit("archive"), "degraded": F.lit(None).cast("boolean")}), "v", "extract")
    assert {r.direction for r in again.collect()} == {"changed", "content_unavailable"}


def test_rule_budget_makes_the_job_fail(spark):
    bad = R.Rule("slow", r"(a|aa)+$", budget=0.3)
    df = lines(spark, ["a" * 3000 + "b"] * 40).union(lines(spark, ["xaa", "Password: hunter22"], "k"))
    rules = [bad, next(r for r in R.DEFAULT_RULES if r.id == "cred.password_assignment"), R.Rule("wide", r"aa\nPass", scope="document", budget=5)]
    hits, failures = R.scan_with_failures(df, rules, b"k")
    assert {(r.job_id, r.error) for r in failures.collect()} == {("j", "rule slow exceeded its time budget")}
    assert {(r.job_id, r.rule_id, r.line_number, r.start, r.end) for r in hits.collect() if r.job_id == "k"} == {
        ("k", "slow", 0, 1, 3), ("k", "cred.password_assignment", 1, 0, 18), ("k", "wide", 0, 1, 8)}
    got = {r.job_id: (r.disposition, r.reason) for r in verdict.assess(df, hits, failures).collect()}
    assert got == {"j": ("failed", "rule slow exceeded its time budget"), "k": ("quarantine", "dlp_hit")}
    assert R.ruleset_version([bad]) == R.ruleset_version([R.Rule("slow", r"(a|aa)+$")])


# --- ingest ---


def test_documents_without_text_are_not_lost(spark, tmp_path):
    rows = [(1, None, "s", D(2026, 1, 1)), (2, None, "s", D(2026, 1, 1)), (3, "", "s", D(2026, 1, 1)), (4, " \n ", "s", D(2026, 1, 1)), (5, "x", "s", D(2026, 1, 1))]
    work = ingest.ingest_batch(str(tmp_path), list(R.DEFAULT_RULES), b"k")
    df = spark.createDataFrame(rows, ingest.ARRIVAL)
    work(df, 0)
    work(df.withColumn("content", F.lit(None).cast("binary")), 1)
    got = spark.read.parquet(f"{tmp_path}/assessments").collect()
    assert sorted((r.disposition, r.reason or "") for r in got) == [("archive", "")] + [("quarantine", "no_text_extracted")] * 4
    status = {(r.batch, r.doc_id): r.status for r in spark.read.parquet(f"{tmp_path}/receipts").collect()}
    assert {s for (b, _), s in status.items() if b == 0} == {"completed"} and {s for (b, _), s in status.items() if b == 1} == {"duplicate"}


def test_settling_step_by_step(spark):
    state = spark.createDataFrame([], "path string, size long, since int, taken boolean")
    ready = []
    polls = [[("a.pdf", 5), ("b.pdf", 1)], [("a.pdf", 5), ("b.pdf", 2)], [("a.pdf", 5), ("b.pdf", 2)], [("b.pdf", 2)], [("a.pdf", 5)], [("a.pdf", 5)]]
    for n, seen in enumerate(polls, 1):
        now = spark.createDataFrame([(n, *x) for x in seen], "poll int, path string, size long")
        state = spark.createDataFrame(ingest.settle_step(state, now).collect(), ingest.settle_step(state, now).schema)
        ready.append([r.path for r in state.where("ready").collect()])
    assert ready == [[], ["a.pdf"], ["b.pdf"], [], [], ["a.pdf"]]


def test_receipt_status_and_failures_after_a_success(spark):
    r = spark.createDataFrame([("a", "received"), ("a", "received"), ("b", "received")], "receipt_id string, status string")
    u = spark.createDataFrame([("a", "failed", 1), ("a", "completed", 2)], "receipt_id string, status string, at int")
    assert {(x.receipt_id, x.status) for x in ingest.receipt_status(r, u).collect()} == {("a", "completed"), ("b", "received")}
    rows = [("k", D(2026, 1, 1, 0, 0, s), ok) for s, ok in ((0, False), (1, False), (2, True), (3, False), (4, None))]
    got = ingest.failure_window(spark.createDataFrame(rows, "key string, ts timestamp, ok boolean"), 60).orderBy("ts").collect()
    assert [x.recent for x in got] == [1, 2, 0, 1, 2]


# --- work in progress ---


def steps(spark, rows):
    return spark.createDataFrame(rows, "job_id string, step string")


def test_steps_resume_and_snapshots(spark):
    s = steps(spark, [("a", "assessed"), ("a", "pdf"), ("a", "pdf"), ("b", "emit_started"), ("c", "odd"), *[("d", x) for x in operations.STEPS]])
    got = {r.job_id: (r.done, r.next_step, r.uncertain) for r in operations.progress(s).collect()}
    assert got["a"] == (["assessed", "pdf"], "audit_started", False) and got["b"][2] and got["d"] == (list(operations.STEPS), None, False) and "c" not in got
    staged = spark.createDataFrame([(j, D(2026, 1, 1)) for j in "abde"] + [("f", D(2026, 1, 2))], "job_id string, staged_at timestamp")
    assert {(r.job_id, r.next_step) for r in operations.to_resume(staged, s, "2026-01-02 00:00:30", 60).collect()} == {("a", "audit_started"), ("e", "assessed")}
    v = lambda rows: spark.createDataFrame(rows, "job_id string, disposition string")
    kept = operations.recovered_verdicts(staged, v([("a", "quarantine"), ("x", "archive")]), v([("a", "archive"), ("e", "archive"), ("y", "archive")]))
    assert {(r.job_id, r.disposition) for r in kept.collect()} == {("a", "quarantine"), ("e", "archive")}


def test_failed_queue(spark):
    item = "job_id string, filename string, reason string, received_at timestamp"
    failed = spark.createDataFrame([("f" * 32, "a.pdf", "encrypted", D(2026, 1, 1)), ("e" * 32, None, None, D(2026, 1, 3))], item)
    staged = spark.createDataFrame([("d" * 32, "c.pdf", None, D(2026, 1, 2))], item)
    s = steps(spark, [("d" * 32, "emit_started")])
    none = spark.createDataFrame([], "job_id string, kind string, action string, at timestamp")
    items = operations.queue(failed, staged, s, none)
    page = operations.queue_page(items, size=2).collect()
    assert [r.job_id[0] for r in page] == ["e", "d", "f"] and page[1].uncertain and page[1].reason == "Delivery outcome uncertain" and page[0].filename == "e" * 12
    asked = spark.createDataFrame(
        [("f" * 32, "failed", "resolve", "done", "me", None), ("e" * 32, "failed", "retry", " ", "me", None), ("d" * 32, "staged", "retry", "again", "me", None), ("x", "failed", "retry", "r", "me", None)],
        "job_id string, kind string, action string, reason string, actor string, confirmed boolean",
    )
    good, refused = operations.decide(items, asked, "2026-02-01 00:00:00")
    assert [r.job_id[0] for r in good.collect()] == ["f"] and {r.job_id[0]: r.why for r in refused.collect()} == {
        "e": "a reason is required", "d": "confirm possible duplicate delivery", "x": "not in the queue"}
    assert [r.event for r in operations.decision_events(good).collect()] == ["job.failure_resolved"]
    left = operations.queue(failed, staged, s, good.select("job_id", "kind", "action", "at"))
    assert {r.job_id[0] for r in left.collect()} == {"e", "d"} and operations.queue(failed, staged, s, good.select("job_id", "kind", "action", "at"), True).count() == 1
    assert operations.decide(items, asked.withColumn("confirmed", F.lit(True)), "2026-02-01 00:00:00")[0].count() == 2
    assert {(r.kind, r["items"], r.uncertain) for r in operations.queue_counts(items).collect()} == {("failed", 2, 0), ("staged", 1, 1)}


def test_transitions_are_taken_up_after_a_crash(spark, tmp_path):
    root = str(tmp_path)
    row = lambda n: spark.createDataFrame([("j", n)], "job_id string, assessment_seq int")
    event = spark.createDataFrame([("j", "job.reassessed")], "job_id string, event string")
    held = row(1)
    for n, stop in ((2, None), (3, "journal"), (4, "events")):
        operations.commit_transition(root, n, row(n), held, event, stop)
    assert operations.recover_transitions(spark, root) == [3, 4] and operations.recover_transitions(spark, root) == []
    assert sorted(r.assessment_seq for r in spark.read.parquet(f"{root}/assessments").collect()) == [2, 3, 4]
    assert spark.read.parquet(f"{root}/events").count() == 3
    assert operations.recover_transitions(spark, str(tmp_path / "none")) == []


def test_purge_tells_before_and_after(spark, tmp_path):
    root, docs = str(tmp_path / "c"), tmp_path / "archive"
    spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-01")], "job_id string, dt string").write.partitionBy("dt").parquet(root)
    docs.mkdir()
    (docs / "a.pdf").write_text("x")
    told = []
    jobs = spark.createDataFrame([("a",), ("z",), ("a",)], "job_id string")
    for _ in range(2):
        got = {r.job_id: (r.content_removed, r.document_removed) for r in operations.purge(spark.read.parquet(root), root, jobs, "asked", "me", "2026-01-05T00:00:00Z", told.append, [str(docs)]).collect()}
    assert [[e["event"] for e in x] for x in told] == [["purge.started"] * 2, ["content.purged"] * 2] * 2
    assert told[1][0]["content_removed"] and told[1][0]["document_removed"] and told[1][0]["mode"] == "hard" and got == {"a": (False, False), "z": (False, False)}
    assert [r.job_id for r in spark.read.parquet(root).collect()] == ["b"] and not (docs / "a.pdf").exists()
    with pytest.raises(ValueError):
        operations.purge(spark.read.parquet(root), root, jobs, " ", "me", "t", told.append)


# --- the log ---


def test_stored_log_redaction_and_checkpoint(spark, tmp_path):
    root = str(tmp_path / "log")
    events = [{"ts": f"2026-01-0{1 + i // 2}T00:00:00Z", "event": "e", "job_id": "j", "note": "secret", "n": i} for i in range(6)]
    audit.append(spark, audit.read_log(spark, root), events[:4], root)
    audit.append(spark, audit.read_log(spark, root), events[4:], root)
    log = lambda: audit.read_log(spark, root)
    assert audit.chain_verdict(log()) == {"ok": True, "breaks": 0, "redactions": 0} and audit.head_of(log())[0] == 6
    audit.redact_log(spark, root, 3, ["note"], "asked", "me", "2026-01-04T00:00:00Z")
    audit.redact_log(spark, root, 3, ["n"], "asked", "me", "2026-01-04T00:00:00Z")
    assert audit.chain_verdict(log()) == {"ok": True, "breaks": 0, "redactions": 1}
    assert [r.fields for r in audit.redactions(log()).collect()] == [["n", "note"]]
    assert "secret" not in audit.event_at(log(), 3).first().raw and audit.event_at(log(), 99).count() == 0
    for seq, names in ((3, ["hash"]), (3, ["none"]), (99, ["note"]), (7, ["fields"]), (1, [])):
        with pytest.raises(ValueError):
            audit.redact_log(spark, root, seq, names, "r", "me", "2026-01-04T00:00:00Z")
    at = str(tmp_path / "checkpoint.json")
    first = audit.write_trim_checkpoint(spark, log(), "2026-01-03", at)
    assert first["seq"] == 4 and audit.write_trim_checkpoint(spark, log(), "2026-01-02", at) == first == audit.read_checkpoint(spark, at)
    assert audit.verify(log().where("dt >= '2026-01-03'"), checkpoint=first["hash"]).count() == 0
    assert audit.head_of(log().where("dt < '2020-01-01'"), first) == (4, first["hash"])


# --- deliveries ---


def test_transports():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        sinks.Syslog("127.0.0.1", s.getsockname()[1])("j", "hello é")
        assert s.recv(100).decode() == "hello é"
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["X-Inkwarden-Signature"], self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response({"/ok": 204, "/bad": 500}.get(self.path, 302))
            self.send_header("Location", "/ok")
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    sinks.Webhook(url + "/ok", b"k")("j", "{}")
    assert seen == [("/ok", sinks.signature(b"{}", b"k"), b"{}")]
    for path in ("/bad", "/moved"):
        with pytest.raises(Exception):  # noqa: B017
            sinks.Webhook(url + path)("j", "{}")
    assert len(seen) == 3  # the redirect was not followed
    server.shutdown()
    with pytest.raises(ValueError):
        sinks.Webhook("file:///etc/passwd")


def test_sent_once_spooled_and_replayed_in_order(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(j, "{}") for j in "abc"], "job_id string, body string")
    sent, down = [], {"b", "c"}

    def send(job, body):
        if job in down:
            raise OSError("down")
        sent.append(job)

    assert sinks.deliver_once(rows, send, root, 0, "2026-01-01 00:00:00") == 1 and sinks.deliver_once(rows, send, root, 0, "2026-01-01 00:00:00") == 0
    assert sent == ["a"] and [r.job_id for r in sinks.spooled(spark, root).collect()] == ["b", "c"]
    down.remove("b")
    assert sinks.replay_spool(spark, root, send) == ["b"] and [r.job_id for r in sinks.spooled(spark, root).collect()] == ["c"]
    down.clear()
    assert sinks.replay_spool(spark, root, send) == ["c"] and sinks.spooled(spark, root).count() == 0 and sinks.replay_spool(spark, root, send) == []
    log = spark.read.parquet(*[f"{root}/emit_log/batch=0-{x}" for x in ("begun", "ended")])
    ready, open_ = ingest.emit_once(rows, log)
    assert ready.count() == 0 and open_.count() == 0
    assert ingest.emit_once(rows, log.where("state = 'emit_started'"))[1].count() == 3


def test_ladder_with_hits(spark):
    hits = [{"rule_id": "r", "masked_text": "•" * 200}] * 3
    df = spark.createDataFrame([("j", D(2026, 1, 1), "archive", 3, hits, "m" * 200)], "job_id string, received_at timestamp, disposition string, hit_count int, hits array<struct<rule_id:string,masked_text:string>>, metadata string")
    body = lambda most: json.loads(sinks.syslog_message(df, "h", most=most).first().message.split(" - job.completed - ")[1])
    assert len(body(8000)["hits"]) == 3 and "hits_truncated" not in body(8000)
    assert body(900)["hits"] == [] and body(900)["hits_truncated"] and body(900)["metadata"]
    assert "metadata" not in body(100) and body(100)["metadata_truncated"] and body(100)["hit_count"] == 3


def test_plugins(spark):
    rows = spark.createDataFrame([("a",), (None,)], "k string")
    work = sinks.load_plugin("static_enrich", {"mapping": {"a": "1"}, "key": "k", "to": "v"})
    assert [r.v for r in work(rows).collect()] == ["1", None]
    many = {f"k{i}": str(i) for i in range(3000)} | {"a": "1"}
    assert {r.k: r.v for r in sinks.enrich(rows, many, "k", "v").collect()} == {"a": "1", None: None}
    assert sinks.load_plugin("json.dumps", {"obj": 1}) == "1"
    for name, settings in (("nothing", {}), ("syslog", {"host": "h", "odd": 1}), ("syslog", {"host": "h", "protocol": "x"})):
        with pytest.raises(ValueError):
            sinks.load_plugin(name, settings)
    late = sinks.Stage("late", lambda df: df.select(F.raise_error(F.lit("boom")).alias("x")))
    kept, events = sinks.run_stages(rows, [late])
    assert kept.count() == 2 and events[0]["plugin"] == "late"
    with pytest.raises(Exception):  # noqa: B017
        sinks.run_stages(rows, [sinks.Stage("late", late.work, critical=True)])


# --- queries ---


def test_reveal_tails_and_wrapped_values(spark):
    df = lines(spark, ["card 4111111111111111 x", "see AB 12", "34 56 C end", None])
    rows = [(1, "j", 0, 5, 21, "••••••••••••1111"), (2, "j", 1, 4, 17, "•••••••••"), (3, "j", 0, 0, 4, "••"), (4, "j", 9, 0, 1, "•"), (5, "j", 0, 0, 4, None)]
    hits = spark.createDataFrame(rows, "hit_id long, job_id string, line_number int, match_start int, match_end int, masked_text string")
    assert {r.hit_id: r.revealed for r in lifecycle.reveal(hits, df).collect()} == {1: "4111111111111111", 2: "AB 12\n34 56 C", 3: None, 5: None}


def test_small_query_functions(spark):
    assert Q.audit_terms("x y", "plain", b"k") == {"query": "x y"} and len(Q.audit_terms("x y", "hashed", b"k")["terms_hmac"]) == 32
    assert Q.actor("ann", True, b"k") == {"actor": "ann"} and Q.actor("pw", False, b"k")["actor"] is None
    df = spark.createDataFrame([("a" * 32, ["r"], "s"), ("b" * 32, ["q"], "t")], "job_id string, rule_ids array<string>, snippet string")
    assert Q.visible(df, ["viewer"]).first().rule_ids is None and Q.visible(df, ["auditor"]).first().rule_ids == ["r"]
    assert Q.of_jobs(df, ["a" * 32]).count() == 1
    for bad in (lambda: Q.of_jobs(df, ["x"]), lambda: Q.between_days("t", "soon", None), lambda: operations.queue_page(df, -1)):
        with pytest.raises(ValueError):
            bad()
    assert Q.rules_listing(spark, R.DEFAULT_RULES).count() == 15
    assert readers.parser("odd") is readers.parse_nothing and df.select(readers.parser(None)(F.col("snippet")).alias("m")).first().m == {}


def test_date_filter_reaches_the_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", D(2026, 1, 1, 5), "2026-01-01"), ("b", D(2026, 1, 2, 5), "2026-01-02")], "job_id string, received_at timestamp, dt string")
    df.write.partitionBy("dt").parquet(str(tmp_path / "t"))
    held = spark.read.parquet(str(tmp_path / "t"))
    out = store.latest(held.withColumn("assessment_seq", F.lit(1)), "dt").where(Q.between_days("received_at", "2026-01-02", None, "dt"))
    assert [r.job_id for r in out.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(dt" in out._jdf.queryExecution().toString()
