import json
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import audit, lifecycle, sinks, store
from inkwarden.operators import query as Q
from inkwarden.sources import readers
from inkwarden.streaming import ingest

JOBS = "job_id string, received_at timestamp, assessed_at timestamp, assessment_seq int, ruleset_version string, source_name string, disposition string, reason string, highest_severity string, hit_count int, release_pending boolean, rule_ids array<string>, archive_path string"


def job(n, day, seq=None, disposition="archive", severity=None, hits=0, pending=None, rules=(), source="s"):
    return (str(n) * 32, D(2026, 1, day, 12), None, seq, "v", source, disposition, None, severity, hits, pending, list(rules), f"{disposition}/x.pdf")


def assessments(spark, rows):
    return spark.createDataFrame(rows, JOBS)


def test_latest_tolerates_null_seq(spark):
    df = assessments(spark, [job(1, 1), job(2, 1, 1), job(2, 1, 2, "quarantine"), job(2, 1, None)])
    assert {(r.job_id[0], r.disposition) for r in store.latest(df).collect()} == {("1", "archive"), ("2", "quarantine")}


def test_filters_never_bring_back_an_older_row(spark):
    df = store.latest(assessments(spark, [job(1, 1, 1, "quarantine", "HIGH", 1), job(1, 1, 2, "archive", None, 0, True)]))
    assert Q.jobs(df, Q.Filters(disposition="quarantine")).count() == 0
    assert Q.jobs(df, Q.Filters(pending=True)).count() == 1
    assert Q.jobs(df, Q.Filters(flagged=True)).count() == 0
    with pytest.raises(ValueError):
        Q.Filters(disposition="failed")


def test_search(spark):
    content = spark.createDataFrame(
        [("1" * 32, "The quarterly\nroadmap 50%"), ("2" * 32, "card É.* here"), ("3" * 32, None), ("4" * 32, "roadmap")], "job_id string, full_text string"
    )
    now = store.latest(assessments(spark, [job(1, 10), job(2, 15, 1, "quarantine", "HIGH", 1), job(3, 3)]))
    ask = lambda q, **kw: [r.job_id[0] for r in Q.search(content, now, q, **kw).collect()]
    assert ask('"quarterly roadmap"') == ["1"] and ask("50%") == ["1"] and ask("é.*") == ["2"] and ask("c.rd") == []
    assert ask("roadmap -quarterly") == [] and ask("card", start="2026-01-16") == []
    for bad in ("", "-x", " ".join("abcdefghijk"), "x" * 257):
        with pytest.raises(ValueError):
            Q.parse_query(bad)


def test_append_is_exclusive_and_purge_is_repeatable(spark):
    held = assessments(spark, [job(1, 1, 1)])
    assert store.new_rows(assessments(spark, [job(1, 1, 1), job(1, 1, 2), job(1, 1, 2)]), held).count() == 1
    content = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, x int")
    once = store.purged(content, content.where("x = 1"))
    assert [r.job_id for r in store.purged(once, content.where("x = 1")).collect()] == ["b"]


def test_rewrite_of_days(spark, tmp_path):
    root = str(tmp_path / "c")
    spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-01"), ("c", "2026-01-02")], "job_id string, dt string").write.partitionBy("dt").parquet(root)
    content = spark.read.parquet(root)
    store.rewrite_days(content, spark.createDataFrame([("a",), ("c",)], "job_id string"), root)
    assert [r.job_id for r in spark.read.parquet(root).collect()] == ["b"]


def test_retention_is_strict(spark):
    days = spark.createDataFrame([("x", "2025-12-31"), ("x", "2026-01-01"), ("x", "odd"), ("y", "2020-01-01")], "store string, dt string")
    assert [r.dt for r in store.retention_plan(days, "2026-01-31", {"x": 30}).collect()] == ["2025-12-31"]


def test_missing_and_older_tables(spark, tmp_path):
    assert readers.index_store(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("a",)], "job_id string").write.parquet(str(tmp_path / "old"))
    row = readers.table_or_empty(spark, str(tmp_path / "old"), readers.INDEX_SCHEMA).first()
    assert row.job_id == "a" and row.release_pending is None


def log_of(spark, records, day="2026-01-01"):
    return spark.createDataFrame([(day, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "dt string, line_no long, raw string")


def test_chain(spark):
    events = [{"ts": f"2026-01-01T00:00:0{i}Z", "event": "e", "job_id": "j", "note": "é"} for i in range(5)]
    good = audit.chained(events)
    problems = lambda rows, **kw: sorted((r.line_no, r.problem) for r in audit.verify(log_of(spark, rows), **kw).collect())
    assert problems(good) == []
    changed = [dict(r) for r in good]
    changed[2]["note"] = "x"
    assert problems(changed) == [(2, "altered")]
    assert problems(good[:2] + good[3:]) == [(2, "unlinked")]
    assert problems([*good, '{"seq": 6, "torn']) == [(5, "unreadable")]
    assert problems(good[2:]) == [(0, "unlinked")] and problems(good[2:], checkpoint=good[1]["hash"]) == []
    *rows, event = audit.redact(good, 3, ["note"], "2026-01-01T00:01:00Z")
    rows += audit.chained([event], 5, rows[-1]["hash"])
    assert problems(rows) == [] and problems(rows, redactions_allowed=False) == [(2, "altered")]
    with pytest.raises(ValueError):
        audit.redact(good, 3, ["note", "hash"], "t")
    widened = [dict(r) for r in rows]
    widened[2]["ts"] = audit.BLANK
    assert problems(widened) == [(2, "altered")]
    unexplained = [dict(r) for r in good]
    unexplained[1]["note"] = audit.BLANK
    assert problems(unexplained) == [(1, "altered")]


def test_chain_goes_on_over_days(spark):
    good = audit.chained([{"ts": f"2026-01-0{1 + i // 2}", "event": "e"} for i in range(4)])
    log = log_of(spark, good[:2]).unionByName(log_of(spark, good[2:], "2026-01-02"))
    assert audit.verify(log).count() == 0
    assert audit.trim_checkpoint(log, "2026-01-02") == {"seq": 2, "hash": good[1]["hash"]}
    assert [r.seq for r in audit.page(log, before=4, limit=1).collect()] == [3, 2]


def test_release_and_reassessment(spark):
    now = assessments(spark, [job(1, 1, 2, pending=True), job(2, 1, 1)])
    rows, refused = lifecycle.release(now, now.select("job_id").union(spark.createDataFrame([("9" * 32,)], "job_id string")), "2026-02-01")
    assert [(r.assessment_seq, r.release_pending, r.reason) for r in rows.collect()] == [(3, False, "released")]
    assert {(r.job_id[0], r.why) for r in refused.collect()} == {("2", "not pending"), ("9", "unknown")}
    prior = assessments(spark, [job(1, 1, 1, "quarantine"), job(2, 1, 1), job(3, 1, 1), job(4, 1, 1)]).withColumn("hits", F.col("rule_ids"))
    fresh = prior.where("job_id <> '" + "4" * 32 + "'").withColumn("disposition", F.when(F.col("job_id").startswith("3"), "quarantine").otherwise("archive"))
    got = lifecycle.reassess(prior, fresh, "v")
    assert {(r.job_id[0], r.direction) for r in got.collect()} == {("1", "deescalate"), ("2", "unchanged"), ("3", "escalate"), ("4", "content_unavailable")}
    assert {r.direction for r in lifecycle.reassess(prior, prior, "other").collect()} == {"changed"}
    new = {r.job_id[0]: r for r in lifecycle.reassessment_rows(got, "v", "2026-02-01").collect()}
    assert new["1"].release_pending and new["3"].archive_path == "quarantine/x.pdf" and set(new) == {"1", "3"}


def test_companions(spark):
    df = spark.createDataFrame([("a = 1\nb: x=y\nbad\n a=2 ", '{"d": {"id": "7"}, "k": 1}', "<!DOCTYPE x><m/>")], "t string, j string, x string")
    row = df.select(
        readers.parse_key_values(F.col("t")).alias("t"), readers.allowlisted(F.col("j"), ["d.id", "none"]).alias("j"),
        readers.parse_xml(F.col("x"), "a string").alias("x"), F.try_variant_get(readers.parse_json(F.lit("5")), "$.value", "int").alias("v"),
    ).first()
    pair = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), ({"a": "1"}, None)], "d map<string,string>, c map<string,string>")
    assert [r.m for r in pair.select(readers.merged_metadata(F.col("d"), F.col("c")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {"a": "1"}]
    assert row.t == {"a": "2", "b: x": "y"} and row.j == {"d.id": "7"} and row.x is None and row.v == 5


def test_sniff(spark):
    heads = [b"%PDF-1.7", b"junk %PDF-", b"\x89PNG\r\n\x1a\n..", b"\xff\xd8\xff\xe0", b"II*\0", b"text", b""]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, c binary")
    assert [r.s for r in df.orderBy("i").select(readers.sniff(F.col("c")).alias("s")).collect()] == ["pdf", "pdf", "png", "jpeg", "tiff", None, None]


def test_extraction_failure_is_a_row(spark):
    def read(data):
        if not data:
            raise ValueError("empty")
        return [(1, x, "native", None) for x in data.decode().split("\n")]

    df = spark.createDataFrame([("a", bytearray(b"x\ny")), ("b", bytearray())], "job_id string, content binary")
    rows = readers.extract_lines(df, read).collect()
    assert sorted((r.job_id, r.line_number, r.error) for r in rows if r.job_id == "a") == [("a", 0, None), ("a", 1, None)]
    assert [r.error for r in rows if r.job_id == "b"] == ["empty"]


def test_sinks(spark):
    rows = assessments(spark, [job(1, 1, 1, rules=["r" * 50] * 3), job(2, 1, 1)])
    sent = sinks.syslog_message(rows, "h", most=250).collect()
    assert all("hits_truncated" in r.message and json.loads(r.message[r.message.index("{") :]) for r in sent)
    assert not any("truncated" in r.message for r in sinks.syslog_message(rows, "h").collect())

    def send(job, body):
        if job.startswith("2"):
            raise OSError("down")

    got = {r.job_id[0]: r.delivered for r in sinks.deliver(sinks.payload(rows), send).collect()}
    assert got == {"1": True, "2": False}
    spool = [{"job_id": "1", "message": "{}"}, {"job_id": "x", "message": "bad"}, {"job_id": "2", "message": "{}"}, {"job_id": "3", "message": "{}"}]
    assert sinks.replay(spool, send) == (["1"], spool[2:])
    _, events = sinks.run_stages(rows, [sinks.Stage("p", lambda df: df.select("none"))])
    assert events[0]["event"] == "plugin.failed"


def test_stream_takes_each_document_once(spark, tmp_path):
    from inkwarden.operators.rules import DEFAULT_RULES

    a, root = str(tmp_path / "in"), str(tmp_path / "store")
    put = lambda rows: spark.createDataFrame(rows, ingest.ARRIVAL).coalesce(1).write.mode("append").parquet(a)
    run = lambda: ingest.ingest_available(ingest.read_arrivals(spark, a), root, str(tmp_path / "cp"), list(DEFAULT_RULES), b"k")
    put([(1, "x", "s", D(2026, 1, 1)), (2, "x", "s", D(2026, 1, 2)), (3, "Password: hunter22", "s", D(2026, 1, 1))])
    run()
    run()
    put([(4, "x", "s", D(2026, 1, 3))])
    run()
    assert spark.read.parquet(f"{root}/assessments").count() == 2
    assert {(r.doc_id, r.status) for r in spark.read.parquet(f"{root}/receipts").collect()} == {(1, "completed"), (2, "duplicate"), (3, "completed"), (4, "duplicate")}


def test_settled_files(spark):
    seen = [(1, "a.pdf", 5), (2, "a.pdf", 5), (1, "b.pdf", 1), (2, "b.pdf", 2), (2, "c.pdf", 9), (1, "gone.pdf", 3)]
    df = spark.createDataFrame(seen, "poll int, path string, size long")
    assert [r.path for r in ingest.settled(df).collect()] == ["a.pdf"]
    assert ingest.settled(df, grace=1).count() == 0
    with_companion = df.union(spark.createDataFrame([(2, "a.xml", 1)], df.schema))
    assert [r.path for r in ingest.settled(with_companion, grace=1).collect()] == ["a.pdf"]


def test_permissions(spark):
    assert Q.allowed(["viewer"], "jobs.list") and not Q.allowed(["viewer"], "jobs.purge") and len(Q.PERMISSIONS) == 16
    assert Q.allowed(["dlp_admin"], "dlp.reveal") and not Q.allowed(["investigator", "auditor"], "dlp.reveal")
    with pytest.raises(ValueError):
        Q.allowed(["viewer"], "odd")
    df = spark.createDataFrame([("archive", None, "archive/x", "s"), ("archive", True, "archive/x", "s"), (None, None, None, "s")], "disposition string, release_pending boolean, archive_path string, snippet string")
    assert [r.snippet for r in Q.withheld(df, False).collect()] == ["s", "", ""]
