"""Queries of reassessment, release, retention, audit and ingest over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarden.operators import audit, layout, lifecycle, operations, sinks, store, verdict
from inkwarden.operators import query as Q
from inkwarden.operators import rules as R
from inkwarden.plans.document_queries import (
    ASSESS, AT, CURRENT, DEFAULT, HITS, KEY, RECEIPTS, SQL_VERDICTS, assessments_of, at_text, current, facts_of, hits_of, lines_of, receipts_of,
)
from inkwarden.session import fresh_path, materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _as_verdict(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", "disposition", "hit_count", "highest_severity", "rule_ids", F.col("rule_ids").alias("hits"))


@query(f"""with {ASSESS}, o as (select * from a where assessment_seq = 1), n as (select * from a where assessment_seq = 2)
       select o.job_id, case when n.job_id is null then 'content_unavailable' when o.disposition <> 'quarantine' and n.disposition = 'quarantine' then 'escalate'
         when n.disposition = 'failed' then 'error' when o.disposition = 'quarantine' and n.disposition <> 'quarantine' then 'deescalate'
         when o.disposition = n.disposition and o.rule_ids = n.rule_ids and o.ruleset_version = '2db69c854606' then 'unchanged' else 'changed' end as direction
       from o left join n using (job_id)""")  # fmt: skip
def reassess_directions(spark: SparkSession, d: str) -> DataFrame:
    """First assessments beside second ones: the direction each would be given."""
    rows = assessments_of(spark, d)
    prior = rows.where("assessment_seq = 1").withColumn("hits", F.col("rule_ids"))
    return lifecycle.reassess(prior, _as_verdict(rows.where("assessment_seq = 2")), "2db69c854606").select("job_id", "direction")


@query(f"""with {ASSESS}, o as (select * from a where assessment_seq = 1), n as (select * from a where assessment_seq = 2)
       select case when n.job_id is null then 'content_unavailable' when o.disposition <> 'quarantine' and n.disposition = 'quarantine' then 'escalate'
         when n.disposition = 'failed' then 'error' when o.disposition = 'quarantine' and n.disposition <> 'quarantine' then 'deescalate'
         when o.disposition = n.disposition and o.rule_ids = n.rule_ids and o.ruleset_version = '2db69c854606' then 'unchanged' else 'changed' end as direction,
         count(*) as jobs from o left join n using (job_id) group by 1""")  # fmt: skip
def reassess_summary(spark, d):
    return reassess_directions(spark, d).groupBy("direction").agg(F.count(F.lit(1)).alias("jobs"))


_CARRIED = """m as (select c.job_id, c.assessment_seq, c.disposition as old, c.release_pending, v.hit_count, v.highest_severity,
      case when c.reason = 'degraded_extraction' or c.degraded or (c.page_count > 0 and v.written = 0) or v.q > 0 then 'quarantine' else 'archive' end as new
      from c join (select v.*, verdicts.highest_severity from v join verdicts using (job_id)) v using (job_id) where c.job_id in (select job_id from job_contexts where full_text is not null)),
    d as (select *, case when old <> 'quarantine' and new = 'quarantine' then 'escalate' when old = 'quarantine' and new <> 'quarantine' then 'deescalate' else 'changed' end as direction from m)"""


@query(f"""with {SQL_VERDICTS}, {CURRENT}, {_CARRIED} select job_id, assessment_seq + 1 as assessment_seq, new as disposition, 'reprocessed:' || direction as reason,
       new = 'archive' and (direction = 'deescalate' or coalesce(release_pending, false)) as release_pending, hit_count, highest_severity from d""")
def reassess_by_rules(spark, d):
    """Current assessments against today's default rules run over the held text: the rows a commit would append. The hits
    on record are those of dlp_hits; degradation is carried forward."""
    lines, now = lines_of(spark, d), current(spark, d)
    held = table(spark, d, "job_contexts").where("full_text IS NOT NULL").select("job_id")
    fresh = verdict.assess(lines, R.scan(lines, DEFAULT, KEY), lifecycle.carried_facts(now, held)).join(held.distinct(), "job_id", "left_semi")
    old = hits_of(spark, d).withColumnsRenamed({"match_start": "start", "match_end": "end"}).withColumn("rule_pos", F.lit(0))
    rolled = verdict.rollup(old.join(now.select("job_id", "assessment_seq"), ["job_id", "assessment_seq"], "left_semi")).select("job_id", "hits")
    version = R.ruleset_version(R.DEFAULT_RULES)
    rows = lifecycle.reassessment_rows(lifecycle.reassess(now.join(rolled, "job_id", "left"), fresh, version), version, "2026-03-31 12:00:00")
    return rows.select("job_id", "assessment_seq", "disposition", "reason", "release_pending", "hit_count", "highest_severity")


@query(f"""with {SQL_VERDICTS}, w as (select job_id, count(*) as n, count(*) filter (where action = 'quarantine') as q from hits where rule_id not in ('pii.email', 'us.ssn') group by 1),
       n as (select v.job_id, v.disposition as old, v.hit_count, coalesce(w.n, 0) as n,
             case when v.disposition = 'failed' then 'failed' when v.reason in ('no_text_extracted', 'degraded_extraction') or coalesce(w.q, 0) > 0 then 'quarantine' else 'archive' end as new
             from verdicts v left join w using (job_id))
       select job_id, case when new = 'failed' then 'error' when old <> 'quarantine' and new = 'quarantine' then 'escalate' when old = 'quarantine' and new <> 'quarantine' then 'deescalate'
         when hit_count = n then 'unchanged' else 'changed' end as direction from n""")
def reassess_with_fewer_rules(spark, d):
    """Verdicts of the default rules against those without two of them, under one version: which jobs that changes."""
    lines, facts = lines_of(spark, d), facts_of(spark, d)
    before = verdict.assess(lines, R.scan(lines, DEFAULT, KEY), facts).withColumns({"ruleset_version": F.lit("v"), "assessment_seq": F.lit(1)})
    fewer = [r for r in DEFAULT if r.id not in ("pii.email", "us.ssn")]
    return lifecycle.reassess(before, verdict.assess(lines, R.scan(lines, fewer, KEY), facts), "v").select("job_id", "direction")


@query(f"""with {CURRENT} select o.job_id, c.assessment_seq <> 1 as refused from a o join c using (job_id) where o.assessment_seq = 1""")
def reassess_guarded(spark, d):
    """Rows that would follow first assessments: refused where the job has a later one by now."""
    rows = assessments_of(spark, d).where("assessment_seq = 1").select("job_id", F.lit(1).alias("supersedes_seq"))
    good, refused = lifecycle.guarded(rows, current(spark, d))
    return good.select("job_id", F.lit(False).alias("refused")).unionByName(refused.select("job_id", F.lit(True).alias("refused")))


@query(f"""with {CURRENT} select job_id, assessment_seq + 1 as assessment_seq, assessment_seq as supersedes_seq, 'released' as reason,
       false as release_pending from c where release_pending""")  # fmt: skip
def release_pending_jobs(spark, d):
    now = current(spark, d)
    rows, _ = lifecycle.release(now, now.select("job_id"), "2026-03-31 12:00:00")
    return rows.select("job_id", "assessment_seq", "supersedes_seq", "reason", "release_pending")


@query(f"""with {CURRENT} select job_id, 'not pending' as why from c where not coalesce(release_pending, false)""")
def release_refused(spark, d):
    now = current(spark, d)
    return lifecycle.release(now, now.select("job_id"), "2026-03-31 12:00:00")[1]


@query("""with days as (select distinct 'index' as store, regexp_extract(index_partition, '([0-9-]+)$', 1) as dt from assessments
       union all select distinct 'documents', strftime(received_at at time zone 'UTC', '%Y-%m-%d') from job_contexts)
       select store, dt from days where (store = 'index' and dt::date < date '2026-03-31' - 90) or (store = 'documents' and dt::date < date '2026-03-31' - 30)""")  # fmt: skip
def retention_eligible(spark, d):
    index = table(spark, d, "assessments").select(F.lit("index").alias("store"), F.regexp_extract("index_partition", "([0-9-]+)$", 1).alias("dt"))
    docs = table(spark, d, "job_contexts").select(F.lit("documents").alias("store"), F.date_format("received_at", "yyyy-MM-dd").alias("dt"))
    return store.retention_plan(index.distinct().unionByName(docs.distinct()), "2026-03-31", {"index": 90, "documents": 30})


@query(f"""with {CURRENT}, t as (select distinct on (job_id) job_id from job_contexts), p as (select job_id from c where disposition = 'archive')
       select job_id from t where job_id not in (select job_id from p)""")  # fmt: skip
def purge_keeps_others(spark, d):
    """Content left after purging every archived job."""
    content = table(spark, d, "job_contexts").dropDuplicates(["job_id"])
    return store.purged(content, current(spark, d).where("disposition = 'archive'")).select("job_id")


_REINDEX = f"""{CURRENT}, f as (select distinct job_id, archive_path from c where regexp_matches(archive_path, '[0-9a-f]{{32}}\\.pdf$')),
    i as (select distinct job_id from a where received_at at time zone 'UTC' < timestamp '2026-02-01'), t as (select distinct job_id from job_contexts where full_text is not null),
    b as (select f.job_id, case when f.archive_path like 'quarantine/%' then 'quarantine' else 'archive' end as disposition,
       case when t.job_id is not null then 'content' else 'pdf' end as text_source, t.job_id is null as withheld
       from f left join t using (job_id) where f.job_id not in (select job_id from i))"""


def _reindexed(spark, d):
    """Files of all jobs, an index that was lost from February on, content and purged jobs as they are."""
    rows = assessments_of(spark, d)
    files = current(spark, d).select(F.col("archive_path").alias("path"))
    indexed = rows.where("received_at < timestamp '2026-02-01'").select("job_id")
    content = table(spark, d, "job_contexts").where("full_text IS NOT NULL").select("job_id")
    purged = rows.select("job_id").distinct().join(content, "job_id", "left_anti")
    return files, indexed, lifecycle.to_reindex(files, indexed, purged, content)


@query(f"with {_REINDEX} select * from b")
def reindex_candidates(spark, d):
    """Archived files whose jobs the index lacks; the text of purged ones is withheld."""
    return _reindexed(spark, d)[2]


@query(f"""with {_REINDEX}, v as (select job_id, disposition as d from c) select (select count(*) from f) as found, (select count(*) from f semi join i using (job_id)) as already,
       (select count(*) from (select distinct archive_path from c) where not regexp_matches(archive_path, '[0-9a-f]{{32}}\\.pdf$')) as skipped,
       count(*) filter (where text_source = 'content') as by_content, count(*) filter (where text_source = 'pdf') as by_pdf, count(*) filter (where withheld) as withheld,
       count(*) filter (where d <> disposition) as disagreements from b left join v using (job_id)""")
def reindex_summary(spark, d):
    files, indexed, rebuilt = _reindexed(spark, d)
    return lifecycle.reindex_summary(files.distinct(), indexed, rebuilt, current(spark, d))


@query(f"""with {RECEIPTS} select receipt_id, job_id, status, {AT} from r where status in ('failed', 'received')""")
def failure_queue(spark, d):
    r = receipts_of(spark, d).select("receipt_id", "job_id", "status", "received_at")
    queue = lifecycle.unresolved_failures(r.where("status = 'failed'"), r.where("status = 'received'"))
    return queue.select("receipt_id", "job_id", "status", at_text())


@query("""with e as (select *, count(*) filter (where event_type = 'purchase') over (partition by user_id order by ts range between unbounded preceding and current row) as run
       from events where event_type in ('error', 'purchase'))
       select event_id, case when event_type = 'purchase' then 0 else count(*) filter (where event_type = 'error') over
         (partition by user_id, run order by ts range between interval 86400 seconds preceding and current row) end as recent from e""")  # fmt: skip
def login_window_with_successes(spark, d):
    """As login_window, the count beginning anew after a purchase."""
    from inkwarden.streaming.ingest import failure_window

    rows = table(spark, d, "events").where("event_type in ('error', 'purchase')").select("event_id", F.col("user_id").alias("key"), "ts", (F.col("event_type") == "purchase").alias("ok"))
    return failure_window(rows, 86_400).select("event_id", "recent")


@query("""select event_id, count(*) over (partition by user_id order by ts range between interval 86400 seconds preceding and current row) as recent
       from events where event_type = 'error'""")  # fmt: skip
def login_window(spark, d):
    from inkwarden.streaming.ingest import failure_window

    failures = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("key"), "ts")
    return failure_window(failures, 86_400).select("event_id", "recent")


def audit_log(spark, d) -> DataFrame:
    """Receipts as an audit log: (dt, line_no, raw), linked by the hash of the record before within a day."""
    r = receipts_of(spark, d).select("receipt_id", "job_id", "received_at", "status")
    day = F.date_format("received_at", "yyyy-MM-dd")
    rows = r.withColumn("dt", day).withColumn("line_no", F.row_number().over(Window.partitionBy(day).orderBy("received_at", "receipt_id")))
    at = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    seq = F.regexp_replace("dt", "-", "").cast("long") * 100_000 + F.col("line_no")
    raw = F.to_json(F.struct(seq.alias("seq"), at.alias("ts"), F.concat(F.lit("job."), "status").alias("event"), "job_id", "receipt_id"))
    return rows.select("dt", F.col("line_no").cast("long").alias("line_no"), raw.alias("raw"))


_LOG = f"""{RECEIPTS}, e as (select *, strftime(received_at at time zone 'UTC', '%Y-%m-%d') as dt from r),
    g as (select *, row_number() over (partition by dt order by received_at, receipt_id) as line_no from e),
    q as (select *, replace(dt, '-', '')::bigint * 100000 + line_no as seq, 'job.' || status as event from g)"""


@query(f"""with {_LOG} select seq, event, job_id from q where seq < 2026020100000 order by seq desc limit 101""")
def audit_page(spark, d):
    return audit.page(audit_log(spark, d), before=2026020100000).select("seq", "event", "job_id")


@query(f"""with {_LOG} select seq, event from q where job_id = (select max(job_id) from (select job_id from r group by 1 having count(*) > 1))""")
def audit_timeline(spark, d):
    repeated = receipts_of(spark, d).groupBy("job_id").count().where("count > 1").agg(F.max("job_id")).first()[0]
    return audit.timeline(audit_log(spark, d), repeated or "").select("seq", "event")


@query(f"""with {_LOG} select distinct job_id from q where event in ('job.duplicate', 'job.failed') and job_id is not null""")
def audit_jobs_with_event(spark, d):
    return audit.jobs_with_event(audit_log(spark, d), "job.duplicate", "job.failed")


@query(f"""with {_LOG}, o as (select *, lag(line_no) over (order by dt, line_no) as before from q)
       select dt, line_no, case when line_no <> 5 then seq else -1 end as seq, unnest(list_filter([case when line_no = 2 then 'altered' end, case when line_no = 5 then 'unreadable' end,
         case when line_no <> 5 and before in (3, 5) then 'unlinked' end], lambda x: x is not null)) as problem from o where line_no <> 3""")
def chain_verified(spark, d):
    """One chain over all receipts and days; of every day the second record is altered, the third taken out, the fifth torn."""
    chain = audit.linked(audit_log(spark, d)).where("line_no <> 3")
    altered = F.regexp_replace("raw", '"event": "job.', '"event": "JOB.')
    raw = F.when(F.col("line_no") == 2, altered).when(F.col("line_no") == 5, F.expr("left(raw, 40)")).otherwise(F.col("raw"))
    return audit.verify(chain.withColumn("raw", raw)).fillna(-1, ["seq"])


@query(f"""with {_LOG} select event, job_id from q where seq = (select min(seq) from q)""")
def audit_lookup(spark, d):
    log = audit_log(spark, d)
    return audit.event_at(log, audit.parsed(log).agg(F.min("seq")).first()[0]).select("event", "job_id")


_TOLD = """case when highest_severity is null then '' else '"highest_severity":"' || highest_severity || '",' end || '"hit_count":' || hit_count || ',"hits_truncated":true,'"""
_WHEN = """strftime(received_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"""


@query(f"""with {CURRENT}, m as (select *, '<14>1 ' || {_WHEN} || ' host inkwarden - job.completed - ' as head,
         '"job_id":"' || job_id || '",' as id, '"received_at":"' || {_WHEN} || '"' as told from c),
       n as (select *, head || '{{"disposition":"' || disposition || '","event":"job.completed",' || replace({_TOLD}, '"hits_truncated":true,', '') || id ||
         case when reason is null then '' else '"reason":"' || reason || '",' end || told || ',"rule_ids":[' || coalesce('"' || array_to_string(nullif(rule_ids, []), '","') || '"', '') || ']' ||
         case when source_name is null then '' else ',"source_name":"' || source_name || '"' end || '}}' as whole,
         head || '{{"disposition":"' || disposition || '","event":"job.completed",' || {_TOLD} || id || '"metadata_truncated":true,' || told || '}}' as core from m)
       select job_id, case when strlen(whole) <= 320 then whole else core end as message from n""")
def syslog_messages(spark, d):
    """Messages within 320 bytes where that can be: in full, or the bare essentials."""
    rows = current(spark, d).select("job_id", "received_at", "source_name", "disposition", "reason", "highest_severity", "hit_count", "rule_ids")
    return sinks.syslog_message(rows, "host", most=320)


@query(f"""with {CURRENT} select job_id, '{{"disposition":"' || disposition || '","event":"job.completed",' || replace({_TOLD}, '"hits_truncated":true,', '') || '"job_id":"' || job_id || '",' ||
       '"received_at":"' || {_WHEN} || '"}}' as body from c""")
def payloads(spark, d):
    return sinks.payload(current(spark, d).select("job_id", "received_at", "disposition", "highest_severity", "hit_count"))


@query("""with n as (select 1 as a), old as (select job_id, hit_count from assessments where release_pending is null),
       new as (select job_id, hit_count, release_pending from assessments where release_pending is not null)
       select * from old union all by name select * from new""")  # fmt: skip
def union_by_name(spark, d):
    """Rows of files that lack a column beside rows of files that have it."""
    a = table(spark, d, "assessments")
    old = a.where("release_pending IS NULL").select("job_id", "hit_count")
    return store.union_by_name(old, a.where("release_pending IS NOT NULL").select("job_id", "hit_count", "release_pending"))


_ALNUM = "'[^\\p{L}\\p{N}]', '', 'g'"


@query(f"""with {HITS}, l as (select distinct on (job_id, line_number) * from text_lines),
       k as (select *, substr(text, match_start + 1, match_end - match_start) as raw, length(regexp_replace(masked_text, {_ALNUM})) as keep from h join l using (job_id, line_number)),
       p as (select *, regexp_replace(raw, {_ALNUM}) as plain from k),
       s as (select *, case when keep > 0 and length(plain) > keep + 3 then keep else 0 end as shown from p)
       select hit_id, case when repeat('•', length(plain) - shown) || right(plain, shown) = masked_text then raw end as revealed from s where coalesce(match_end <= length(text), true)""")
def reveal_hits(spark, d):
    """All hits on held lines, those whose masks keep a tail included. (Ends beyond the line are tested on a small table.)"""
    inside = lines_of(spark, d).select("job_id", "line_number", F.length("text").alias("_n"))
    hits = hits_of(spark, d).join(inside, ["job_id", "line_number"]).where(F.coalesce(F.col("match_end") <= F.col("_n"), F.lit(True))).drop("_n")
    return lifecycle.reveal(hits, lines_of(spark, d)).select("hit_id", "revealed")


@query("""with b as (select user_id, list_sort(list(value)) as ys from events where user_id is not null and value is not null group by 1),
       r as (select user_id, list_reduce(list_transform(ys, lambda y: {'y': y, 'n': 1}), lambda acc, x: case when x.y - acc.y > 6.0 then {'y': x.y, 'n': acc.n + 1} else acc end) as last, ys from b)
       select cast(user_id as varchar) as job_id, last.n::int as rows, len(list_filter(ys, lambda y: not (y - ys[1] > 6.0)))::bigint as in_first, len(ys)::bigint as boxes from r""")
def row_clusters(spark, d):
    """Boxes 10 high, put into visual rows of each page: rows, boxes in the first row, boxes."""
    e = table(spark, d, "events").where("user_id IS NOT NULL AND value IS NOT NULL")
    y = F.col("value").cast("double")
    boxes = e.select(F.col("user_id").cast("string").alias("job_id"), F.lit(1).alias("page"), F.col("event_id").cast("double").alias("x0"), (y - 5).alias("y0"),
                     (F.col("event_id") + 1).cast("double").alias("x1"), (y + 5).alias("y1"))
    rows = layout.rows_of(boxes).groupBy("job_id")
    return rows.agg((F.max("row") + 1).alias("rows"), F.count_if(F.col("row") == 0).alias("in_first"), F.count(F.lit(1)).alias("boxes"))


_ARRIVED = f"""{RECEIPTS}, {CURRENT}, g as (select job_id, count(*) as arrivals, last(status order by received_at, receipt_id) as last_status,
    first(filename order by received_at, receipt_id) filter (where filename is not null) as display_name from r group by 1)"""


@query(f"""with {_ARRIVED}, t as (select distinct job_id from job_contexts) select job_id, coalesce(arrivals, 0) as arrivals, last_status, display_name, coalesce(arrivals, 0) as events,
       t.job_id is not null as has_content from c left join g using (job_id) left join t using (job_id)""")
def job_details(spark, d):
    """What a detail page shows of each job; the receipts stand in for audit events."""
    events = audit.parsed(audit_log(spark, d)).select("job_id", "seq", "event")
    rows = Q.job_detail(current(spark, d), receipts_of(spark, d), events, table(spark, d, "job_contexts"))
    return rows.select("job_id", "arrivals", "last_status", "display_name", "events", "has_content")


@query(f"""with {RECEIPTS}, {CURRENT} select receipt_id, {AT} from r where job_id = (select max(job_id) from (select job_id from r group by 1 having count(*) > 1))""")
def receipts_of_one_job(spark, d):
    r = receipts_of(spark, d)
    repeated = r.groupBy("job_id").count().where("count > 1").agg(F.max("job_id")).first()[0]
    return Q.receipts_of_job(r, repeated).select("receipt_id", at_text())


@query(f"""with {CURRENT}, t as (select distinct job_id from job_contexts) select job_id, assessment_seq from c semi join t using (job_id)""")
def jobs_of_a_table(spark, d):
    """Current assessments of the jobs of another table."""
    return Q.of_jobs(current(spark, d), table(spark, d, "job_contexts")).select("job_id", "assessment_seq")


@query(f"""with {RECEIPTS}, s as (select job_id, max(case status when 'received' then 1 when 'failed' then 3 when 'duplicate' then 6 else 7 end) as k from r where job_id is not null group by 1)
       select job_id, k::int as done, case k when 1 then 'pdf' when 3 then 'audit' when 6 then 'emitted' end as next_step, k = 6 as uncertain from s""")
def step_progress(spark, d):
    """The step manifest: jobs of the receipts with as many steps done as their furthest status stands for."""
    far = F.when(F.col("status") == "received", 1).when(F.col("status") == "failed", 3).when(F.col("status") == "duplicate", 6).otherwise(7)
    steps = receipts_of(spark, d).where("job_id IS NOT NULL").select("job_id", F.explode(F.slice(F.array(*map(F.lit, operations.STEPS)), F.lit(1), far)).alias("step"))
    return operations.progress(steps).select("job_id", F.size("done").alias("done"), "next_step", "uncertain")


@query(f"""with {RECEIPTS} select job_id, 'failed' as kind, coalesce(filename, left(job_id, 12)) as filename, 'no text' as reason, false as uncertain from r where status = 'failed'
       union all select job_id, 'staged', coalesce(filename, left(job_id, 12)), 'Interrupted processing', false from r where status = 'received'""")
def failure_items(spark, d):
    """The failed queue with what an operator sees of each item; nothing of it is resolved."""
    r = receipts_of(spark, d)
    no = spark.createDataFrame([], "job_id string, step string")
    decisions = spark.createDataFrame([], "job_id string, kind string, action string, at timestamp")
    items = operations.queue(
        r.where("status = 'failed'").withColumn("reason", F.lit("no text")), r.where("status = 'received'").withColumn("reason", F.lit(None).cast("string")), no, decisions
    )
    return items.select("job_id", "kind", "filename", "reason", "uncertain")


@query("""with n as (select count(*) as all_docs, count(distinct coalesce(md5(text), 'none ' || doc_id)) as docs from documents)
       select 'completed' as status, docs as count from n where docs > 0 union all select 'duplicate', all_docs - docs from n where all_docs > docs""")
def stream_ingest(spark, d):
    """All documents taken in by an AvailableNow stream, twice over one checkpoint: receipts by status."""
    from inkwarden.streaming.ingest import ARRIVAL, ingest_available, read_arrivals

    root = fresh_path(spark, "ingest")
    table(spark, d, "documents").select("doc_id", "text", "source", "received_at").write.parquet(f"{root}/arrivals")
    for _ in range(2):
        ingest_available(read_arrivals(spark, f"{root}/arrivals", ARRIVAL), f"{root}/store", f"{root}/checkpoint", list(R.DEFAULT_RULES), KEY)
    return materialise(spark.read.parquet(f"{root}/store/receipts").groupBy("status").count(), "ingested")
