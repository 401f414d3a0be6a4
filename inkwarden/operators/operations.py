"""Work in progress and what to do about failures, as append-only tables whose latest row counts.

``steps`` (job_id, step, at) is the manifest of each job's steps, ``snapshots`` (verdicts written before any side effect)
what a job that is taken up again keeps. Decisions about the failed queue are events, so nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.operators.store import new_rows
from inkwarden.session import file_system
from inkwarden.sources.readers import exists

# The steps of a job in order.
STEPS = ("assessed", "pdf", "audit_started", "audit", "stores", "emit_started", "emitted")


def progress(steps: DataFrame) -> DataFrame:
    """Per job: done (steps in order), next_step (null when all are done), uncertain (sending began and isn't known to have
    ended). Unknown steps are passed over; repeats change nothing."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step"))
    known = steps.withColumn("_k", place).where("_k > 0").groupBy("job_id").agg(F.array_sort(F.collect_set("_k")).alias("_k"))
    all_of = F.array(*map(F.lit, STEPS))
    done = F.transform("_k", lambda k: F.element_at(all_of, k.cast("int")))
    open_ = F.array_except(all_of, done)
    has = lambda s: F.array_contains(done, s)
    return known.select(
        "job_id", done.alias("done"), F.try_element_at(open_, F.lit(1)).alias("next_step"), (has("emit_started") & ~has("emitted")).alias("uncertain")
    )


def to_resume(staged: DataFrame, steps: DataFrame, now: str, least_age: int = 0) -> DataFrame:
    """Staged jobs to take up again, with the step to go on with: those staged ``least_age`` seconds ago or longer (younger
    ones may still be worked on) whose sending isn't uncertain. ``staged`` has job_id, staged_at."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("staged_at")
    rows = staged.where(age >= least_age).join(progress(steps), "job_id", "left")
    ready = ~F.coalesce("uncertain", F.lit(False)) & (F.col("done").isNull() | F.col("next_step").isNotNull())
    return rows.where(ready).withColumn("next_step", F.coalesce("next_step", F.lit(STEPS[0]))).drop("done", "uncertain")


def recovered_verdicts(staged: DataFrame, snapshots: DataFrame, fresh: DataFrame) -> DataFrame:
    """Verdicts of jobs taken up again: the one in the snapshot where there is one (rules that changed meanwhile don't
    count), otherwise the fresh one. ``snapshots`` and ``fresh`` have the same columns, job_id among them."""
    wanted = staged.select("job_id").distinct()
    kept = snapshots.join(wanted, "job_id", "left_semi").dropDuplicates(["job_id"])
    return kept.unionByName(fresh.join(wanted, "job_id", "left_semi").join(kept.select("job_id"), "job_id", "left_anti"))


# --- the failed queue ---


def queue(failed: DataFrame, staged: DataFrame, steps: DataFrame, decisions: DataFrame, resolved: bool = False) -> DataFrame:
    """Failed and interrupted jobs: job_id, kind, filename, reason, received_at, uncertain, resolved.

    ``failed`` and ``staged`` have job_id, filename, reason, received_at; ``decisions`` job_id, kind, action, at. An item is
    resolved while its latest decision is ``resolve``.
    """
    both = failed.select("job_id", F.lit("failed").alias("kind"), "filename", "reason", "received_at").unionByName(
        staged.select("job_id", F.lit("staged").alias("kind"), "filename", "reason", "received_at")
    )
    last = decisions.groupBy("job_id", "kind").agg(F.max_by("action", "at").alias("_last"))
    rows = both.join(progress(steps).select("job_id", "uncertain"), "job_id", "left").join(last, ["job_id", "kind"], "left")
    uncertain = F.coalesce("uncertain", F.lit(False)) & (F.col("kind") == "staged")
    why = F.when(uncertain, "Delivery outcome uncertain").otherwise("Interrupted processing")
    done = F.coalesce(F.col("_last") == "resolve", F.lit(False))
    return rows.select(
        "job_id", "kind", F.coalesce("filename", F.substring("job_id", 1, 12)).alias("filename"), F.coalesce("reason", why).alias("reason"),
        "received_at", uncertain.alias("uncertain"), done.alias("resolved"),
    ).where(F.col("resolved") == F.lit(resolved))


def queue_page(items: DataFrame, page: int = 0, size: int = 100) -> DataFrame:
    """Newest first, a page and one row more."""
    if page < 0 or not 1 <= size <= 1000:
        raise ValueError("page must not be negative, size 1 to 1000")
    return items.orderBy(F.desc("received_at"), F.desc("job_id")).offset(page * size).limit(size + 1)


def queue_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.count_if("uncertain").alias("uncertain"))


def decide(items: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(decisions to append, refused requests). ``asked`` has job_id, kind, action (resolve, retry), reason, actor, confirmed.

    Refused are items not in the queue, requests without a reason, unknown actions, and retries of an uncertain delivery
    without confirmation. Any number of items is one plan.
    """
    rows = asked.join(items.select("job_id", "kind", "uncertain", F.lit(True).alias("_there")), ["job_id", "kind"], "left")
    why = (
        F.when(F.col("_there").isNull(), "not in the queue")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "a reason is required")
        .when(~F.coalesce(F.col("action").isin("resolve", "retry"), F.lit(False)), "unknown action")
        .when((F.col("action") == "retry") & F.col("uncertain") & ~F.coalesce("confirmed", F.lit(False)), "confirm possible duplicate delivery")
    )
    judged = rows.withColumn("why", why)
    good = judged.where("why IS NULL").select("job_id", "kind", "action", "reason", "actor", F.lit(now).cast("timestamp").alias("at"))
    return good, judged.where("why IS NOT NULL").select("job_id", "kind", "action", "why")


def decision_events(decisions: DataFrame) -> DataFrame:
    """Audit events of decisions: job_id, event, reason, actor, ts."""
    event = F.when(F.col("action") == "resolve", "job.failure_resolved").otherwise("job.retry_requested")
    return decisions.select("job_id", event.alias("event"), "reason", "actor", "kind", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"))


# --- transitions ---


def commit_transition(root: str, batch: int, rows: DataFrame, held: DataFrame, events: DataFrame, stop_after: str | None = None) -> None:
    """Writes new assessments and their events as one transition: the journal first, then each table, then the end mark.

    Every step overwrites the batch's own folder, so taking a transition up again repeats it harmlessly. ``held`` are the
    assessments known (rows they hold already aren't written twice). ``stop_after`` breaks off, for tests.
    """
    spark = rows.sparkSession
    base = f"{root}/journal/batch={batch}"
    new_rows(rows, held).write.mode("overwrite").parquet(f"{base}/assessments")
    events.write.mode("overwrite").parquet(f"{base}/events")
    _touch(spark, f"{base}/_complete")
    if stop_after != "journal":
        _apply(spark, root, batch, stop_after)


def _touch(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.create(at, True).close()


def _apply(spark: SparkSession, root: str, batch: int, stop_after: str | None = None) -> None:
    base = f"{root}/journal/batch={batch}"
    for name in ("events", "assessments"):  # the trail before the verdict
        spark.read.parquet(f"{base}/{name}").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        if stop_after == name:
            return
    _touch(spark, f"{base}/_done")


def recover_transitions(spark: SparkSession, root: str) -> list[int]:
    """Takes up transitions that a crash left between the journal and the end; incomplete journals are void. Their numbers."""
    fs, at = file_system(spark, f"{root}/journal")
    if not fs.exists(at):
        return []
    batches = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if "batch=" in s.getPath().getName())
    open_ = [b for b in batches if exists(spark, f"{root}/journal/batch={b}/_complete") and not exists(spark, f"{root}/journal/batch={b}/_done")]
    for b in open_:
        _apply(spark, root, b)
    return open_


# --- purge ---


def purge(content: DataFrame, root: str, jobs: DataFrame, reason: str, actor: str, now: str, audit_to, documents: list[str] | None = None) -> DataFrame:
    """Deletes the text of jobs, and with ``documents`` (folders) their files as well; index and trail stay.

    ``audit_to`` appends a list of events to the trail. It gets an intent before anything is deleted and an outcome after.
    Purging again changes nothing but is told again. Returns job_id, content_removed, document_removed.
    """
    from inkwarden.operators.store import rewrite_days
    from inkwarden.session import materialise

    if not reason.strip():
        raise ValueError("a reason is required")
    asked = jobs.select("job_id").distinct()
    have = content.select("job_id").distinct().withColumn("content_removed", F.lit(True))
    found = materialise(asked.join(have, "job_id", "left").fillna(False, ["content_removed"]), "to-purge")
    mode = "hard" if documents is not None else "soft"
    tell = lambda event, r, **more: {"ts": now, "event": event, "job_id": r["job_id"], "reason": reason, "actor": actor, "mode": mode, **more}
    ordered = found.orderBy("job_id")
    audit_to([tell("purge.started", r) for r in ordered.toLocalIterator()])
    rewrite_days(content, found.where("content_removed"), root)
    outcome, rows = [], []
    for r in ordered.toLocalIterator():
        removed = None
        if documents is not None:
            removed = any([_remove(found.sparkSession, f"{folder}/{r['job_id']}.pdf") for folder in documents])
        rows.append((r["job_id"], r["content_removed"], removed))
        outcome.append(tell("content.purged", r, content_removed=r["content_removed"], document_removed=removed))
    audit_to(outcome)
    return found.sparkSession.createDataFrame(rows, "job_id string, content_removed boolean, document_removed boolean")


def _remove(spark: SparkSession, pattern: str) -> bool:
    """Deletes the files a path pattern names; whether there were any."""
    fs, at = file_system(spark, pattern)
    found = fs.globStatus(at) or []
    return any([fs.delete(s.getPath(), False) for s in found])
