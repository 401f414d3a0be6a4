"""Reassessment, release, reindexing: whole-table plans instead of loops over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.operators.verdict import INDEX_COLUMNS


def direction(old: Column, new: Column, same: Column, has_content: Column, error: Column | None = None) -> Column:
    """escalate (anything else becomes quarantine), deescalate (quarantine becomes anything else), changed, unchanged,
    content_unavailable or error (the scan could not be finished)."""
    held = old == "quarantine"
    kept = new == "quarantine"
    return (
        F.when(~has_content, "content_unavailable")
        .when(F.lit(False) if error is None else error.isNotNull(), "error")
        .when(~F.coalesce(held, F.lit(False)) & kept, "escalate")
        .when(held & ~F.coalesce(kept, F.lit(False)), "deescalate")
        .when(same, "unchanged")
        .otherwise("changed")
    )


def carried_facts(prior: DataFrame, held: DataFrame) -> DataFrame:
    """What extraction said of the jobs with content, as their current assessments keep it, for
    :func:`verdict.assess`: running fewer rules must not make a degraded document a clean one. The failed pages of old
    are known by the reason only."""
    have = prior.join(held.select("job_id").distinct(), "job_id", "left_semi")
    failed = F.when(F.col("reason") == "degraded_extraction", 1).otherwise(0)
    return have.select("job_id", "page_count", "ocr_page_count", failed.alias("failed_page_count"), "degraded")


def reassess(prior: DataFrame, fresh: DataFrame, version: str, mode: str = "rules") -> DataFrame:
    """Prior current assessments beside fresh verdicts: one row per prior job with its direction.

    Unchanged means the same disposition, the same hits in the same order, and the same ruleset version; in mode
    ``extract``, where pages were read anew, the same page counts and degradation as well. Jobs without content have no
    fresh verdict; one whose fresh disposition is failed is an error and nothing is to be written for it. ``prior``:
    job_id, assessment_seq, disposition, ruleset_version, hits, ...; ``fresh``: the rows of :func:`verdict.assess`.
    """
    if mode not in ("rules", "extract"):
        raise ValueError(f"no mode {mode!r}")
    extra = [c for c in ("page_count", "ocr_page_count", "degraded", "min_ocr_confidence") if c in fresh.columns] if mode == "extract" else []
    new = fresh.select(
        "job_id", F.col("disposition").alias("new_disposition"), F.col("hits").alias("new_hits"), F.col("hit_count").alias("new_hit_count"),
        F.col("highest_severity").alias("new_severity"), F.col("rule_ids").alias("new_rule_ids"), F.lit(True).alias("_has"),
        *[F.col(c).alias(f"new_{c}") for c in extra],
    )
    both = prior.join(new, "job_id", "left")
    none = F.array().cast(fresh.schema["hits"].dataType)
    same = (
        (F.col("disposition") == F.col("new_disposition"))
        & F.coalesce("hits", none).eqNullSafe(F.coalesce("new_hits", none))
        & (F.col("ruleset_version") == F.lit(version))
    )
    for c in extra:
        if c != "min_ocr_confidence" and c in prior.columns:
            same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    error = F.when(F.col("new_disposition") == "failed", F.lit("failed"))
    return both.withColumn(
        "direction", direction(F.col("disposition"), F.col("new_disposition"), F.coalesce(same, F.lit(False)), F.coalesce("_has", F.lit(False)), error)
    ).drop("_has")


def reassessment_rows(directions: DataFrame, version: str, now: str, mode: str = "rules") -> DataFrame:
    """Rows to append: seq + 1, release pending where an archive follows a quarantine or an earlier release still pends.

    Whatever reassessment doesn't derive anew (received_at, pages, degradation, metadata, digests of the file) is carried
    forward; mode ``extract`` takes pages and degradation from the fresh reading.
    """
    pending = (F.col("new_disposition") == "archive") & ((F.col("direction") == "deescalate") | F.coalesce("release_pending", F.lit(False)))
    path = F.when(F.col("direction") == "escalate", F.regexp_replace("archive_path", "^archive/", "quarantine/")).otherwise(F.col("archive_path"))
    seq = F.coalesce("assessment_seq", F.lit(1))
    new = {
        "assessed_at": F.lit(now).cast("timestamp"), "assessment_seq": seq + 1, "ruleset_version": F.lit(version), "supersedes_seq": seq,
        "release_pending": pending, "disposition": F.col("new_disposition"),
        "reason": F.concat(F.lit("reprocessed:"), "direction", F.lit(":extract" if mode == "extract" else "")), "archive_path": path,
        "flagged": F.col("new_hit_count") > 0, "highest_severity": F.col("new_severity"), "hit_count": F.col("new_hit_count"),
        "rule_ids": F.col("new_rule_ids"), "hits": F.col("new_hits"),
    }
    if mode == "extract":
        new |= {c.removeprefix("new_"): F.col(c) for c in directions.columns if c in ("new_page_count", "new_ocr_page_count", "new_degraded", "new_min_ocr_confidence")}
    rows = directions.where(~F.col("direction").isin("unchanged", "content_unavailable", "error"))
    return rows.select(*[new[c].alias(c) if c in new else c for c in INDEX_COLUMNS if c in new or c in directions.columns])


def guarded(rows: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be appended, refused rows): a row is refused when the job's latest assessment is no longer the one it
    supersedes, or is newer. ``current`` holds the latest assessments as they are at commit time."""
    now = current.select("job_id", F.coalesce("assessment_seq", F.lit(1)).alias("_now"))
    both = rows.join(now, "job_id", "left")
    fits = F.coalesce(F.col("supersedes_seq") == F.col("_now"), F.col("_now").isNull() & F.col("supersedes_seq").isNull())
    return both.where(fits).drop("_now"), both.where(~fits).drop("_now")


def reassessment_summary(directions: DataFrame) -> DataFrame:
    return directions.groupBy("direction").agg(F.count(F.lit(1)).alias("jobs"))


def release(current: DataFrame, jobs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, refused jobs with the reason). Only a pending job is released; rules aren't run again."""
    asked = jobs.select("job_id").distinct().join(current, "job_id", "left")
    pending = F.coalesce("release_pending", F.lit(False))
    seq = F.coalesce("assessment_seq", F.lit(1))
    rows = asked.where(pending).withColumns(
        {
            "supersedes_seq": seq, "assessment_seq": seq + 1, "release_pending": F.lit(False), "reason": F.lit("released"),
            "assessed_at": F.lit(now).cast("timestamp"),
        }
    )
    refused = asked.where(~pending).select("job_id", F.when(F.col("received_at").isNull(), "unknown").otherwise("not pending").alias("why"))
    return rows, refused


def to_reindex(files: DataFrame, indexed: DataFrame, purged: DataFrame, content: DataFrame) -> DataFrame:
    """Documents found in the stores but not in the index: job_id, disposition (where the file lies), text_source, withheld.

    ``files`` has path. Stray names are skipped. A purged job's text stays withheld.
    """
    name = F.regexp_extract(F.col("path"), r"([0-9a-f]{32})\.pdf$", 1)
    where = F.when(F.col("path").rlike(r"(^|/)quarantine/"), "quarantine").otherwise("archive")
    found = files.select(name.alias("job_id"), where.alias("disposition")).where(F.col("job_id") != "").dropDuplicates(["job_id"])
    missing = found.join(indexed.select("job_id").distinct(), "job_id", "left_anti")
    flag = lambda df, c: df.select("job_id").distinct().withColumn(c, F.lit(True))
    rows = missing.join(flag(purged, "withheld"), "job_id", "left").join(flag(content, "_content"), "job_id", "left")
    return rows.select(
        "job_id", "disposition", F.when(F.col("_content"), "content").otherwise("pdf").alias("text_source"), F.coalesce("withheld", F.lit(False)).alias("withheld")
    )


def reveal(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """Hits with the text they mask, taken from the lines and kept only if masking it again gives the stored mask.

    A hit that ends beyond its line is read on from the lines that follow. Hits whose line isn't held are left out; a null
    mask reveals nothing.
    """
    from inkwarden.functions.values import mask

    keep = F.length(F.regexp_replace("masked_text", r"[^\p{L}\p{N}]", ""))
    size = F.col("match_end") - F.col("match_start")
    joined = hits.join(lines.select("job_id", "line_number", "text"), ["job_id", "line_number"])
    beyond = F.coalesce(F.col("match_end") > F.length("text"), F.lit(False))
    own = joined.where(~beyond).withColumn("_raw", F.substring("text", F.col("match_start") + 1, size)).drop("text")
    wide = joined.where(beyond).drop("text")
    # lines that such a hit reaches: no more of them than it has characters
    reach = wide.select("hit_id", "job_id", F.explode(F.sequence(F.col("line_number"), F.col("line_number") + size)).alias("line_number"))
    parts = reach.join(lines.select("job_id", "line_number", "text"), ["job_id", "line_number"]).groupBy("hit_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("_body")
    )
    over = wide.join(parts, "hit_id").withColumn("_raw", F.substring("_body", F.col("match_start") + 1, size)).drop("_body")
    both = own.unionByName(over)
    return both.withColumn("revealed", F.when(mask(F.col("_raw"), keep) == F.col("masked_text"), F.col("_raw"))).drop("_raw")


def unresolved_failures(failed: DataFrame, staged: DataFrame) -> DataFrame:
    """Failed and staged jobs as one queue, newest first."""
    both = failed.withColumn("state", F.lit("failed")).unionByName(staged.withColumn("state", F.lit("staged")), allowMissingColumns=True)
    return both.orderBy(F.desc("received_at"), F.desc("job_id"))


def reindex_summary(files: DataFrame, indexed: DataFrame, rebuilt: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: found, skipped (stray names), already (indexed), by_content, by_pdf, withheld, disagreements.

    A rebuilt job keeps the disposition of where its file lies; where fresh ``verdicts`` say otherwise that is counted, not
    acted on.
    """
    name = F.regexp_extract(F.col("path"), r"([0-9a-f]{32})\.pdf$", 1)
    seen = files.select(name.alias("job_id")).withColumn("stray", F.col("job_id") == "").distinct()
    counts = seen.join(indexed.select("job_id").distinct().withColumn("_i", F.lit(True)), "job_id", "left").agg(
        F.count_if(~F.col("stray")).alias("found"), F.count_if("_i").alias("already")
    )
    strays = files.agg(F.count_if(name == "").alias("skipped"))
    new = verdicts.select("job_id", F.col("disposition").alias("_d"))
    built = rebuilt.join(new, "job_id", "left").agg(
        F.count_if(F.col("text_source") == "content").alias("by_content"), F.count_if(F.col("text_source") == "pdf").alias("by_pdf"),
        F.count_if("withheld").alias("withheld"), F.count_if(F.col("_d") != F.col("disposition")).alias("disagreements"),
    )
    return counts.join(strays).join(built)  # three tables of one row
