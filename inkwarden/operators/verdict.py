"""From hits to one verdict per document, and the assessment row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.functions.values import severity_of, severity_rank

HIT_FIELDS = (
    "rule_id", "rule_name", "severity", "action", "page_number", "line_number", "line_on_page", "start", "end", "masked_text", "match_hmac", "validator",
)


def rollup(hits: DataFrame) -> DataFrame:
    """Per job: hit_count, flagged, highest_severity, rule_ids (sorted, distinct), quarantine_hits, hits (rule, line, start order)."""
    ordered = F.array_sort(F.collect_list(F.struct("rule_pos", "line_number", "start", F.struct(*HIT_FIELDS).alias("h"))))
    return hits.groupBy("job_id").agg(
        F.count(F.lit(1)).cast("int").alias("hit_count"),
        F.lit(True).alias("flagged"),
        severity_of(F.max(severity_rank(F.col("severity")))).alias("highest_severity"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.sum(F.when(F.col("action") == "quarantine", 1).otherwise(0)).cast("int").alias("quarantine_hits"),
        F.transform(ordered, lambda x: x["h"]).alias("hits"),
    )


def decide(quarantine_hits: Column, failed_pages: Column, pages: Column, lines: Column, degraded: Column, strict: bool = True) -> Column:
    """struct(disposition, reason). With ``strict`` doubtful extraction is quarantined before any rule is asked."""
    quarantine = lambda why: F.struct(F.lit("quarantine").alias("disposition"), F.lit(why).alias("reason"))
    out = F.when(F.lit(strict) & (failed_pages > 0), quarantine("degraded_extraction"))
    out = out.when(F.lit(strict) & (pages > 0) & (lines == 0), quarantine("no_text_extracted"))
    out = out.when(F.lit(strict) & degraded, quarantine("degraded_extraction"))
    out = out.when(quarantine_hits > 0, quarantine("dlp_hit"))
    return out.otherwise(F.struct(F.lit("archive").alias("disposition"), F.lit(None).cast("string").alias("reason")))


def page_stats(lines: DataFrame) -> DataFrame:
    """Per job: page_count, ocr_page_count, line_count, text_line_count (lines that aren't blank), min and mean confidence
    (nulls ignored)."""
    ocr = F.lower(F.trim("source")) == "ocr"
    return lines.groupBy("job_id").agg(
        F.countDistinct("page_number").cast("int").alias("page_count"),
        F.countDistinct(F.when(ocr, F.col("page_number"))).cast("int").alias("ocr_page_count"),
        F.count(F.lit(1)).cast("int").alias("line_count"),
        F.count_if(F.col("text").rlike(r"(?U)\S")).cast("int").alias("text_line_count"),
        F.min("confidence").alias("min_ocr_confidence"),
        F.avg("confidence").alias("mean_ocr_confidence"),
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """What extraction says of each job, from one row a page (job_id, page_number, kind, lines, error).

    kind is native, ocr, mixed or blank. A page with an error has failed; a page that isn't blank but gave no lines makes
    the job degraded, as a failed one does. Repeated rows of a page count once; nulls count as nothing said.
    """
    failed, blank = F.col("error").isNotNull(), F.coalesce(F.col("kind") == "blank", F.lit(False))
    silent = ~failed & ~blank & (F.coalesce("lines", F.lit(0)) == 0)
    return (
        pages.dropDuplicates(["job_id", "page_number"])
        .groupBy("job_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("page_count"),
            F.count_if(~failed & F.col("kind").isin("ocr", "mixed", "blank")).cast("int").alias("ocr_page_count"),
            F.count_if(failed).cast("int").alias("failed_page_count"),
            F.count_if(~failed & blank).cast("int").alias("blank_page_count"),
            F.bool_or(failed | silent).alias("degraded"),
        )
    )


FACTS = "page_count int, ocr_page_count int, failed_page_count int, degraded boolean, error string"


def assess(lines: DataFrame, hits: DataFrame, facts: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """One row per job: page statistics, rollup and verdict. A job without hits has empty arrays and no severity.

    ``facts`` says what extraction met, one row a job: job_id and any of page_count, ocr_page_count, failed_page_count,
    degraded, error. Every job of ``facts`` gets a verdict, also one without lines; numbers it lacks or leaves null are
    counted from the lines. An error makes the job failed. Blank lines are no text.
    """
    stats = page_stats(lines)
    if facts is None:
        joined = stats.select("job_id", *[F.lit(None).cast(k).alias(f"_{c}") for c, k in map(str.split, FACTS.split(", "))], *stats.columns[1:])
    else:
        own = facts.select(
            "job_id", *[(F.col(c) if c in facts.columns else F.lit(None)).cast(k).alias(f"_{c}") for c, k in map(str.split, FACTS.split(", "))]
        )
        joined = own.join(stats, "job_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = {
        "page_count": zero(F.coalesce("_page_count", "page_count")), "ocr_page_count": zero(F.coalesce("_ocr_page_count", "ocr_page_count")),
        "failed_page_count": zero("_failed_page_count"), "degraded": F.coalesce("_degraded", F.lit(False)),
        "line_count": zero("line_count"), "text_line_count": zero("text_line_count"),
    }
    joined = joined.withColumns(counted).join(rollup(hits), "job_id", "left")
    verdict = decide(zero("quarantine_hits"), F.col("failed_page_count"), F.col("page_count"), F.col("text_line_count"), F.col("degraded"), strict)
    failed = F.struct(F.lit("failed").alias("disposition"), F.col("_error").alias("reason"))
    return joined.withColumn("v", F.when(F.col("_error").isNotNull(), failed).otherwise(verdict)).select(
        "job_id", "page_count", "ocr_page_count", "failed_page_count", "line_count", "min_ocr_confidence", "degraded", "v.disposition", "v.reason",
        F.coalesce("flagged", F.lit(False)).alias("flagged"), "highest_severity", zero("hit_count").alias("hit_count"),
        F.coalesce("rule_ids", F.array().cast("array<string>")).alias("rule_ids"), "hits",
    )


INDEX_COLUMNS = (
    "job_id", "received_at", "assessed_at", "assessment_seq", "ruleset_version", "supersedes_seq", "release_pending", "source_name", "page_count",
    "ocr_page_count", "min_ocr_confidence", "degraded", "disposition", "reason", "archive_path", "pdf_sha256", "flagged", "highest_severity",
    "hit_count", "rule_ids", "hits", "metadata", "audit_fields",
)


def index_rows(verdicts: DataFrame, jobs: DataFrame, version: str, now: str) -> DataFrame:
    """First assessments in the order of INDEX_COLUMNS. ``jobs`` has job_id, received_at, source_name and, where known,
    pdf_sha256, metadata, audit_fields. Failed jobs are not indexed: they go to the failed queue."""
    known = ("received_at", "source_name", "pdf_sha256", "metadata", "audit_fields")
    own = jobs.select("job_id", *[(F.col(c) if c in jobs.columns else F.lit(None).cast("string")).alias(c) for c in known])
    rows = verdicts.where("disposition <> 'failed'").join(own, "job_id")
    place = F.concat_ws("/", "disposition", F.concat(F.lit("dt="), F.date_format("received_at", "yyyy-MM-dd")), F.concat("job_id", F.lit(".pdf")))
    return rows.withColumns(
        {
            "assessed_at": F.lit(now).cast("timestamp"), "assessment_seq": F.lit(1), "ruleset_version": F.lit(version),
            "supersedes_seq": F.lit(None).cast("int"), "release_pending": F.lit(False), "archive_path": place,
        }
    ).select(*INDEX_COLUMNS)


def failed_jobs(verdicts: DataFrame) -> DataFrame:
    """Jobs whose extraction or scan failed: (job_id, reason), for the failed queue."""
    return verdicts.where("disposition = 'failed'").select("job_id", "reason")


def rule_report(hits: DataFrame, samples: int = 5) -> DataFrame:
    """Hits per rule with the first few masked samples in document order."""
    first = F.slice(F.array_sort(F.collect_set(F.struct("job_id", "line_number", "start", "masked_text"))), 1, samples)
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.transform(first, lambda x: x["masked_text"]).alias("samples"))
