"""Append-only assessments, content by document, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(assessments: DataFrame, day: str | None = None) -> DataFrame:
    """The current assessment of each job: the highest assessment_seq, null last; ties by assessed_at, then file or row content.

    With ``day`` (a partition column all rows of a job share) filters on it reach the scan through the window.
    """
    by = [F.col("job_id")] if day is None else [F.col(day), F.col("job_id")]
    order = [F.col("assessment_seq").desc_nulls_last()]
    if "assessed_at" in assessments.columns:
        order.append(F.col("assessed_at").desc_nulls_last())
    return assessments.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_place = 1").drop("_place")


def new_rows(rows: DataFrame, held: DataFrame, key: tuple[str, ...] = ("job_id", "assessment_seq")) -> DataFrame:
    """Rows whose key isn't held yet: the exclusive append of a single writer, harmless to repeat."""
    return rows.dropDuplicates(list(key)).join(held.select(*key), list(key), "left_anti")


def append_assessments(rows: DataFrame, root: str, held: DataFrame) -> None:
    new_rows(rows, held).withColumn("dt", F.to_date("received_at")).write.mode("append").partitionBy("dt").parquet(root)


def replace_documents(content: DataFrame, changes: DataFrame) -> DataFrame:
    """Content with the changed documents in place of all their older rows, whatever day those lie in."""
    return content.join(changes.select("job_id").distinct(), "job_id", "left_anti").unionByName(changes, allowMissingColumns=True)


def purged(content: DataFrame, jobs: DataFrame) -> DataFrame:
    """Content without the given jobs; purging again changes nothing."""
    return content.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def rewrite_days(content: DataFrame, jobs: DataFrame, root: str) -> None:
    """Deletes jobs from a table partitioned by dt: only the days that hold them are rewritten, by way of a staged copy."""
    from inkwarden.session import materialise

    spark = content.sparkSession
    days = content.join(jobs.select("job_id").distinct(), "job_id", "left_semi").select("dt").distinct()
    kept = materialise(purged(content.join(days, "dt", "left_semi"), jobs), "purged")
    emptied = days.join(kept.select("dt").distinct(), "dt", "left_anti").collect()  # days, not documents
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(root)
    for row in emptied:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/dt={row['dt']}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def expired(day: Column, today: Column, days: int) -> Column:
    """Whether a partition's day lies strictly before today minus ``days``; names that are no date never do."""
    return F.coalesce(F.try_to_date(day.cast("string"), "yyyy-MM-dd") < F.date_sub(today, days), F.lit(False))


def retention_plan(days_held: DataFrame, today: str, limits: dict[str, int]) -> DataFrame:
    """store, dt of every partition to drop; days_held has (store, dt as text)."""
    out = F.lit(False)
    for store, limit in limits.items():
        out = out | ((F.col("store") == store) & expired(F.col("dt"), F.lit(today).cast("date"), limit))
    return days_held.where(out)


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Rows of tables of different age; columns one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def apply_retention(spark, plan: DataFrame, roots: dict[str, str]) -> list[str]:
    """Drops the planned partitions (one row each) and names them; a partition already gone is passed over."""
    dropped = []
    for row in plan.toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{roots[row['store']]}/dt={row['dt']}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True):
            dropped.append(f"{row['store']}/dt={row['dt']}")
    return sorted(dropped)


def alive(heartbeats: DataFrame, now: str, stale_seconds: int = 60, forget_hours: int = 24) -> DataFrame:
    """Latest beat of each worker with ``stale``; those not heard of for ``forget_hours`` are left out."""
    last = heartbeats.groupBy("worker").agg(F.max("updated_at").alias("updated_at"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")
    return last.where(age <= forget_hours * 3600).withColumn("stale", age > stale_seconds)
