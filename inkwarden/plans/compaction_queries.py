"""Queries of the small-files problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.operators import compaction as C
from inkwarden.session import fresh_path, materialise, table, whole_timestamps


TODAY = "2026-03-31"  # of the driver tables
KEY = ["job_id", "assessment_seq"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.planned_files(table(spark, sf_dir, "index_files"), TODAY).select("index_partition", "file_name")


def p1_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.plan(table(spark, sf_dir, "index_files"), TODAY)


def small_file_store(spark: SparkSession, sf_dir: str) -> C.PartitionedTable:
    """The assessments laid out as they are in the stores: a Parquet file for each record of each partition."""
    records = table(spark, sf_dir, "assessments").withColumn("assessment_seq", F.coalesce("assessment_seq", F.lit(1)))
    root = fresh_path(spark, "index-store")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work a row: not to be coalesced
    with whole_timestamps(spark):
        records.repartition(slots, "index_partition", "file_name").sortWithinPartitions("index_partition").write.option("maxRecordsPerFile", 1).partitionBy(
            "index_partition"
        ).parquet(root)
    return C.PartitionedTable(spark, root, "index_partition", records.schema)


def p1_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacts a store of one-record files by the plan, by way of versions and conflict checks, and reads it again."""
    plan = materialise(C.plan(table(spark, sf_dir, "index_files"), TODAY), "plan")
    store = small_file_store(spark, sf_dir)
    store.compact(plan, KEY, ["assessed_at", "file_name"])
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", "job_id", "assessment_seq", "disposition", F.unix_micros("received_at"))), 1, 8), 16, 10).cast("long")
    kept = (
        store.read()
        .withColumn("_at", F.col("_metadata.file_name"))
        .groupBy(F.col("index_partition").alias("partition"))
        .agg(F.count(F.lit(1)).alias("records"), F.max("assessment_seq").alias("highest_seq"), F.sum(mark).alias("record_marks"), F.countDistinct("_at").alias("files_now"))
    )
    return plan.join(kept, "partition", "left").select(
        "partition", "files", "bytes_before", F.coalesce("records", F.lit(0)).alias("records"), "highest_seq", "record_marks", F.coalesce("files_now", F.lit(0)).alias("files_now")
    )


QUERIES = {"p1_found": p1_found, "p1_plan": p1_plan, "p1_rewrite": p1_rewrite}

_COUNTING = """
counting as (
  select index_partition, file_name, bytes from (
    select *, row_number() over (partition by index_partition, file_name
                                 order by listed_at desc nulls last, listing_id desc) as place
    from index_files
    where file_name like '%.parquet' and index_partition is not null
      and regexp_matches(index_partition, '(^|/)dt=[0-9]{4}-[0-9]{2}-[0-9]{2}$')
      and not regexp_matches(index_partition, '(^|/)dt=2026-03-31$'))
  where place = 1 and present),
worth as (select index_partition, count(*) as files, sum(coalesce(bytes, 0))::bigint as bytes_before
          from counting group by 1 having count(*) > 1)
"""

SQL = {
    "p1_found": f"with {_COUNTING} select index_partition, file_name from counting semi join worth using (index_partition)",
    "p1_plan": f"""with {_COUNTING} select index_partition as partition, files, bytes_before,
        greatest(1, ceil(bytes_before / 134217728.0))::int as files_after from worth""",
    "p1_rewrite": f"""with {_COUNTING}, kept as (
        select index_partition, count(*) as records, max(seq) as highest_seq, sum(('0x' || left(md5(concat_ws(':', job_id, seq, disposition, us)), 8))::bigint)::bigint as record_marks,
        from (select distinct index_partition, job_id, coalesce(assessment_seq, 1) as seq, disposition, epoch_us(received_at) as us from assessments) group by 1)
        select w.index_partition as partition, files, bytes_before, coalesce(records, 0) as records, highest_seq, record_marks,
        case when records > 0 then greatest(1, ceil(bytes_before / 134217728.0)) else 0 end::bigint as files_now
        from worth w left join kept k using (index_partition)""",
}
