"""Ingest of arriving documents as a stream.

Every micro-batch is written by its number, so a batch that runs again after a crash replaces its own files: stores see
each document once. Identity is the hash of the content and never expires; a known document only gives a receipt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwarden.operators.rules import Rule, ruleset_version, scan
from inkwarden.operators.verdict import assess
from inkwarden.session import ship
from inkwarden.sources.readers import exists, text_lines

ARRIVAL = "doc_id long, text string, source string, received_at timestamp"


def read_arrivals(spark: SparkSession, folder: str, schema: str = ARRIVAL) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def job_id_of(text: Column, key: Column, content: Column | None = None) -> Column:
    """Identity of a document: the hash of its bytes, or of its text; one of which neither is there is a job of its own."""
    known = [F.md5(c) for c in (content, text) if c is not None]
    return F.coalesce(*known, F.md5(F.concat(F.lit("arrival:"), key.cast("string"))))


def ingest_batch(root: str, rules: list[Rule], key: bytes) -> Callable[[DataFrame, int], None]:
    """foreachBatch function writing receipts, content and assessments below ``root`` in folders named by batch.

    A document without text, or with blank lines only, gets its verdict like any other: quarantine, no_text_extracted.
    """
    version = ruleset_version(rules)

    def known(ids: DataFrame, batch_id: int) -> DataFrame:
        """Those of the batch's ids that an earlier batch took: one column of the store is read, the batch is the small side."""
        spark = ids.sparkSession
        if not exists(spark, f"{root}/assessments"):
            return spark.createDataFrame([], "job_id string")
        held = spark.read.option("basePath", f"{root}/assessments").schema("job_id string, batch long").parquet(f"{root}/assessments")
        return held.where(F.col("batch") != batch_id).select("job_id").join(ids, "job_id", "left_semi").distinct()

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ship(spark)
        content = F.col("content") if "content" in batch.columns else None
        batch = batch.withColumn("job_id", job_id_of(F.col("text"), F.col("doc_id"), content)).persist()
        try:
            first = batch.groupBy("job_id").agg(F.min_by(F.struct("doc_id", "text", "source", "received_at"), F.struct("received_at", "doc_id")).alias("d"))
            fresh = first.join(known(first.select("job_id"), batch_id), "job_id", "left_anti").select("job_id", "d.*").persist()
            chosen = fresh.select("job_id", "doc_id", F.lit("completed").alias("_status"))
            receipts = batch.join(chosen, ["job_id", "doc_id"], "left").select(
                "job_id", "doc_id", "received_at", F.coalesce("_status", F.lit("duplicate")).alias("status")
            )
            lines = text_lines(fresh, "job_id", "text")
            facts = fresh.select("job_id", F.when(F.col("text").isNull(), 1).alias("page_count"))
            verdicts = assess(lines, scan(lines, rules, key), facts).join(fresh.select("job_id", "received_at", "source"), "job_id")
            rows = verdicts.withColumns({"assessment_seq": F.lit(1), "ruleset_version": F.lit(version)})
            out = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
            out(receipts, "receipts")
            out(fresh.select("job_id", F.col("text").alias("full_text")), "content")
            out(rows, "assessments")  # last: a verdict never lacks its text or receipt
            fresh.unpersist()
        finally:
            batch.unpersist()

    return work


def receipt_status(receipts: DataFrame, updates: DataFrame) -> DataFrame:
    """Receipts with their latest status: ``updates`` has receipt_id, status, at. One not updated keeps its own."""
    last = updates.groupBy("receipt_id").agg(F.max_by("status", "at").alias("_status"))
    rows = receipts.dropDuplicates(["receipt_id"]).join(last, "receipt_id", "left")
    return rows.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def ingest_available(arrivals: DataFrame, root: str, checkpoint: str, rules: list[Rule], key: bytes) -> None:
    """Takes in everything that has arrived and stops; running again over the same checkpoint adds nothing."""
    writer = arrivals.writeStream.foreachBatch(ingest_batch(root, rules, key)).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def settled(sightings: DataFrame, polls: int = 2, grace: int = 0) -> DataFrame:
    """Files ready to be taken: path, size, seen.

    ``sightings`` has (poll, path, size): what each poll of a folder listed. A file is ready when its last ``polls``
    sightings, up to the last poll, are of one size; one whose companion (same stem, other suffix) is missing waits
    ``grace`` polls more. A file absent from the last poll isn't there any more.
    """
    last = sightings.agg(F.max("poll")).first()[0]
    if last is None:
        return sightings.select("path", "size", F.lit(0).alias("seen"))
    now = sightings.where(F.col("poll") == last).select("path", F.col("size").alias("now"))
    stale = F.when(F.col("size") != F.col("now"), F.col("poll"))
    runs = sightings.join(now, "path").groupBy("path", F.col("now").alias("size"))
    run = runs.agg(F.max(stale).alias("changed"), F.collect_set("poll").alias("polls"))
    gap = F.array_max(F.filter(F.transform(F.sequence(F.array_min("polls"), F.lit(last)), lambda p: F.when(~F.array_contains("polls", p), p)), lambda x: x.isNotNull()))
    run = run.withColumn("seen", F.lit(last) - F.greatest(F.coalesce("changed", F.lit(-1)), F.coalesce(gap, F.lit(-1)), F.array_min("polls") - 1))
    stem = F.lower(F.regexp_replace("path", r"\.[^./]*$", ""))
    pairs = run.withColumn("_stem", stem)
    counted = pairs.groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.join(counted, "_stem").where(F.col("seen") >= polls + F.when(F.col("_n") > 1, 0).otherwise(grace)).select("path", "size", "seen")


def settle_step(before: DataFrame, now: DataFrame, polls: int = 2, grace: int = 0) -> DataFrame:
    """One poll's state from the last one's: path, size, poll, since, ready, taken.

    ``before`` has path, size, since, taken of the poll before; ``now`` poll, path, size. A file keeps its ``since`` while
    it is seen with one size; it is ready once, when it has kept it for ``polls`` sightings (and, without a companion of
    the same stem, ``grace`` more). A path that vanished has no state.
    """
    held = before.select("path", "size", F.col("since").alias("_since"), F.col("taken").alias("_taken"))
    rows = now.join(held, ["path", "size"], "left").withColumn("since", F.coalesce("_since", "poll"))
    stem = F.lower(F.regexp_replace("path", r"\.[^./]*$", ""))
    rows = rows.withColumn("_stem", stem)
    several = rows.groupBy("_stem").agg((F.count(F.lit(1)) > 1).alias("_pair"))
    wait = polls + F.when(F.col("_pair"), 0).otherwise(grace)
    due = F.col("poll") - F.col("since") + 1 >= wait
    taken = F.coalesce("_taken", F.lit(False))
    rows = rows.join(several, "_stem").withColumns({"ready": due & ~taken, "taken": due | taken})
    return rows.select("path", "size", "poll", "since", "ready", "taken")


def failure_window(failures: DataFrame, seconds: int) -> DataFrame:
    """Each failure with the number of failures of its key in the last ``seconds``, itself included.

    With a column ``ok`` (true: a success) the count begins anew after each success, and successes themselves count 0.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    if "ok" not in failures.columns:
        w = Window.partitionBy("key").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
        return failures.withColumn("recent", F.count(F.lit(1)).over(w))
    ok = F.coalesce("ok", F.lit(False))
    so_far = Window.partitionBy("key").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(ok, 1).otherwise(0)).over(so_far)
    w = Window.partitionBy("key", "_run").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return failures.withColumn("_run", run).withColumn("recent", F.when(ok, 0).otherwise(F.count_if(~ok).over(w))).drop("_run")


def emit_once(assessments: DataFrame, emit_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to emit, rows an operator must look at): a row whose emission began but isn't known to have ended is never sent again by itself."""
    state = emit_log.groupBy("job_id").agg(F.max(F.col("state") == "emitted").alias("ended"))
    joined = assessments.join(state, "job_id", "left")
    return joined.where(F.col("ended").isNull()).drop("ended"), joined.where(~F.col("ended")).drop("ended")
