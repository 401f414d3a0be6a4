"""The hash-chained audit log: one JSON record a line, each naming the hash of the one before.

Table form: (dt, line_no, raw). Appending is serial by nature; verifying is not: hashes are checked independently and
each record is compared with its predecessor within its day, the days being linked through one small row each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What stands in the place of redacted content, and the fields that carry the chain.
BLANK = "[redacted]"
PROTECTED = frozenset({"seq", "ts", "event", "prev", "hash", "redacted"})
LOG = "dt string, line_no long, raw string"


def protected(record: dict) -> frozenset[str]:
    """Fields that can't be redacted: those of the chain, and on the record of a redaction what it says was taken away."""
    return PROTECTED | {"redacted_seq", "fields"} if record.get("event") == "audit.redacted" else PROTECTED


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


def record_hash(record: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in record.items() if k != "hash"}).encode()).hexdigest()


def chained(events: Iterable[dict], seq: int = 0, head: str | None = None) -> list[dict]:
    """Events in order as records that go on from the given head."""
    out = []
    for e in events:
        seq += 1
        record = {"seq": seq, **e, "prev": head}
        record["hash"] = head = record_hash(record)
        out.append(record)
    return out


def linked(records: DataFrame) -> DataFrame:
    """(dt, line_no, raw) with each record linked to the one before, over all days: one task that reads the sorted records as
    a stream and holds one hash, as a chain has an order. Each raw is a JSON object without prev and hash."""

    def run(batches):
        head = None
        for b in batches:
            out = []
            for raw in b["raw"]:
                record = {**json.loads(raw), "prev": head}
                record["hash"] = head = record_hash(record)
                out.append(json.dumps(record))
            yield b.assign(raw=out)

    return records.select("dt", "line_no", "raw").coalesce(1).sortWithinPartitions("dt", "line_no").mapInPandas(run, LOG)


def read_log(spark, root: str) -> DataFrame:
    """The log below ``root``; none yet is an empty one."""
    from inkwarden.session import file_system

    fs, at = file_system(spark, root)
    return spark.read.schema(LOG).json(root) if fs.exists(at) else spark.createDataFrame([], LOG)


def head_of(log: DataFrame, checkpoint: dict | None = None) -> tuple[int, str | None]:
    """(seq, hash) of the last readable record: the newest day is read, an earlier one only where it has none, then the
    checkpoint. Days are listed by the partition column, one small row each."""
    for day in [r["dt"] for r in log.select("dt").distinct().orderBy(F.desc("dt")).toLocalIterator()]:
        last = parsed(log.where(F.col("dt") == day)).where("NOT is_bad").agg(F.max_by(F.struct("seq", "hash"), "seq").alias("last")).first()["last"]
        if last:
            return last["seq"], last["hash"]
    return (checkpoint["seq"], checkpoint["hash"]) if checkpoint else (0, None)


def append(spark, log: DataFrame | None, events: list[dict], root: str, checkpoint: dict | None = None) -> DataFrame:
    """Appends events (each with ts, event) after the last readable record; one writer at a time. Returns the new rows."""
    seq, head = head_of(log, checkpoint) if log is not None else (0, None)
    rows = [(r["ts"][:10], r["seq"], json.dumps(r)) for r in chained(events, seq, head)]
    df = spark.createDataFrame(rows, LOG)
    df.write.mode("append").partitionBy("dt").json(root)
    return df


def event_at(log: DataFrame, seq: int) -> DataFrame:
    """The record of one number; unreadable lines have none."""
    return parsed(log).where(F.col("seq") == seq)


def parsed(log: DataFrame) -> DataFrame:
    """log plus seq, event, job_id, ts, prev, hash and is_bad (no readable JSON object with a seq)."""
    field = lambda name: F.get_json_object("raw", f"$.{name}")
    return log.withColumns(
        {n: field(n) for n in ("event", "job_id", "ts", "prev", "hash")} | {"seq": field("seq").cast("long")}
    ).withColumn("is_bad", F.col("seq").isNull())


def _computed(raw: str) -> str | None:
    try:
        return record_hash(json.loads(raw))
    except (ValueError, TypeError, AttributeError):
        return None


def _blanked(raw: str) -> list[str] | None:
    try:
        return sorted(k for k, v in json.loads(raw).items() if v == BLANK)
    except (ValueError, TypeError, AttributeError):
        return None


def _marked(raw: str):
    return F.from_json(F.get_json_object(raw, "$.redacted.fields"), "array<string>")


def verify(log: DataFrame, redactions_allowed: bool = True, checkpoint: str | None = None) -> DataFrame:
    """Breaks of the chain: dt, line_no, seq, problem in (unreadable, altered, unlinked). No rows: the chain holds.

    A record marked as redacted keeps its old hash; it is no break if audit.redacted records name every field that its
    marker names and every field that is blanked. Unreadable lines are breaks; the record after one is compared with the
    last readable one. ``checkpoint`` is the hash before the first record kept.
    """
    @F.pandas_udf("string")
    def computed(raws: pd.Series) -> pd.Series:
        return raws.map(_computed)

    rows = parsed(log).withColumn("computed", computed("raw"))
    good = rows.where("NOT is_bad")
    day = Window.partitionBy("dt").orderBy("line_no")
    linked = good.withColumn("before", F.lag("hash").over(day)).withColumn("first", F.row_number().over(day) == 1)
    ends = good.groupBy("dt").agg(F.max_by("hash", "line_no").alias("end"))
    days = ends.withColumn("carried", F.coalesce(F.lag("end").over(Window.orderBy("dt")), F.lit(checkpoint))).select("dt", "carried")  # one row a day
    linked = linked.join(days, "dt").withColumn("before", F.when(F.col("first"), F.col("carried")).otherwise(F.col("before")))
    unlinked = linked.where(~F.col("prev").eqNullSafe(F.col("before"))).select("dt", "line_no", "seq", F.lit("unlinked").alias("problem"))
    altered = good.where(~F.col("computed").eqNullSafe(F.col("hash")))
    if redactions_allowed:
        @F.pandas_udf("array<string>")
        def blanked(raws: pd.Series) -> pd.Series:
            return raws.map(_blanked)

        events = good.where("event = 'audit.redacted'")
        fields = F.from_json(F.get_json_object("raw", "$.fields"), "array<string>")
        named = events.groupBy(F.get_json_object("raw", "$.redacted_seq").cast("long").alias("seq")).agg(F.flatten(F.collect_list(fields)).alias("named"))
        taken = F.array_union("blanked", F.coalesce("marked", F.array().cast("array<string>")))
        altered = altered.withColumns({"blanked": blanked("raw"), "marked": _marked("raw")}).join(named, "seq", "left")
        explained = F.col("marked").isNotNull() & (F.size(F.array_except(taken, "named")) == 0)
        altered = altered.where(~F.coalesce(explained, F.lit(False)))
    altered = altered.select("dt", "line_no", "seq", F.lit("altered").alias("problem"))
    unreadable = rows.where("is_bad").select("dt", "line_no", "seq", F.lit("unreadable").alias("problem"))
    return unlinked.unionByName(altered).unionByName(unreadable)


def redactions(log: DataFrame) -> DataFrame:
    """Records marked as redacted: dt, line_no, seq, fields. To be shown beside the breaks."""
    return parsed(log).where("NOT is_bad").select("dt", "line_no", "seq", _marked("raw").alias("fields")).where("fields IS NOT NULL")


def chain_verdict(log: DataFrame, checkpoint: str | None = None) -> dict[str, int | bool]:
    """ok (no breaks), breaks, redactions."""
    breaks = verify(log, checkpoint=checkpoint).count()
    return {"ok": breaks == 0, "breaks": breaks, "redactions": redactions(log).count()}


def without(record: dict, names: Iterable[str]) -> dict:
    """A record with fields blanked and marked as redacted; earlier redactions stay named. Protected and absent fields are
    refused, and then nothing is blanked."""
    names = sorted(set(names))
    if not names or any(n in protected(record) or n not in record for n in names):
        raise ValueError("no field, or one that is protected or absent")
    marked = sorted({*names, *record.get("redacted", {}).get("fields", [])})
    return {**record, **dict.fromkeys(names, BLANK), "redacted": {"fields": marked}}


def redact(records: list[dict], seq: int, names: list[str], ts: str) -> list[dict]:
    """One day's records with fields of one event blanked, and the audit.redacted event to append."""
    target = next((r for r in records if r.get("seq") == seq), None)
    if target is None:
        raise ValueError(f"no event {seq}")
    changed = without(target, names)
    event = {"ts": ts, "event": "audit.redacted", "redacted_seq": seq, "fields": sorted(set(names))}
    return [*(changed if r is target else r for r in records), event]


def redact_log(spark, root: str, seq: int, names: list[str], reason: str, actor: str, ts: str) -> DataFrame:
    """The same in a log that is stored: the event's day is rewritten by way of a staged copy, then the record of it is
    appended. A crash in between leaves a break that :func:`verify` shows, never a record of what didn't happen."""
    from inkwarden.session import materialise

    log = read_log(spark, root)
    found = event_at(log, seq).select("dt", "line_no", "raw").first()
    if found is None:
        raise ValueError(f"no event {seq}")
    new = canonical(without(json.loads(found["raw"]), names))
    mine = (F.col("line_no") == found["line_no"]) & (F.col("raw") == found["raw"])
    day = materialise(log.where(F.col("dt") == found["dt"]).withColumn("raw", F.when(mine, F.lit(new)).otherwise(F.col("raw"))), "redacted-day")
    day.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").json(root)
    event = {"ts": ts, "event": "audit.redacted", "redacted_seq": seq, "fields": sorted(set(names)), "reason": reason, "actor": actor}
    return append(spark, read_log(spark, root), [event], root)


def timeline(log: DataFrame, job_id: str, since: str | None = None) -> DataFrame:
    """A job's events in order; a substring test comes before the parse."""
    rows = log.where(F.col("raw").contains(f'"{job_id}"'))
    if since:
        rows = rows.where(F.col("dt") >= since)
    return parsed(rows).where(F.col("job_id") == job_id).orderBy("seq")


def page(log: DataFrame, before: int | None = None, limit: int = 100, start: str | None = None, end: str | None = None) -> DataFrame:
    """Newest events first, keyset paging by seq, one row more than asked for."""
    rows = log
    if start:
        rows = rows.where(F.col("dt") >= start)
    if end:
        rows = rows.where(F.col("dt") <= end)
    rows = parsed(rows).where("NOT is_bad")
    return (rows.where(F.col("seq") < before) if before is not None else rows).orderBy(F.desc("seq")).limit(limit + 1)


def jobs_with_event(log: DataFrame, *events: str) -> DataFrame:
    return parsed(log).where(F.col("event").isin(*events)).select("job_id").distinct()


def trim_checkpoint(log: DataFrame, before_day: str) -> dict | None:
    """seq and hash of the last record before a day: what verify() needs once older days are dropped."""
    last = parsed(log.where(F.col("dt") < before_day)).where("NOT is_bad").agg(F.max_by(F.struct("seq", "hash"), "seq").alias("c")).first()["c"]
    return last and {"seq": last["seq"], "hash": last["hash"]}


def write_trim_checkpoint(spark, log: DataFrame, before_day: str, path: str) -> dict | None:
    """Stores the checkpoint (one JSON file) before older days are dropped; it never moves backwards."""
    from inkwarden.session import file_system

    new = trim_checkpoint(log, before_day)
    held = read_checkpoint(spark, path)
    if new is None or held and held["seq"] >= new["seq"]:
        return held
    fs, at = file_system(spark, path)
    draft = at.suffix(".draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
    finally:
        out.close()
    fs.delete(at, False)
    fs.rename(draft, at)
    return new


def read_checkpoint(spark, path: str) -> dict | None:
    """The stored checkpoint; a draft stands in for it where a crash came between deleting and renaming."""
    from inkwarden.session import file_system

    fs, at = file_system(spark, path)
    for where in (at, at.suffix(".draft")):
        if fs.exists(where):
            stream = fs.open(where)
            try:
                return json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
    return None
