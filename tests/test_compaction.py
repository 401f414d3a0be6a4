from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from inkwarden.operators import compaction as C

LISTING = "listing_id long, index_partition string, file_name string, bytes long, n_rows int, modified_at timestamp, listed_at timestamp, present boolean"


def listing(spark, rows):
    return spark.createDataFrame(
        [(i, p, f, b, 1, None, t and D(2026, 1, t), pres) for i, (p, f, b, t, pres) in enumerate(rows)], LISTING
    )


def test_latest_listing_decides(spark):
    rows = [
        ("s/dt=2026-01-01", "a.parquet", 10, 2, True),
        ("s/dt=2026-01-01", "a.parquet", 10, 1, False),
        ("s/dt=2026-01-01", "b.parquet", None, 1, True),
        ("s/dt=2026-01-01", "c.parquet", 5, 3, False),
        ("s/dt=2026-01-01", "c.parquet", 5, 1, True),
        ("s/dt=2026-01-01", "note.txt", 5, 1, True),
        ("s/dt=2026-03-31", "a.parquet", 5, 1, True),
        ("s/dt=2026-03-31", "b.parquet", 5, 1, True),
        ("s/dt=2026-01-02", "a.parquet", 5, 1, True),
        (None, "x.parquet", 5, 1, True),
        ("s/dt=bad", "x.parquet", 5, 1, True),
        ("s/dt=bad", "y.parquet", 5, 1, True),
    ]
    got = C.plan(listing(spark, rows), "2026-03-31").collect()
    assert [(r.partition, r.files, r.bytes_before, r.files_after) for r in got] == [("s/dt=2026-01-01", 2, 10, 1)]
    files = C.planned_files(listing(spark, rows), "2026-03-31").collect()
    assert sorted(r.file_name for r in files) == ["a.parquet", "b.parquet"]


def test_empty_listing(spark):
    assert C.plan(listing(spark, [])).count() == 0


def many_small_files(spark, root):
    df = spark.range(60).select(
        F.concat(F.lit("s/dt=2026-01-0"), (F.col("id") % 2 + 1).cast("string")).alias("part"),
        F.col("id").alias("job_id"),
        F.lit(1).alias("seq"),
        F.when(F.col("id") > 3, F.lit("x")).alias("_rank_note"),
    )
    df.union(df.where("id < 10" if "id" in df.columns else "job_id < 10")).repartition(6).write.partitionBy("part").parquet(root)
    return C.PartitionedTable(spark, root, "part")


def plan_of(spark, t, parts):
    return spark.createDataFrame([(p, len(t.files(p)), 1) for p in parts], "partition string, files int, files_after int")


def test_rewrite_keeps_each_record_once(spark, tmp_path):
    t = many_small_files(spark, str(tmp_path / "t"))
    part = "s/dt=2026-01-01"
    other = t.files("s/dt=2026-01-02")
    assert len(t.files(part)) > 1
    version = t.compact(plan_of(spark, t, [part]), ["job_id", "seq"], ["_rank_note"])
    assert version == 1 and len(t.files(part)) == 1
    assert t.files("s/dt=2026-01-02") == other
    got = spark.read.parquet(t.root).where(F.col("part") == part)
    assert sorted(r.job_id for r in got.collect()) == list(range(0, 60, 2))


def test_conflict_leaves_the_partition_alone(spark, tmp_path, monkeypatch):
    t = many_small_files(spark, str(tmp_path / "t"))
    part = "s/dt=2026-01-01"
    publish = t.publish

    def late_writer(version):
        spark.range(100, 101).selectExpr("id as job_id", "1 as seq", "'n' as _rank_note").write.mode("append").parquet(
            f"{t.root}/{t._leaf(part, 'part')}"
        )
        publish(version)

    monkeypatch.setattr(t, "publish", late_writer)
    with pytest.raises(C.Conflict):
        t.compact(plan_of(spark, t, [part]), ["job_id", "seq"], ["_rank_note"])
    got = spark.read.parquet(t.root).where(F.col("part") == part)
    assert got.where("job_id = 100").count() == 1
    assert got.select("job_id").distinct().count() == 31
    assert t.recover() == []


def test_crash_before_publishing_is_recovered(spark, tmp_path, monkeypatch):
    t = many_small_files(spark, str(tmp_path / "t"))
    part = "s/dt=2026-01-01"
    monkeypatch.setattr(t, "publish", lambda version: None)
    t.compact(plan_of(spark, t, [part]), ["job_id", "seq"], ["_rank_note"])
    assert len(t.files(part)) > 1
    monkeypatch.undo()
    assert t.recover() == [1]
    assert len(t.files(part)) == 1
    assert t.recover() == []


def append(spark, t, part, job, **columns):
    row = spark.range(job, job + 1).selectExpr("id as job_id", "1 as seq", "'n' as _rank_note")
    for name, value in columns.items():
        row = row.withColumn(name, F.lit(value))
    row.coalesce(1).write.mode("append").parquet(f"{t.root}/{t._leaf(part, 'part')}")


class Crash(Exception):
    pass


def crash(*_, **__):
    raise Crash


def jobs(t, part):
    return sorted(r.job_id for r in t.read().where(F.col("part") == part).collect())


@pytest.mark.parametrize("broken", ["publish", "_place", "_each", "_record_done"])
def test_crash_at_any_point_and_a_late_record(spark, tmp_path, monkeypatch, broken):
    """A record appended after a crash survives recovery, and every state shows each record once."""
    t = many_small_files(spark, str(tmp_path / "t"))
    part = "s/dt=2026-01-01"
    before = list(range(0, 60, 2))
    if broken == "_record_done":
        record = t._record
        monkeypatch.setattr(t, "_record", lambda v, name, body: crash() if name == "done" else record(v, name, body))
    else:
        monkeypatch.setattr(t, broken, crash)
    with pytest.raises(Crash):
        t.compact(plan_of(spark, t, [part]), ["job_id", "seq"], ["_rank_note"])
    monkeypatch.undo()
    assert len(set(jobs(t, part))) == 30 and t.state(1) == ("placed" if broken == "_record_done" else "staged")
    append(spark, t, part, 100)
    assert set(jobs(t, part)) == {*before, 100}
    assert t.recover() == [1] and t.recover() == []
    assert set(jobs(t, part)) == {*before, 100}
    if broken == "_record_done":  # placed before the crash: the merged files stay, the late one stays beside them
        assert jobs(t, part) == [*before, 100] and len(t.files(part)) == 2
    t.compact(plan_of(spark, t, [part]), ["job_id", "seq"], ["_rank_note"])
    assert jobs(t, part) == [*before, 100] and len(t.files(part)) == 1
    assert not any(n.startswith("v") for n in t._names("_staged"))


def test_a_record_that_comes_while_old_files_are_deleted(spark, tmp_path, monkeypatch):
    t = many_small_files(spark, str(tmp_path / "t"))
    part, each = "s/dt=2026-01-01", t._each

    def racing(work, things):
        append(spark, t, part, 200)
        each(work, things)

    place = t._place
    monkeypatch.setattr(t, "_place", lambda v: (place(v), monkeypatch.setattr(t, "_each", racing))[0])
    t.compact(plan_of(spark, t, [part]), ["job_id", "seq"], ["_rank_note"])
    assert jobs(t, part) == [*range(0, 60, 2), 200]


def test_a_changed_partition_leaves_the_others_compacted(spark, tmp_path, monkeypatch):
    t = many_small_files(spark, str(tmp_path / "t"))
    one, two = "s/dt=2026-01-01", "s/dt=2026-01-02"
    publish = t.publish
    monkeypatch.setattr(t, "publish", lambda v: (append(spark, t, two, 300), publish(v)))
    with pytest.raises(C.Conflict):
        t.compact(plan_of(spark, t, [one, two]), ["job_id", "seq"], ["_rank_note"])
    assert len(t.files(one)) == 1 and set(jobs(t, two)) == {*range(1, 60, 2), 300}


def test_waves_and_file_counts(spark, tmp_path):
    t = many_small_files(spark, str(tmp_path / "t"))
    parts = ["s/dt=2026-01-01", "s/dt=2026-01-02"]
    plan = plan_of(spark, t, parts).withColumn("files_after", F.lit(3))
    assert t.compact(plan, ["job_id", "seq"], ["_rank_note"], wave_files=1) == 2
    assert [len(t.files(p)) for p in parts] == [3, 3]
    assert jobs(t, parts[0]) == list(range(0, 60, 2))


def test_columns_of_files_of_mixed_age_and_microseconds(spark, tmp_path):
    root = str(tmp_path / "t")
    t = C.PartitionedTable(spark, root, "part", "job_id long, seq int, at timestamp, pending boolean, n long")
    old = spark.createDataFrame([(1, 1, D(2026, 1, 1, 1, 2, 3, 123456), 7)], "job_id long, seq int, at timestamp, n int")
    new = spark.createDataFrame([(2, 1, True, 1 << 40)], "job_id long, seq int, pending boolean, n long")
    for k, df in enumerate([old, old.withColumn("job_id", F.lit(3).cast("long")), new]):
        df.write.mode("append").parquet(f"{root}/part=ü {k // 9}")
    t.compact(plan_of(spark, t, ["ü 0"]), ["job_id", "seq"], ["at"])
    assert len(t.files("ü 0")) == 1
    got = {r.job_id: r for r in spark.read.parquet(root).collect()}
    assert got[1].at == D(2026, 1, 1, 1, 2, 3, 123456) and got[1].pending is None and got[1].n == 7
    assert got[2].pending is True and got[2].n == 1 << 40 and got[2].at is None and len(got) == 3
    merged = C.PartitionedTable(spark, str(tmp_path / "u"), "part")
    old.write.parquet(f"{merged.root}/part=a")
    new.drop("n").write.mode("append").parquet(f"{merged.root}/part=a")
    merged.compact(plan_of(spark, merged, ["a"]), ["job_id"], ["at"])
    assert {(r.job_id, r.pending, r.n) for r in spark.read.parquet(merged.root).collect()} == {(1, None, 7), (2, True, None)}


def test_nothing_planned(spark, tmp_path):
    t = many_small_files(spark, str(tmp_path / "t"))
    assert t.compact(plan_of(spark, t, []), ["job_id", "seq"], ["_rank_note"]) == 1
