import hashlib
import os
from datetime import datetime as D

import pytest

from inkwarden.operators import layout, store
from inkwarden.sources import adapters
from inkwarden.streaming import folder

BOX = "job_id string, page int, x0 double, y0 double, x1 double, y1 double"


def test_rows_and_overlap(spark):
    boxes = [("j", 1, 50.0, 0.0, 90.0, 10.0), ("j", 1, 0.0, 4.0, 40.0, 14.0), ("j", 1, 0.0, 8.0, 40.0, 18.0), ("j", 1, 0.0, 30.0, 9.0, 40.0)]
    df = spark.createDataFrame(boxes, BOX)
    got = {(r.x0, r.y0): (r.row, r.place) for r in layout.rows_of(df).collect()}
    assert got == {(0.0, 4.0): (0, 0), (50.0, 0.0): (0, 1), (0.0, 8.0): (1, 0), (0.0, 30.0): (2, 0)}
    native = spark.createDataFrame([("j", 1, 0.0, 30.0, 6.0, 40.0), ("j", 2, 50.0, 0.0, 90.0, 10.0)], BOX)
    assert layout.uncovered(df, native).count() == 3
    assert layout.rows_of(df.limit(0)).count() == 0


def test_adapters(spark):
    assert adapters.plain_text_lines(b" a \n\nb\fc") == [(1, "a", "native", None), (1, "b", "native", None), (2, "c", "native", None)]
    assert adapters.pdf_properties(b"junk") == {}
    assert adapters.raster_dpi(595, 842) == 300
    with pytest.raises(ValueError):
        adapters.raster_dpi(1e6, 1e6)
    df = spark.createDataFrame([(bytearray(b"x"),), (None,)], "c binary")
    assert [r[0] for r in df.select(adapters.content_id("c")).collect()] == [hashlib.blake2b(b"x", digest_size=16).hexdigest(), None]


def test_folder_stream(spark, tmp_path):
    where = tmp_path / "drop"
    where.mkdir()
    (where / "a.PDF").write_text("x")
    os.symlink(where / "a.PDF", where / "link.pdf")
    (where / "note.txt").write_text("x")
    taken = []
    work = folder.on_ready(str(tmp_path / "seen"), lambda df, n: taken.append(sorted(os.path.basename(r.path) for r in df.collect())))
    stream = folder.listings(spark, str(where), (".pdf",)).writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "cp"))
    q = stream.trigger(processingTime="1 seconds").start()
    for _ in range(60):
        if len(taken) >= 3:
            break
        q.awaitTermination(1)
    q.stop()
    assert taken[0] == [] and taken[1] == ["a.PDF"]


def test_retention_and_heartbeats(spark, tmp_path):
    root = str(tmp_path / "s")
    spark.createDataFrame([("a", "2025-12-01"), ("b", "2026-01-01")], "j string, dt string").write.partitionBy("dt").parquet(root)
    plan = spark.createDataFrame([("s", "2025-12-01"), ("s", "2020-01-01")], "store string, dt string")
    assert store.apply_retention(spark, plan, {"s": root}) == ["s/dt=2025-12-01"]
    assert [r.j for r in spark.read.parquet(root).collect()] == ["b"]
    beats = spark.createDataFrame([("w", D(2026, 1, 1, 12)), ("v", D(2026, 1, 1, 11)), ("u", D(2025, 12, 1))], "worker string, updated_at timestamp")
    assert {(r.worker, r.stale) for r in store.alive(beats, "2026-01-01 12:00:30").collect()} == {("w", False), ("v", True)}
