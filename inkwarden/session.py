"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import contextlib
import hashlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", app: str = "inkwarden", **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own (tests); a cluster is refused, as its machines share none.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="inkwarden-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) by Hadoop's API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


_announced: set[str] = set()


def application_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when its JVM ends."""
    where = f"{shared_dir(spark)}/inkwarden/{spark.sparkContext.applicationId}"
    if where not in _announced:
        fs, at = file_system(spark, where)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _announced.add(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting that holds for one block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_timestamps(spark: SparkSession):
    """Parquet written inside keeps microseconds, whatever the session was set to."""
    return setting(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


def materialise(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Cuts lineage: writes ``df`` once as Parquet in the shared folder and reads it back.

    The files outlive any executor, so a later stage never recomputes the branches that led here. They go when the
    application ends, or earlier by :func:`discard`. ``rows``: most rows of a file, if not 0.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with whole_timestamps(spark):
        df.write.option("maxRecordsPerFile", rows).mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for df in stored:
        if path := getattr(df, "_stored_at", None):
            fs, at = file_system(df.sparkSession, path)
            fs.delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{home.name}/{p.relative_to(home)}"), p.read_bytes())
    body = held.getvalue()
    where = f"{application_dir(spark)}/lib/{home.name}-{hashlib.sha256(body).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}.zip"
    fs, at = file_system(spark, where)
    out = fs.create(at)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
    sc.addPyFile(where)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
