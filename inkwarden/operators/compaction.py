"""Consolidation of partitions made of many small files.

Planning works on file listings only. Rewriting touches nothing but the planned partitions. Each rewrite has a version: a
snapshot of the files it read, the merged files it wrote (staged by dynamic partition overwrite, so that staging again
replaces only its own partitions), and markers of how far it came. Publishing moves the merged files beside the old ones
and then deletes exactly the files of the snapshot, by name; a record that arrives meanwhile is never overwritten.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwarden.session import file_system, setting, whole_timestamps

TARGET_BYTES = 128 * 1024 * 1024
WAVE_FILES = 50_000
AT_ONCE = 16  # moves and deletions under way together

# Fixed value: the characters that Spark writes as %XX in the folder name of a partition.
_ESCAPED = frozenset({chr(c) for c in range(1, 32)} | set("\x7f\"#%'*/:=?\\{[]^"))


def current_files(listings: DataFrame) -> DataFrame:
    """State of every (index_partition, file_name): its listing with the latest listed_at (ties: highest listing_id).

    Rows with a null partition or file name describe no file and are left out; a null listed_at sorts before any other.
    """
    order = F.struct("listed_at", "listing_id")
    state = F.struct("present", "bytes", "n_rows")
    return (
        listings.where(F.col("index_partition").isNotNull() & F.col("file_name").isNotNull())
        .groupBy("index_partition", "file_name")
        .agg(F.max(F.struct(order.alias("at"), state.alias("state"))).alias("last"))
        .select("index_partition", "file_name", "last.state.*")
    )


def is_past_partition(partition: Column, today: str | None = None) -> Column:
    """Whether a partition's last part is a date other than ``today`` (the session's day where it isn't given)."""
    last = F.element_at(F.split(partition, "/"), -1)
    day = F.lit(today) if today else F.date_format(F.current_date(), "yyyy-MM-dd")
    return last.rlike(r"^dt=\d{4}-\d{2}-\d{2}$") & (last != F.concat(F.lit("dt="), day))


def counting_files(listings: DataFrame, today: str | None = None) -> DataFrame:
    """Files that count: present in their latest listing, Parquet, and in a dated partition other than today's."""
    wanted = listings.where(F.col("file_name").endswith(".parquet") & is_past_partition(F.col("index_partition"), today))
    return current_files(wanted).where(F.col("present"))


def plan(listings: DataFrame, today: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """One row per partition worth compacting (more than one counting file): partition, files, bytes_before, files_after.

    A file whose size is unknown counts with 0 bytes. An empty listing gives an empty plan.
    """
    return (
        counting_files(listings, today)
        .groupBy(F.col("index_partition").alias("partition"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).cast("long").alias("bytes_before"))
        .where("files > 1")
        .withColumn("files_after", F.greatest(F.lit(1), F.ceil(F.col("bytes_before") / F.lit(target_bytes))).cast("int"))
    )


def planned_files(listings: DataFrame, today: str | None = None) -> DataFrame:
    """Every counting file of a partition worth compacting. The count joins back by partition, so a partition that
    holds most of the files is split by the skew join rather than sorted in one task."""
    files = counting_files(listings, today)
    worth = files.groupBy("index_partition").agg(F.count(F.lit(1)).alias("_files")).where("_files > 1")
    return files.join(worth.select("index_partition"), "index_partition", "left_semi")


def each_record_once(records: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """One row per key (nulls compare equal): the one that is greatest by ``newest``, nulls last. Extra columns stay."""
    order = [F.col(c).desc_nulls_last() for c in newest]
    return (
        records.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        .where("_rank = 1")
        .drop("_rank")
    )


def well_sized(records: DataFrame, plan_rows: DataFrame, by: str, key: list[str], number: str = "_file") -> DataFrame:
    """Spreads each planned partition over its planned number of files, by a hash of the key, so a huge partition is no one
    task. ``number`` is added: the file a record goes to. Records of partitions outside the plan don't appear.
    """
    size = plan_rows.select(F.col("partition").alias("_partition"), F.col("files_after").alias("_files_after"))
    numbered = records.join(size, F.col(by) == F.col("_partition")).withColumn(number, F.pmod(F.xxhash64(*key), F.col("_files_after")))
    return numbered.repartition(by, number).drop("_partition", "_files_after")


class Conflict(RuntimeError):
    """Files of a planned partition changed after planning."""


class PartitionedTable:
    """A Parquet directory partitioned by one column, with a version log beside it.

    ``_versions/v<N>`` holds, for each rewrite, the snapshot of what it read (value, file_name, mark) and the records of how
    far it came, each created once and whole: ``claimed`` (no second rewrite can take the number), ``staged`` (merged files
    by partition), ``placed`` (all merged files stand beside the old ones: from here on readers take them instead of the
    snapshot's files; it names the partitions left alone as changed) and ``done``. Read the table by :meth:`read`: it sees
    every record once in every state.
    """

    def __init__(self, spark: SparkSession, root: str, by: str, schema: T.StructType | str | None = None):
        """``schema`` is the table's schema without the partition column; files that lack a column give null, and a
        column may be wider than in a file (int as long). Without it the schemas of all files are merged by name."""
        self.spark, self.root, self.by = spark, root.rstrip("/"), by
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._fs, _ = file_system(spark, self.root)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    @staticmethod
    def _leaf(value: str, by: str) -> str:
        return f"{by}=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)

    def _names(self, *parts: str) -> list[str]:
        """Names of the entries of one folder of the log; none where there is no folder."""
        at = self._path(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _listing(self, values: Iterable[str], below: str = "") -> dict[str, dict[str, str]]:
        """Data files of some partitions, listed by the engine: value -> path below the partition -> size:modified."""
        found: dict[str, dict[str, str]] = {v: {} for v in values}
        leaves = {self._leaf(v, self.by): v for v in found}
        folders = [f"{self.root}/{below}{leaf}" for leaf in leaves if self._fs.exists(self._path(below + leaf))]
        if folders:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
            rest = F.element_at(F.split("path", f"/{self.by}="), -1)
            files = files.select(rest.alias("at"), "length", F.unix_millis("modificationTime").alias("ms")).where(F.endswith("path", F.lit(".parquet")))
            for at, length, ms in files.toPandas().itertuples(index=False, name=None):
                leaf, _, name = at.partition("/")
                found[leaves[f"{self.by}={leaf}"]][name] = f"{length}:{ms}"
        return found

    def files(self, value: str) -> list[str]:
        """name:size:modified of each data file of one partition."""
        return sorted(f"{name}:{mark}" for name, mark in self._listing([value])[value].items())

    def _each(self, work, things: Iterable) -> None:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for _ in pool.map(work, things):
                pass

    # --- versions ---

    def versions(self) -> list[int]:
        return sorted(int(name[1:]) for name in self._names("_versions") if name.startswith("v"))

    def _log(self, version: int, name: str) -> str:
        return f"_versions/v{version:08d}/{name}"

    def _record(self, version: int, name: str, body) -> None:
        """Writes a record whole or not at all: under another name first, then renamed, which fails where it exists."""
        at, draft = self._path(self._log(version, name)), self._path(self._log(version, f"_{name}.draft"))
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            raise RuntimeError(f"another process works on version {version}")

    def _recorded(self, version: int, name: str):
        stream = self._fs.open(self._path(self._log(version, name)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def state(self, version: int) -> str:
        return next((s for s in ("done", "placed", "staged") if self._fs.exists(self._path(self._log(version, s)))), "claimed")

    def _snapshot(self, version: int) -> DataFrame:
        return self.spark.read.schema("value string, file_name string, mark string").parquet(f"{self.root}/{self._log(version, 'snapshot')}")

    @staticmethod
    def _prefix(version: int) -> str:
        return f"compacted-v{version:08d}-"

    # --- reading ---

    def _read(self, *folders: str) -> DataFrame:
        """Records with ``_value`` (partition) and ``_name`` (file); partition values stay the text they are."""
        reader = self.spark.read.option("basePath", self.root)
        reader = reader.option("mergeSchema", "true") if self.schema is None else reader.schema(
            T.StructType([f for f in self.schema.fields if f.name != self.by] + [T.StructField(self.by, T.StringType())])
        )
        with setting(self.spark, "spark.sql.sources.partitionColumnTypeInference.enabled", "false"):
            return reader.parquet(*folders).withColumns({"_value": F.col(self.by), "_name": F.col("_metadata.file_name")})

    def read(self) -> DataFrame:
        """Every record once: merged files that aren't all in place yet, and old files already merged, aren't read."""
        out = self._read(self.root)
        for v in self.versions():
            state = self.state(v)
            if state == "staged":
                out = out.where(~F.startswith("_name", F.lit(self._prefix(v))))
            elif state == "placed":
                merged = self._snapshot(v).where(~F.col("value").isin(self._recorded(v, "placed")))
                merged = merged.select(F.col("value").alias("_value"), F.col("file_name").alias("_name"))
                out = out.join(merged, ["_value", "_name"], "left_anti")
        return out.drop("_value", "_name")

    # --- rewriting ---

    def compact(self, plan_rows: DataFrame, key: list[str], newest: list[str], target_rows: int | None = None, wave_files: int = WAVE_FILES) -> int:
        """Rewrites the planned partitions, every record once; returns the last version.

        ``plan_rows`` is the output of :func:`plan`. The partitions are taken in waves of about ``wave_files`` files, each
        a version of its own, so that only one wave's file names (of one partition at least) are held together; the plan
        is streamed through the driver, the records never leave the executors. Partitions that change meanwhile are left
        alone; when all waves are through they raise :class:`Conflict`.
        """
        wave: dict[str, int] = {}
        size, version, changed = 0, 0, []
        rows = plan_rows.select("partition", F.col("files").cast("long"), "files_after").orderBy("partition")
        for r in rows.toLocalIterator():
            wave[r["partition"]] = r["files_after"]
            size += r["files"]
            if size >= wave_files:
                version = self._rewrite(wave, key, newest, target_rows, changed)
                wave, size = {}, 0
        if wave or not version:
            version = self._rewrite(wave, key, newest, target_rows, changed)
        if changed:
            raise Conflict(f"{len(changed)} partitions changed after planning: {changed[:3]}")
        return version

    def _rewrite(self, wave: dict[str, int], key: list[str], newest: list[str], target_rows: int | None, changed: list[str]) -> int:
        version = max(self.versions(), default=0) + 1
        self._fs.create(self._path(self._log(version, "claimed")), False).close()
        rows = [(value, name, mark) for value, names in self._listing(wave).items() for name, mark in names.items()]
        snapshot = self.spark.createDataFrame(rows, "value string, file_name string, mark string")
        snapshot.coalesce(1).write.parquet(f"{self.root}/{self._log(version, 'snapshot')}")
        held = sorted({r[0] for r in rows})
        if held:
            self._stage(version, {v: wave[v] for v in held}, key, newest, target_rows)
        staged = self._listing(held, f"_staged/v{version:08d}/")
        self._record(version, "staged", {v: sorted(names) for v, names in staged.items()})
        try:
            self.publish(version)
        except Conflict as e:
            changed += e.args[1:]
        return version

    def _stage(self, version: int, wave: dict[str, int], key: list[str], newest: list[str], target_rows: int | None) -> None:
        """Merged files below ``_staged``, read from exactly the files of the snapshot."""
        read = self._snapshot(version).select(F.col("value").alias("_value"), F.col("file_name").alias("_name"))
        held = self._read(*[f"{self.root}/{self._leaf(v, self.by)}" for v in wave]).join(read, ["_value", "_name"], "left_semi").drop("_value", "_name")
        sizes = self.spark.createDataFrame(sorted(wave.items()), "partition string, files_after int")
        merged = well_sized(each_record_once(held, [self.by, *key], newest), sizes, self.by, key)
        writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by, "_file")
        with whole_timestamps(self.spark):
            (writer.option("maxRecordsPerFile", target_rows) if target_rows else writer).parquet(f"{self.root}/_staged/v{version:08d}")

    def publish(self, version: int) -> None:
        """Puts a staged version in the place of its snapshot; partitions that changed since raise :class:`Conflict` untouched.

        Can be called again from any state after a crash. Only files named in the snapshot are ever deleted, and each only
        while it is still the file that was read.
        """
        state = self.state(version)
        if state in ("claimed", "done"):
            return
        if state == "staged":
            self._record(version, "placed", self._place(version))
        changed = self._recorded(version, "placed")
        read = {(r["value"], r["file_name"]): r["mark"] for r in self._snapshot(version).where(~F.col("value").isin(changed)).toLocalIterator()}
        now = self._listing({value for value, _ in read})
        still = [(value, name) for (value, name), mark in read.items() if now[value].get(name) == mark]
        self._each(lambda f: self._fs.delete(self._path(self._leaf(f[0], self.by), f[1]), False), still)
        self._fs.delete(self._path("_staged", f"v{version:08d}"), True)
        self._record(version, "done", changed)
        if changed:
            raise Conflict(f"{len(changed)} partitions changed after planning", *changed)

    def _place(self, version: int) -> list[str]:
        """Moves the merged files of every unchanged partition beside its old ones; returns the changed partitions.

        The names of merged files are given by the record ``staged``, so a try that broke off is taken up again.
        """
        prefix, staged = self._prefix(version), self._recorded(version, "staged")
        expected: dict[str, dict[str, str]] = {}
        for r in self._snapshot(version).toLocalIterator():
            expected.setdefault(r["value"], {})[r["file_name"]] = r["mark"]
        now = self._listing(expected)
        same = {v for v, marks in expected.items() if {n: m for n, m in now[v].items() if not n.startswith(prefix)} == marks}
        changed = sorted(expected.keys() - same)
        left = [(v, n) for v in changed for n in now[v] if n.startswith(prefix)]  # of an earlier try
        self._each(lambda f: self._fs.delete(self._path(self._leaf(f[0], self.by), f[1]), False), left)

        def move(one: tuple[str, str]) -> None:
            leaf = self._leaf(one[0], self.by)
            self._fs.rename(self._path("_staged", f"v{version:08d}", leaf, one[1]), self._path(leaf, self._merged_name(version, one[1])))

        self._each(move, [(v, n) for v in same for n in staged[v] if self._merged_name(version, n) not in now[v]])
        after = self._listing(same)
        if lost := [v for v in same for n in staged[v] if self._merged_name(version, n) not in after[v]]:
            raise RuntimeError(f"merged files of {lost[:3]} are missing; version {version} can't be published")
        return changed

    def _merged_name(self, version: int, staged: str) -> str:
        return self._prefix(version) + staged.replace("/", "-").replace("=", "")

    def recover(self) -> list[int]:
        """Publishes versions that a crash left between staging and the end; partitions changed since are left alone.

        To be called while no rewrite is running. A version that broke off before it was staged changed nothing.
        """
        pending = [v for v in self.versions() if self.state(v) in ("staged", "placed")]
        for v in pending:
            try:
                self.publish(v)
            except Conflict:
                continue
        return pending
