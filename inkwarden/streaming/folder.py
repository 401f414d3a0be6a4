"""A drop folder as a stream of listings: every trigger lists it anew, so growth and disappearance of files show."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from inkwarden.session import file_system
from inkwarden.sources.readers import exists
from inkwarden.streaming.ingest import settle_step


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffixes = tuple(s.lower() for s in options.get("suffixes", "").split(",") if s)

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def read(self, start: dict):
        poll = start["poll"] + 1
        rows = []
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name):
            # links are refused: they could lead out of the folder
            if entry.is_file(follow_symlinks=False) and entry.name.lower().endswith(self.suffixes or ("",)):
                rows.append((poll, entry.path, entry.stat(follow_symlinks=False).st_size))
        return iter(rows), {"poll": poll}

    def readBetweenOffsets(self, start: dict, end: dict):
        # a listing can't be repeated; a batch run again sees the folder as it is now
        rows, _ = self.read({"poll": end["poll"] - 1})
        return rows


class FolderListings(DataSource):
    """``spark.readStream.format("folder_listings").option("path", ...)``: poll, path, size."""

    @classmethod
    def name(cls) -> str:
        return "folder_listings"

    def schema(self) -> str:
        return "poll int, path string, size long"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def listings(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(FolderListings)
    return spark.readStream.format("folder_listings").option("path", folder).option("suffixes", ",".join(suffixes)).load()


STATE = "path string, size long, poll int, since int, ready boolean, taken boolean"


def on_ready(state_root: str, take, polls: int = 2, grace: int = 0):
    """foreachBatch function: keeps each poll's state and hands files that have settled to ``take(df, batch_id)``, each once.

    Only the last poll's state is read, and only two are kept. A batch that runs again replaces its own state.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], STATE)
        if exists(spark, f"{state_root}/batch={batch_id - 1}"):
            before = spark.read.schema(STATE).parquet(f"{state_root}/batch={batch_id - 1}")
        settle_step(before, batch, polls, grace).write.mode("overwrite").parquet(f"{state_root}/batch={batch_id}")
        now = spark.read.schema(STATE).parquet(f"{state_root}/batch={batch_id}")
        take(now.where("ready").select("path", "size"), batch_id)
        fs, old = file_system(spark, f"{state_root}/batch={batch_id - 2}")
        fs.delete(old, True)

    return work
