"""Most frequent values of columns in bounded memory.

Misra-Gries summaries are kept per partition and merged in a tree. A summary of capacity k over N occurrences
underestimates a count by at most N / (k + 1), so every value occurring more often than that is in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.session import materialise

SUMMARY = "slot int, field_name string, item string, count long, removed long"


def shrink(counts: pd.Series, capacity: int) -> tuple[pd.Series, int]:
    """At most ``capacity`` counters: the next-largest counter is subtracted from all. Returns them and what was subtracted."""
    if len(counts) <= capacity:
        return counts, 0
    cut = int(counts.nlargest(capacity + 1).iloc[-1])
    counts = counts - cut
    return counts[counts > 0], cut


def _rows(slot: int, field_name: str, counts: pd.Series, removed: int) -> pd.DataFrame:
    """A summary as rows; one without counters keeps its removed amount in a row with a null item."""
    items, n = (counts.index.astype(str), counts.to_numpy(dtype="int64")) if len(counts) else ([None], [0])
    return pd.DataFrame({"slot": slot, "field_name": field_name, "item": items, "count": n, "removed": removed})


def summarise(df: DataFrame, columns: list[str], capacity: int) -> DataFrame:
    """One summary per partition and column. Nulls aren't counted; values are compared as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {c: (pd.Series(dtype="int64"), 0) for c in columns}
        for batch in batches:
            for c in columns:
                counts, removed = held[c]
                counts = counts.add(batch[c].value_counts(), fill_value=0).astype("int64")
                counts, cut = shrink(counts, capacity)
                held[c] = counts, removed + cut
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        for c, (counts, removed) in held.items():
            if len(counts) or removed:
                yield _rows(slot, c, counts, removed)

    return df.select(*columns).mapInPandas(run, SUMMARY)


def merge(summaries: DataFrame, capacity: int, slots: int, fan_in: int = 16) -> DataFrame:
    """Merges summaries in a tree of ``fan_in``; a task holds at most fan_in * capacity counters of one column.

    Null items are no values: they carry the removed amounts of summaries without counters.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        removed = int(group.drop_duplicates("slot")["removed"].sum())
        counts, cut = shrink(group.groupby("item")["count"].sum(), capacity)
        return _rows(int(group["_to"].iloc[0]), group["field_name"].iloc[0], counts, removed + cut)

    out = summaries
    while True:
        slots = math.ceil(slots / fan_in)
        out = out.withColumn("_to", F.floor(F.col("slot") / fan_in).cast("int")).groupBy("field_name", "_to").applyInPandas(run, SUMMARY)
        if slots <= 1:
            return out


def frequent_items(hits: DataFrame, columns: list[str], key: str, share: float = 0.005, slack: int = 4) -> DataFrame:
    """Values that at least ``share`` of all keys have: field_name, item, count (lower bound), count_upper, exact_count, total.

    Values are trimmed and lower-cased. Repeats of a key count once, and keys whose value is null count in the total
    only. Rows with a null key are no hits. Summaries run over all rows, repeats included: with N rows and D keys the
    capacity is slack * N / (share * D), so a value that ``share`` of the keys have can't fall out of the summary, and
    the number of counters depends on ``share`` and the rate of repeats, not on the number of values. Then the distinct
    keys of the surviving candidates are counted exactly. An empty table gives no rows.
    """
    hits = hits.where(F.col(key).isNotNull())
    sizes = hits.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).first()
    rows, keys = sizes["n"], sizes["d"]
    schema = "field_name string, item string, count long, count_upper long, exact_count long, total long"
    if not keys:
        return hits.sparkSession.createDataFrame([], schema)
    capacity = math.ceil(slack * rows / (share * keys))
    clean = hits.select(key, *[F.lower(F.trim(F.col(c))).alias(c) for c in columns])
    slots = clean.rdd.getNumPartitions()
    found = materialise(
        merge(summarise(clean, columns, capacity), capacity, slots)
        .where(F.col("item").isNotNull() & (F.col("count") + F.col("removed") >= share * keys))
        .select("field_name", "item", "count", (F.col("count") + F.col("removed")).alias("count_upper")),
        "frequent",
    )
    # at most (1 + slack) / share candidates per column: a proven bound on what is broadcast
    values = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("item")) for c in columns])
    exact = (
        clean.select(key, F.inline(values))
        .join(F.broadcast(found.select("field_name", "item")), ["field_name", "item"])
        .distinct()
        .groupBy("field_name", "item")
        .agg(F.count(F.lit(1)).alias("exact_count"))
    )
    return (
        found.join(exact, ["field_name", "item"])
        .where(F.col("exact_count") >= share * keys)
        .withColumn("total", F.lit(keys).cast("long"))
    )
