"""Filling containers of fixed capacity with documents, by the sum-of-squares rule.

Online packing: the array of fill levels counts the open containers of each level, and a document goes where the sum of
squares of those counts becomes least. Documents arrive in hashed order, in groups of bounded size that are packed side
by side; containers a group leaves clearly underfilled, and into which another one would still fit, are combined by the
same rule, again in groups of bounded size, for as long as that saves containers. Only a document above the capacity is
split.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.session import materialise

GROUP_ROWS = 20_000
FULL_ENOUGH = 0.99
LEAST_SAVED = 0.001  # a level of combining that saves less of its containers is the last


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, 0 < size <= capacity, in order of arrival."""
    level = np.zeros(capacity + 1, dtype=np.int64)  # open containers by fill; full and empty ones aren't counted
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for k, size in enumerate(sizes.tolist()):
        best, best_cost = 0, (0 if size == capacity else 2 * int(level[size]) + 1)
        if size < capacity:
            from_level = level[1 : capacity - size + 1]
            cost = 2 * (level[size + 1 : capacity + 1] - from_level + 1)
            cost[-1] = 1 - 2 * from_level[-1]  # such a container becomes full and isn't counted any more
            cost = np.where(from_level > 0, cost, np.iinfo(np.int64).max)
            at = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equals, the fullest
            if cost[at] <= best_cost:
                best = at + 1
        if best:
            number = stacks[best].pop()
            level[best] -= 1
        else:
            number, made = made, made + 1
        out[k] = number
        if best + size < capacity:
            level[best + size] += 1
            stacks.setdefault(best + size, []).append(number)
    return out


def _packer(tag: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: _pack(group, tag)


def _pack(group: pd.DataFrame, tag: str) -> pd.DataFrame:
    """One group of one container size, in order of arrival; its rows with the container each goes to."""
    group = group.sort_values(["arrival", "tokens"])
    number = sum_of_squares(group["tokens"].to_numpy(), int(group["capacity"].iloc[0]))
    slot = int(group["slot"].iloc[0])
    return group.drop(columns=["arrival", "slot"]).assign(container=[f"{tag}-{slot}-{n}" for n in number])


def _in_groups(rows: DataFrame, group_rows: int, salt: int) -> DataFrame:
    """rows with ``slot``: hashed groups of about ``group_rows`` within each container size, whatever their number."""
    count = rows.groupBy("spec_name", "capacity").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).alias("_slots"))
    return rows.join(count, ["spec_name", "capacity"]).withColumn("slot", F.pmod(F.xxhash64("arrival", F.lit(salt)), F.col("_slots")).cast("int")).drop("_slots")


def pieces(documents: DataFrame, specs: DataFrame, key: str, tokens: str) -> DataFrame:
    """One row per piece: a document within the capacity is one piece; a longer one gives full pieces and a rest.

    Documents with null or no tokens need no room and give no piece. A key that comes again is one more document; rows
    without a key are documents as well.
    """
    d = documents.where(F.col(tokens) > 0).select(F.col(key).alias("doc"), F.col(tokens).cast("long").alias("size"))
    known = specs.where(F.col("capacity_tokens") > 0).select("spec_name", "capacity_tokens").distinct().collect()  # parameters, a row each
    each = [F.struct(F.lit(r[0]).alias("spec_name"), F.lit(r[1]).cast("int").alias("capacity")) for r in sorted(known, key=str)]
    s = F.array(*each) if each else F.lit(None).cast("array<struct<spec_name:string,capacity:int>>")
    return d.select("doc", "size", F.inline(s)).select(
        "spec_name", "capacity", "doc", "size", F.posexplode(F.sequence(F.lit(0), F.col("size") - 1, F.col("capacity").cast("long"))).alias("piece", "start")
    ).withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("size") - F.col("start")).cast("int"))


def pack(documents: DataFrame, specs: DataFrame, key: str, tokens: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every piece with its container: spec_name, capacity, container, <key>, piece, start, tokens.

    Rows of equal key are documents of their own. No documents or no specs give no rows. A task packs about ``group_rows``
    pieces or containers, however many of them are left to combine.
    """
    rows = pieces(documents, specs, key, tokens).drop("size").withColumn("arrival", F.xxhash64("doc", "piece"))
    # whole containers need no search
    full = rows.where("tokens = capacity").drop("arrival").withColumn("container", F.concat(F.lit("full-"), F.expr("uuid()")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("arrival").schema.fields) + ", container string"
    items = _in_groups(rows.where("tokens < capacity"), group_rows, 7)
    placed = materialise(items.groupBy("spec_name", "capacity", "slot").applyInPandas(_packer("c0"), schema), "placed")
    full = materialise(full, "full")
    moves = _combined(placed, group_rows)
    if moves is not None:
        names = ["spec_name", "capacity", "container"]
        placed = placed.join(moves, names, "left").withColumn("container", F.coalesce("into", "container")).drop("into")
    return placed.unionByName(full).select("spec_name", "capacity", "container", F.col("doc").alias(key), "piece", "start", "tokens")


def _combined(placed: DataFrame, group_rows: int) -> DataFrame | None:
    """(spec_name, capacity, container, into): underfilled containers that go together into a new one; none where nothing fits."""
    names = ["spec_name", "capacity", "container"]
    bins = placed.groupBy(*names).agg(F.sum("tokens").cast("int").alias("tokens"))
    bins = materialise(bins.where(F.col("tokens") < F.col("capacity") * FULL_ENOUGH), "loose")
    moves, level = None, 0
    while True:
        level += 1
        # a container into which not even the emptiest other one fits stays as it is
        least = bins.groupBy("spec_name", "capacity").agg(F.min("tokens").alias("least"))
        fitting = bins.join(least, ["spec_name", "capacity"])
        fitting = fitting.where(F.col("tokens") + F.col("least") <= F.col("capacity")).drop("least")
        grouped = materialise(_in_groups(fitting.withColumn("arrival", F.xxhash64("container")), group_rows, level), "fitting")
        sizes = grouped.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("spec_name", "capacity", "slot").alias("groups"), F.countDistinct("spec_name", "capacity").alias("specs")).first()
        if sizes["n"] < 2:
            return moves
        packed = grouped.withColumnRenamed("container", "was").groupBy("spec_name", "capacity", "slot").applyInPandas(
            _packer(f"c{level}"), "spec_name string, capacity int, was string, tokens int, container string"
        )
        packed = materialise(packed, "combined")
        step = packed.select("spec_name", "capacity", F.col("was").alias("container"), F.col("container").alias("into"))
        if moves is None:
            moves = step
        else:
            later = step.select("spec_name", "capacity", F.col("container").alias("into"), F.col("into").alias("_then"))
            first = step.join(moves.select("spec_name", "capacity", F.col("into").alias("container")).distinct(), names, "left_anti")
            moves = moves.join(later, ["spec_name", "capacity", "into"], "left").select(*names, F.coalesce("_then", "into").alias("into")).unionByName(first)
            moves = materialise(moves, "moves")
        bins = materialise(packed.groupBy(*names).agg(F.sum("tokens").cast("int").alias("tokens")).where(F.col("tokens") < F.col("capacity") * FULL_ENOUGH), "loose")
        left = packed.select(*names).distinct().count()
        if sizes["groups"] == sizes["specs"] or sizes["n"] - left < LEAST_SAVED * sizes["n"]:
            return moves


def fill_report(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the least possible number of containers, and the share of capacity used."""
    bins = packed.groupBy("spec_name", "capacity", "container").agg(F.sum("tokens").alias("fill"), F.count(F.lit(1)).alias("pieces"))
    return (
        bins.groupBy("spec_name", "capacity")
        .agg(
            F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.sum("pieces").alias("pieces")
        )
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
        .withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity")))
    )
