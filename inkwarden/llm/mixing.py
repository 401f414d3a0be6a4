"""Mixing sources to target shares of the tokens, by pivotal rounding of fractional copy numbers.

Each source's documents are wanted e times on average, e = share * total / tokens of the source. The whole part is
given to every document; the fraction is rounded by pairing: two fractional documents exchange mass at random, without
changing the expected tokens, until one of them is whole. Every bucket leaves at most one fraction, and those of a
source are paired on in a tree. The tokens of a source then differ from the target by less than one document. Documents that make up a sizeable part of their source's
target are rounded first, and the rate of the others is set anew for what is left, so that the last fraction is small;
expectations stay as they were.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.session import materialise

BUCKET_ROWS = 20_000
FAN_IN = 16
SIZEABLE = 0.01  # part of a source's target


def clean_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def pivotal(p: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds probabilities so that all but at most one are 0 or 1; expectations and the weighted sum are kept.

    Of two fractions that meet one becomes exactly 0 or 1, so fractions of any smallness are treated alike.
    """
    p, weight = p.astype(float).copy(), weight.astype(float)
    draws = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        room, mass = (1 - p[held]) * weight[held], p[i] * weight[i]  # how far the held one can rise, the other fall
        have, space = p[held] * weight[held], (1 - p[i]) * weight[i]
        up, down = min(room, mass), min(have, space)
        if draws[i] * (up + down) < down:
            p[held], p[i] = (1.0 if room <= mass else p[held] + up / weight[held]), (0.0 if mass <= room else p[i] - up / weight[i])
        else:
            p[held], p[i] = (0.0 if have <= space else p[held] - down / weight[held]), (1.0 if space <= have else p[i] + down / weight[i])
        held = next((k for k in (held, i) if 0 < p[k] < 1), -1)
    return p


def _round(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    group = group.sort_values(["tokens", "row_id"], ascending=False)
    bucket = int(group["bucket"].iloc[0])
    rng = np.random.default_rng([seed, bucket, *group["source"].iloc[0].encode()])
    p = pivotal(group["p"].to_numpy(), group["tokens"].to_numpy(), rng)
    return group.assign(p=p)


def targets_with_sizes(documents: DataFrame, targets: DataFrame, source: str, tokens: str) -> DataFrame:
    """Per target source: its share, cap, documents and tokens (0 if it has none)."""
    have = (
        documents.where(F.col(tokens) > 0)
        .groupBy(clean_source(F.col(source)).alias("source"))
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(tokens).alias("tokens"))
    )
    wanted = targets.where(F.col("target_share") > 0).select(
        clean_source(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")
    )
    return wanted.distinct().join(have, "source", "left").fillna(0, ["documents", "tokens"])


def mix(documents: DataFrame, targets: DataFrame, key: str, source: str, tokens: str, total_tokens: float | None = None, seed: int = 11) -> DataFrame:
    """Documents of the mixture with their number of copies (1 or more): <key>, source, tokens, copies.

    Source names are compared trimmed and in lower case; documents of a null or untargeted source, or without tokens,
    take no part. ``total_tokens`` defaults to the largest total at which every source that has documents reaches its
    share within its cap; the shares of sources without documents fall to the others in proportion. With a larger total
    the sources at their cap fall short, and the report says so. Repeated keys are separate documents.
    """
    kept = materialise(
        documents.where(F.col(tokens) > 0)
        .select(F.col(key).alias("_key"), clean_source(F.col(source)).alias("source"), F.col(tokens).cast("long").alias("tokens"))
        .where(F.col("source").isNotNull())
        .withColumn("row_id", F.monotonically_increasing_id()),
        "mix-documents",
    )
    sized = targets_with_sizes(kept, targets, "source", "tokens").where("tokens > 0")
    bounds = sized.agg(
        F.sum("target_share").alias("share"),
        F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("room"),
    ).first()
    empty = kept.limit(0).select(F.col("_key").alias(key), "source", "tokens", F.lit(0).alias("copies"))
    if not bounds["share"]:
        return empty
    # room is the total at raw shares; present shares sum to `share`, so the reachable total is room * share
    total = total_tokens if total_tokens is not None else bounds["room"] * bounds["share"]
    target = F.least(F.col("max_repeats") * F.col("tokens"), F.col("target_share") / F.lit(bounds["share"]) * F.lit(float(total)))
    rates = sized.select("source", "max_repeats", target.alias("target"), (target / F.col("tokens")).alias("rate"))
    split = kept.join(rates, "source").withColumn("big", F.col("tokens") > F.lit(SIZEABLE) * F.col("target"))
    big = materialise(_copies(split.where("big"), "rate", seed), "big")
    done = big.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("done"))
    small = split.where("NOT big").groupBy("source").agg(F.sum("tokens").alias("small"))
    left = (F.col("target") - F.coalesce("done", F.lit(0))) / F.col("small")
    again = rates.join(small, "source").join(done, "source", "left").select(
        "source", F.greatest(F.lit(0.0), F.least(left, F.col("max_repeats").cast("double"))).alias("rate_small")
    )
    others = _copies(split.where("NOT big").join(again, "source"), "rate_small", seed + 1)
    return big.unionByName(others).where("copies > 0").select(F.col("_key").alias(key), "source", "tokens", "copies")


def _rounder(seed: int):
    return lambda group: _round(group, seed)


def _copies(rows: DataFrame, rate: str, seed: int) -> DataFrame:
    """_key, source, tokens, copies: the whole part of the rate and the rounded fraction.

    Each source is dealt to as many buckets as it needs; every bucket leaves one fraction at most, and those are paired on
    in a tree.
    """
    slots = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)).cast("int").alias("slots"))
    start = rows.join(slots, "source").select(
        "source", F.pmod(F.xxhash64("row_id"), F.col("slots")).cast("int").alias("bucket"), "row_id", "_key", "tokens",
        (F.col(rate) - F.floor(rate)).alias("p"), F.floor(rate).cast("int").alias("base"),
    )
    schema = start.schema
    loose = F.col("p").between(0, 1) & ~F.col("p").isin(0.0, 1.0)
    state = materialise(start.groupBy("source", "bucket").applyInPandas(_rounder(seed), schema), "rounded")
    decided, left = state.where(~loose), state.where(loose)
    level = 1 + (state.agg(F.max("bucket")).first()[0] or 0)
    while level > 1:
        level = math.ceil(level / FAN_IN)
        step = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("int"))
        state = materialise(step.groupBy("source", "bucket").applyInPandas(_rounder(seed), schema), "rounded")
        decided, left = decided.unionByName(state.where(~loose)), state.where(loose)
    # one fraction a source at most is left; it is drawn by its probability
    draw = F.pmod(F.xxhash64("source", "row_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    last = left.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0))
    return decided.unionByName(last).select("_key", "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("copies"))


def mix_report(mixed: DataFrame, documents: DataFrame, targets: DataFrame, source: str, tokens: str) -> DataFrame:
    """Per target source: share wanted, share reached, tokens in the mixture, documents used, most copies, documents held."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("used"), F.max("copies").alias("most_copies")
    )
    sized = targets_with_sizes(documents, targets, source, tokens).withColumnRenamed("tokens", "held_tokens")
    rows = sized.join(used, "source", "left").fillna(0, ["mixed_tokens", "used", "most_copies"])
    whole = rows.agg(F.sum("mixed_tokens")).first()[0] or 0
    return rows.select(
        "source", "target_share", F.try_divide(F.col("mixed_tokens"), F.lit(whole)).alias("actual_share"), "max_repeats", "most_copies",
        "documents", "used", "held_tokens", "mixed_tokens",
    )
