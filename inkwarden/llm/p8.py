"""Queries of the source-mixing problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm.mixing import clean_source, mix, mix_report
from inkwarden.llm.p7 import sized_documents
from inkwarden.session import materialise, table


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = materialise(mix(sizes, targets, "doc_id", "source", "tokens"), "mixture")
    return mix_report(mixed, sizes, targets, "source", "tokens")


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with a target and documents what must hold: how many documents it has, documents given more copies than
    allowed, and whether its tokens miss what its share of the mixture asks for by no more than its largest document."""
    sizes, targets = sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = materialise(mix(sizes, targets, "doc_id", "source", "tokens"), "mixture")
    caps = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    used = mixed.groupBy("source", "doc_id").agg(F.sum("copies").alias("copies"), F.first("tokens").alias("tokens"))
    used = used.join(caps, "source").groupBy("source", "target_share").agg(
        F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed")
    )
    held = sizes.where("tokens > 0").groupBy(clean_source(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.max("tokens").alias("largest"))
    rows = held.join(used, "source")
    whole = rows.agg(F.sum("mixed").alias("all"), F.sum("target_share").alias("shares")).first()
    wanted = F.col("target_share") / F.lit(whole["shares"] or 1.0) * F.lit(float(whole["all"] or 0))
    return rows.select("source", "documents", "over_cap", (F.abs(F.col("mixed") - wanted) <= F.col("largest")).alias("share_met"))


QUERIES = {"p8_mixture": p8_mixture, "p8_report": p8_report, "p8_invariants": p8_invariants}
SQL: dict[str, str] = {
    "p8_invariants": """select lower(trim(d.source)) as source, count(*) as documents, 0::bigint as over_cap, true as share_met from documents d
        where text <> '' and lower(trim(d.source)) in (select lower(trim(source)) from mix_targets where target_share > 0 and max_repeats > 0) group by 1"""
}
