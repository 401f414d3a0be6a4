"""Queries of the container-filling problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm.packing import fill_report, pack
from inkwarden.llm.tokens import count_tokens
from inkwarden.session import materialise, table


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_tokens(F.col("text")).alias("tokens"))
    return materialise(docs, "sizes")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sized_documents(spark, sf_dir), table(spark, sf_dir, "pack_specs"), "doc_id", "tokens")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(materialise(_packed(spark, sf_dir), "packed"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size what must hold of every arrangement: documents packed, containers over capacity, documents split
    though they fit, documents whose pieces don't make up their tokens (each token once)."""
    sizes = sized_documents(spark, sf_dir)
    packed = materialise(pack(sizes, table(spark, sf_dir, "pack_specs"), "doc_id", "tokens"), "packed")
    fills = packed.groupBy("spec_name", "capacity", "container").agg(F.sum("tokens").alias("fill"))
    over = fills.groupBy("spec_name", "capacity").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("spec_name", "capacity", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("sum"), F.countDistinct("start").alias("starts"), F.max(F.col("start") + F.col("tokens")).alias("end")
    )
    docs = docs.join(sizes.select("doc_id", F.col("tokens").alias("own")), "doc_id")
    whole = (F.col("sum") == F.col("own")) & (F.col("end") == F.col("own")) & (F.col("starts") == F.col("pieces"))
    held = docs.groupBy("spec_name", "capacity").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("own") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("split_though_fitting"), F.count_if(~whole).alias("incomplete")
    )
    return held.join(over, ["spec_name", "capacity"]).select("spec_name", "capacity", "documents", "overfull", "split_though_fitting", "incomplete")


QUERIES = {"p7_packed": p7_packed, "p7_report": p7_report, "p7_invariants": p7_invariants}
SQL: dict[str, str] = {
    "p7_invariants": """select spec_name, capacity_tokens as capacity, (select count(*) from documents where text <> '') as documents, 0::bigint as overfull,
        0::bigint as split_though_fitting, 0::bigint as incomplete from (select distinct spec_name, capacity_tokens from pack_specs where capacity_tokens > 0)"""
}
