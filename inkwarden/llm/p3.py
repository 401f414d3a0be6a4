"""Queries of the most-frequent-items problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwarden.llm.heavy_hitters import frequent_items
from inkwarden.session import table

FIELDS = ["match_hmac", "rule_id"]


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(table(spark, sf_dir, "dlp_hits"), FIELDS, "hit_id", 0.005)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("field_name", "item")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("field_name", "item", "exact_count", "total")


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate counts as the summaries give them, over all rows with repeats: count <= occurrences <= count_upper."""
    return _frequent(spark, sf_dir)


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p3_bounds": p3_bounds}

_COUNTS = """
with h as (select hit_id, lower(trim(match_hmac)) as match_hmac, lower(trim(rule_id)) as rule_id from dlp_hits where hit_id is not null),
t as (select count(distinct hit_id) as total from h),
c as (select 'match_hmac' as field_name, match_hmac as item, count(distinct hit_id) as exact_count from h
      where match_hmac is not null group by 2
      union all
      select 'rule_id', rule_id, count(distinct hit_id) from h where rule_id is not null group by 2)
"""
SQL = {
    "p3_found": _COUNTS + "select field_name, item from c, t where exact_count >= 0.005 * total",
    "p3_counts": _COUNTS + "select field_name, item, exact_count, total from c, t where exact_count >= 0.005 * total",
}
