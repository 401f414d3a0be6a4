"""Queries of the personal-information problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm import personal_data_spark as S
from inkwarden.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "text_lines")
    hits = table(spark, sf_dir, "dlp_hits").select("job_id", "line_number", "masked_text", "match_hmac")
    model = S.train(lines)
    in_lines = S.find_in_lines(lines, model).select("job_id", "line_number", F.lit("text").alias("field_name"), "kind")
    return in_lines.unionByName(S.find_in_hits(hits, model))


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its values replaced by placeholders."""
    lines = table(spark, sf_dir, "text_lines")
    return S.mask_lines(lines, S.train(lines)).select("job_id", "line_number", "masked_text", "kinds")


def p2_masked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with the readable values of its fields replaced by placeholders."""
    hits = table(spark, sf_dir, "dlp_hits").select("hit_id", "job_id", "line_number", "masked_text", "match_hmac")
    return S.mask_hits(hits, S.train(table(spark, sf_dir, "text_lines"))).distinct()


QUERIES = {"p2_found": p2_found, "p2_masked": p2_masked, "p2_masked_hits": p2_masked_hits}
SQL: dict[str, str] = {}
