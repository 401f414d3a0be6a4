"""Queries of the scanned-text problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwarden.llm.scanned_text_spark import Repair
from inkwarden.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repair(table(spark, sf_dir, "text_lines")).kinds()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's text as continuous paragraphs."""
    return Repair(table(spark, sf_dir, "text_lines")).paragraphs()


def p5_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repair(table(spark, sf_dir, "text_lines")).fixes.select("word", "replacement")


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p5_corrections": p5_corrections}
SQL: dict[str, str] = {}
