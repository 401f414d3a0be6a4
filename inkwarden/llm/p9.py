"""Queries of the subject-area problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm.subjects import assign, fit
from inkwarden.session import table


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    areas, labels = table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_labels")
    found = assign(documents, fit(documents, labels, areas), labels)
    return found.join(areas.select("subject"), "subject", "left_semi")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by subject; a document of several subjects counts with each."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"))
    return (
        _assigned(spark, sf_dir)
        .join(sizes, "doc_id")
        .groupBy("subject")
        .agg(F.countDistinct("doc_id").alias("documents"), F.sum("chars").alias("chars"))
    )


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
