"""Queries of the near-duplicates problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm.near_duplicates import groups, near_duplicates
from inkwarden.session import table

WORDS, LIKENESS = 3, 0.5  # as TESTDATA.md states them


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of jobs. TESTDATA.md asks for every pair of jobs, so members of linked classes and of one class are joined
    on the class; the size is that of the answer."""
    jobs = table(spark, sf_dir, "job_contexts").select("job_id", "full_text")
    membership, links = near_duplicates(jobs, "job_id", "full_text", WORDS, LIKENESS)
    a = membership.select(F.col("job_id").alias("x"), F.col("class_id").alias("class_a"))
    b = membership.select(F.col("job_id").alias("y"), F.col("class_id").alias("class_b"))
    linked = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("x", "y").where("x <> y")
    copies = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    pairs = linked.unionByName(copies)
    return pairs.select(F.least("x", "y").alias("job_id_a"), F.greatest("x", "y").alias("job_id_b")).distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job with text: its class, its group and the number of links of its class."""
    jobs = table(spark, sf_dir, "job_contexts").select("job_id", "full_text")
    membership, links = near_duplicates(jobs, "job_id", "full_text", WORDS, LIKENESS)
    return groups(membership, links, "job_id")


def p4_document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the documents table, with the operator's own defaults (five words, 0.8)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    membership, links = near_duplicates(docs, "doc_id", "text")
    return groups(membership, links, "doc_id")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups, "p4_document_groups": p4_document_groups}


def _likeness_sql(source: str, key: str, text: str, size: int) -> str:
    """Every pair of records with a common shingle, counted: for small tables."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return rf"""t as (select distinct {key} as k, regexp_extract_all(lower({text}), '[\p{{L}}\p{{Nd}}]+') as w from {source} where {text} is not null),
        g as (select distinct k, {gram} as gram from (select k, w, unnest(generate_series(1, len(w) - {size - 1})) as i from t)),
        n as (select k, count(*) as n from g group by 1),
        c as (select a.k as a, b.k as b, count(*) as common from g a join g b on a.gram = b.gram and a.k < b.k group by 1, 2),
        p as (select a, b, common, x.n + y.n - common as either from c join n x on a = x.k join n y on b = y.k)"""


def _groups_sql(source: str, key: str, text: str, size: int, threshold: float) -> str:
    return f"""with recursive {_likeness_sql(source, key, text, size)},
        cls as (select n.k, coalesce(min(p.a), n.k) as class_id from n left join p on p.b = n.k and common = either group by n.k),
        l as (select distinct x.class_id as a, y.class_id as b from p join cls x on p.a = x.k join cls y on p.b = y.k where common >= {threshold} * either and x.class_id <> y.class_id),
        e as (select a, b from l union select b, a from l),
        walk(a, b) as (select class_id, class_id from cls union select walk.a, e.b from walk join e on walk.b = e.a),
        top as (select a, min(b) as group_id from walk group by 1)
        select k as {key}, class_id, group_id, (select count(*) from e where e.a = class_id) as links from cls join top on top.a = class_id"""


SQL: dict[str, str] = {
    "p4_found": f"with {_likeness_sql('job_contexts', 'job_id', 'full_text', 3)} select a as job_id_a, b as job_id_b from p where common >= 0.5 * either",
    "p4_groups": _groups_sql("job_contexts", "job_id", "full_text", 3, 0.5),
    "p4_document_groups": _groups_sql("documents", "doc_id", "text", 5, 0.8),
}
