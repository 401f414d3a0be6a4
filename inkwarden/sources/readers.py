"""Readers: tables that may be absent or older than the schema, files by type, text lines, companions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIT_TYPE = (
    "struct<rule_id:string,rule_name:string,severity:string,action:string,page_number:int,line_number:int,line_on_page:int,"
    "start:int,end:int,masked_text:string,match_hmac:string,validator:string>"
)
INDEX_SCHEMA = (
    "job_id string, received_at timestamp, assessed_at timestamp, assessment_seq int, ruleset_version string, supersedes_seq int, "
    "release_pending boolean, source_name string, page_count int, ocr_page_count int, min_ocr_confidence float, degraded boolean, "
    "disposition string, reason string, archive_path string, pdf_sha256 string, flagged boolean, highest_severity string, hit_count int, "
    f"rule_ids array<string>, hits array<{HIT_TYPE}>, metadata string, audit_fields string"
)
CONTENT_SCHEMA = (
    "job_id string, full_text string, lines array<struct<line_number:int,page_number:int,line_on_page:int,lines_on_page:int,"
    "text:string,source:string,confidence:float>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table by its explicit schema: columns older files lack are null; no table is an empty one."""
    typed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], typed)
    return spark.read.schema(typed).parquet(path)


def index_store(spark: SparkSession, root: str) -> DataFrame:
    return table_or_empty(spark, root, INDEX_SCHEMA + ", dt date")


def content_store(spark: SparkSession, root: str) -> DataFrame:
    return table_or_empty(spark, root, CONTENT_SCHEMA + ", dt date")


def content_lines(content: DataFrame) -> DataFrame:
    return content.select("job_id", F.inline("lines"))


FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), max_bytes: int | None = None) -> DataFrame:
    """Files below a folder by suffix in any case; over-long ones are left out before their content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    return df.where(has_suffix(F.col("path"), suffixes)) if suffixes else df


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower(path), F.lit(s.lower()))
    return out


def sniff(content: Column) -> Column:
    """pdf, png, jpeg, tiff or null by the first bytes; a PDF header may come within the first 1024."""
    starts = lambda *heads: F.hex(F.substring(content, 1, 8)).rlike("^(?:" + "|".join(heads) + ")")
    return (
        F.when(F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*?255044462D"), "pdf")
        .when(starts("89504E470D0A1A0A"), "png")
        .when(starts("FFD8FF"), "jpeg")
        .when(starts("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff")
    )


def text_lines(docs: DataFrame, key: str, text: str, lines_per_page: int = 25, keep_blank: bool = True) -> DataFrame:
    """Positioned lines of plain texts: job_id, line_number, page_number, line_on_page, lines_on_page, text, source, confidence.

    Lines are split at line feeds as they are; with ``keep_blank`` false they are trimmed and empty ones dropped, as a
    layout extractor would. Null texts have no lines.
    """
    split = F.split(F.col(text), "\n", -1)
    if not keep_blank:
        split = F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("job_id"), F.size(split).alias("_n"), F.posexplode(split).alias("line_number", "text"))
    page = F.floor(F.col("line_number") / lines_per_page).cast("int")
    return rows.select(
        "job_id", "line_number", (page + 1).alias("page_number"), (F.col("line_number") % lines_per_page).alias("line_on_page"),
        F.least(F.lit(lines_per_page), F.col("_n") - page * lines_per_page).cast("int").alias("lines_on_page"), "text",
        F.lit("native").alias("source"), F.lit(None).cast("float").alias("confidence"),
    )


LineSource = Callable[[bytes], list[tuple[int, str, str, float | None]]]
"""Bytes of a file -> (page, text, source, confidence) per line, in reading order."""


def extract_lines(docs: DataFrame, read: LineSource, key: str = "job_id", content: str = "content") -> DataFrame:
    """Lines of binary documents by a pluggable extractor run on the executors; a document it fails on gives one row with error."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for job, data in zip(batch[key], batch[content], strict=True):
                try:
                    found = read(bytes(data))
                except Exception as e:  # noqa: BLE001
                    rows.append((job, None, None, None, None, None, None, None, str(e)[:500]))
                    continue
                pages: dict[int, int] = {}
                for page, *_ in found:
                    pages[page] = pages.get(page, 0) + 1
                at: dict[int, int] = {}
                for n, (page, text, source, confidence) in enumerate(found):
                    k = at[page] = at.get(page, -1) + 1
                    rows.append((job, n, page, k, pages[page], text, source, confidence, None))
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[1:5], "Int32"))

    names = [key, "line_number", "page_number", "line_on_page", "lines_on_page", "text", "source", "confidence", "error"]
    schema = f"{key} string, line_number int, page_number int, line_on_page int, lines_on_page int, text string, source string, confidence float, error string"
    return docs.select(key, content).mapInPandas(run, schema)


# --- companions ---


def parse_key_values(text: Column) -> Column:
    """Lines of ``key=value`` or ``key: value``, trimmed; a line with an equals sign is divided there, any other at its first
    colon; the last of equal keys wins. Lines without either, and empty keys, say nothing."""
    rows = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike("[=:]"))
    entries = F.transform(
        rows,
        lambda x: F.struct(
            F.regexp_replace(F.when(x.contains("="), F.substring_index(x, "=", 1)).otherwise(F.substring_index(x, ":", 1)), r"^\s+|\s+$", "").alias("key"),
            F.regexp_replace(x, r"^(?:[^=]*=|[^=:]*:)\s*|\s+$", "").alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["key"] != ""))


def parse_json(text: Column) -> Column:
    """A JSON object as VARIANT; any other JSON value under the key ``value``; unreadable text gives null."""
    is_object = F.substring(F.ltrim(text), 1, 1) == "{"
    return F.try_parse_json(F.when(is_object, text).otherwise(F.concat(F.lit('{"value":'), text, F.lit("}"))))


def parse_xml(text: Column, schema: str) -> Column:
    """XML of a known schema; documents with a DOCTYPE are refused (null)."""
    return F.from_xml(F.when(~text.rlike(r"(?i)<!\s*DOCTYPE"), text), schema)


def parse_nothing(text: Column) -> Column:
    return F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))


PARSERS = {"text": parse_key_values, "json": parse_json, "xml": parse_xml, "none": parse_nothing}


def parser(kind: str | None) -> Callable[..., Column]:
    """The parser of a companion format; none and unknown formats say nothing."""
    return PARSERS.get(kind or "none", parse_nothing)


def allowlisted(json_text: Column, paths: list[str], most: int = 4096) -> Column:
    """Map of the allowed dotted paths found in a JSON object, each as text under its dotted name, capped."""
    from inkwarden.functions.values import capped

    entries = [
        F.struct(F.lit(p).alias("key"), capped(F.get_json_object(json_text, "$" + "".join(f"['{k}']" for k in p.split("."))), most).alias("value")) for p in paths
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def merged_metadata(document: Column, companion: Column) -> Column:
    """Properties of the document with those of its companion; the companion wins, a missing side counts as empty."""
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    both = F.concat(F.map_entries(F.coalesce(document, none)), F.map_entries(F.coalesce(companion, none)))
    keys = F.array_distinct(F.transform(both, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(both, lambda e: e["key"] == k), -1)
    return F.map_from_entries(F.transform(keys, last))
