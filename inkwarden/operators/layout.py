"""Boxes on pages: which recognised boxes repeat native text, and which boxes stand in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uncovered(ocr: DataFrame, native: DataFrame, share: float = 0.5) -> DataFrame:
    """Recognised boxes that overlap no native box of the page by more than ``share`` of the smaller: (job_id, page, x0, y0, x1, y1)."""
    n = native.select("job_id", "page", *[F.col(c).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.greatest(F.lit(0.0), F.least("x1", "nx1") - F.greatest("x0", "nx0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "ny1") - F.greatest("y0", "ny0"))
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    other = (F.col("nx1") - F.col("nx0")) * (F.col("ny1") - F.col("ny0"))
    same = (ocr["job_id"] == n["job_id"]) & (ocr["page"] == n["page"])
    return ocr.join(n, same & (wide * high > F.lit(share) * F.least(own, other)), "left_anti")


def upper_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def rows_of(boxes: DataFrame, part: float = 0.6) -> DataFrame:
    """Boxes (job_id, page, x0, y0, x1, y1) with ``row`` (0-based, downwards) and ``place`` in it.

    A box opens a new row when its middle lies lower than the middle of the row's first box by more than ``part`` of the
    page's median height: an ordered fold over one page's boxes.
    """
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "y0", "x1", "y1")
    pages = boxes.groupBy("job_id", "page").agg(
        F.array_sort(F.collect_list(box)).alias("b"), (upper_median(F.collect_list(F.col("y1") - F.col("y0"))) * part).alias("tolerance")
    )
    empty = F.array().cast("array<struct<row:int,x0:double,y0:double,x1:double,y1:double>>")

    def step(acc, x):
        opens = x["cy"] - acc["cy"] > F.col("tolerance")
        row = acc["row"] + F.when(opens, 1).otherwise(0)
        out = F.concat(acc["out"], F.array(F.struct(row.alias("row"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1"))))
        return F.struct(F.when(opens, x["cy"]).otherwise(acc["cy"]).alias("cy"), row.alias("row"), out.alias("out"))

    zero = F.struct(F.lit(float("-inf")).alias("cy"), F.lit(-1).alias("row"), empty.alias("out"))
    placed = pages.select("job_id", "page", F.array_sort(F.aggregate("b", zero, step, lambda a: a["out"])).alias("o"))
    each = placed.select("job_id", "page", F.posexplode("o").alias("k", "x"), F.col("o"))
    before = F.size(F.filter("o", lambda y: y["row"] < F.col("x.row")))
    return each.select("job_id", "page", "x.row", (F.col("k") - before).alias("place"), "x.x0", "x.y0", "x.x1", "x.y1")
