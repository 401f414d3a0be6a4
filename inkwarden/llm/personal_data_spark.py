"""Finding and masking personal information over tables of text lines."""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwarden.llm import personal_data as P
from inkwarden.session import materialise

CHUNK, OVERLAP = 400, 10
SAMPLE_LINES = 40_000
COLUMNS = ["job_id", "line_number", "page_number", "line_on_page", "lines_on_page", "text"]


def chunks(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Lines in reading order, documents cut into overlapping chunks so that a document of any length is many tasks' work."""
    n = F.coalesce("line_number", F.lit(-1))
    own = F.floor(n / CHUNK).cast("int")
    place = F.pmod(n, F.lit(CHUNK))
    near = F.when((place < OVERLAP) & (own > 0), F.array(own, own - 1)).when(place >= CHUNK - OVERLAP, F.array(own, own + 1)).otherwise(F.array(own))
    rows = lines.where(F.col("text").isNotNull()).select(*COLUMNS, *extra, F.explode(near).alias("chunk"))
    return rows.repartition("job_id", "chunk").sortWithinPartitions("job_id", "chunk", "line_number", "text")


def by_chunk(batches: Iterator[pd.DataFrame], work: Callable[[list[pd.DataFrame]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hands whole chunks on, many at a time, though Arrow batches end anywhere. Repeated rows are given once."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None and len(held):
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        job, chunk = batch["job_id"].fillna(""), batch["chunk"]
        same = (job == job.iloc[-1]) & (chunk == chunk.iloc[-1])
        held, ready = batch[same], batch[~same]
        if len(ready):
            yield work(_groups(ready))
    if held is not None and len(held):
        yield work(_groups(held))


def _groups(rows: pd.DataFrame) -> list[pd.DataFrame]:
    rows = rows.drop_duplicates(["job_id", "chunk", "line_number", "text"])
    new = (rows["job_id"].fillna("") != rows["job_id"].fillna("").shift()) | (rows["chunk"] != rows["chunk"].shift())
    cuts = [*new.to_numpy().nonzero()[0].tolist(), len(rows)]
    return [rows.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _ints(g: pd.DataFrame, column: str, missing: int) -> list[int]:
    """One column of a group as plain numbers; a group is small, and a frame's own means cost more than the work."""
    return [missing if v is None or v != v else int(v) for v in g[column].to_numpy().tolist()]


def _own(g: pd.DataFrame) -> list[bool]:
    """Lines of the group's own block; the others overlap from its neighbours."""
    return [n // CHUNK == c for n, c in zip(_ints(g, "line_number", -1), g["chunk"].to_numpy().tolist(), strict=True)]


def reading_order(groups: list[pd.DataFrame]) -> tuple[list[str], list[tuple[int, int]]]:
    """Scanning copies of all lines, page furniture after the text of its document, and (group, row) of each."""
    lines: list[str] = []
    where: list[tuple[int, int]] = []
    for k, g in enumerate(groups):
        texts = [P.scan_copy(t) for t in g["text"].to_numpy()]
        top = _ints(g, "line_on_page", 99)
        foot = [n - 1 - t for n, t in zip(_ints(g, "lines_on_page", 199), top, strict=True)]
        aside = P.furniture(texts, g["page_number"].to_numpy().tolist(), top, foot)
        for wanted in (False, True):
            for i, t in enumerate(texts):
                if aside[i] == wanted:
                    lines.append(t)
                    where.append((k, i))
            if wanted is False and any(aside):
                lines.append(P.BREAK)
                where.append((k, -1))
        lines.append(P.BREAK)
        where.append((k, -1))
    return lines, where


def count_names(lines: DataFrame) -> DataFrame:
    """(a, b, gap, n): counts of neighbouring capitalised words over all lines; of single ones where b is null."""

    def work(groups: list[pd.DataFrame]) -> pd.DataFrame:
        texts, where = reading_order(groups)
        held = [_own(g) for g in groups]
        starts = [0, *itertools.accumulate(len(x) + 1 for x in texts)]

        def own(place: int) -> bool:
            k, i = where[bisect_right(starts, place) - 1]
            return i >= 0 and held[k][i]

        total, linked = P.name_counts("\n".join(texts), own)
        rows = [(w, None, None, n) for w, n in total.items()] + [(*k, n) for k, n in linked.items()]
        return pd.DataFrame(rows, columns=["a", "b", "gap", "n"])

    each = chunks(lines).mapInPandas(lambda b: by_chunk(b, work), "a string, b string, gap string, n long")
    return each.groupBy("a", "b", "gap").agg(F.sum("n").alias("n"))


class Counts:
    """As :class:`personal_data.Counts`, over a table of counts: only the names themselves come to the driver."""

    def __init__(self, counts: DataFrame):
        self.spark = counts.sparkSession
        self.total = counts.where(F.col("b").isNull()).select(F.col("a").alias("word"), F.col("n").alias("total"))
        self.linked = counts.where(F.col("b").isNotNull()).select("a", "b", "gap", "n")

    def _words(self, count: Callable, g: P.Gazetteer) -> DataFrame:
        held = self.spark.sparkContext.broadcast(g)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                seen = count(batch.itertuples(index=False, name=None), held.value)
                yield pd.DataFrame(list(seen.items()), columns=["word", "n"])

        seen = self.linked.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return seen.join(self.total, "word")

    def families(self, g: P.Gazetteer) -> set[str]:
        rows = self._words(P.in_family_places, g).where((F.col("n") >= 0.4 * F.col("total")) & (F.length("word") > 3))
        return {r["word"] for r in rows.select("word").collect()}

    def with_endings(self, endings: set[str], g: P.Gazetteer) -> dict[str, int]:
        wanted = self.spark.createDataFrame([(e,) for e in sorted(endings)], "ending string")
        given = self.spark.createDataFrame([(w,) for w in sorted(g.given)], "word string")
        words = self.total.where(F.length("word") > 5).withColumn("ending", F.expr("right(word, 4)"))
        rows = words.join(wanted, "ending").join(given, "word", "left_anti").groupBy("ending").agg(F.count(F.lit(1)).alias("n"))
        return {r["ending"]: r["n"] for r in rows.collect()}

    def givens(self, g: P.Gazetteer) -> set[str]:
        rows = self._words(P.before_families, g).where((F.col("n") >= F.greatest(F.lit(2.0), 0.25 * F.col("total"))) & (F.length("word") > 2))
        return {r["word"] for r in rows.select("word").collect()}


def train(lines: DataFrame, sample_lines: int = SAMPLE_LINES) -> P.Model:
    """Gazetteers from counts over all lines; the classifier fits on whole documents chosen by hash.

    That sample has about ``sample_lines`` lines and never more than twice that.
    """
    g = P.induce(Counts(materialise(count_names(lines), "name-counts")))
    parts = max(1, math.ceil(lines.count() / sample_lines))
    some = lines.where(F.pmod(F.xxhash64(F.coalesce("job_id", F.lit(""))), F.lit(parts)) == 0)
    order = some.orderBy(F.xxhash64("job_id"), "job_id", "line_number", "text")  # the same lines each time, should they be too many
    rows = order.select(*COLUMNS, F.lit(0).alias("chunk")).limit(2 * sample_lines).toPandas()
    rows = rows.dropna(subset=["text"]).sort_values(["job_id", "line_number", "text"])
    return P.train("\n".join(reading_order(_groups(rows))[0] if len(rows) else []), g)


def find_in_lines(lines: DataFrame, model: P.Model) -> DataFrame:
    """(job_id, line_number, kind) of every line on which a value begins. Null texts have none."""
    held = lines.sparkSession.sparkContext.broadcast(model)

    def work(groups: list[pd.DataFrame]) -> pd.DataFrame:
        texts, where = reading_order(groups)
        rows, places = [], {}
        for line, _, _, _, kind in P.find(texts, held.value):
            k, i = where[line]
            if i < 0:
                continue
            if k not in places:
                places[k] = _own(groups[k]), groups[k]["job_id"].iloc[0], _ints(groups[k], "line_number", -1)
            own, job, number = places[k]
            if own[i]:
                rows.append((job, number[i] if number[i] >= 0 else None, kind))
        return pd.DataFrame(rows, columns=["job_id", "line_number", "kind"])

    found = chunks(lines).mapInPandas(lambda b: by_chunk(b, work), "job_id string, line_number int, kind string")
    return found.distinct()


def mask_lines(lines: DataFrame, model: P.Model) -> DataFrame:
    """(job_id, line_number, text, masked_text, kinds): each value replaced by its placeholder, the rest untouched.

    A value that goes on over lines leaves the placeholder on the line it begins on and is cut from the others.
    """
    held = lines.sparkSession.sparkContext.broadcast(model)

    def work(groups: list[pd.DataFrame]) -> pd.DataFrame:
        texts, where = reading_order(groups)
        cuts: dict[tuple[int, int], list[tuple[int, int, str]]] = {}
        for a, start, b, end, kind in P.find(texts, held.value):
            for line in range(a, b + 1):
                at = (start if line == a else 0, end if line == b else len(texts[line]), kind if line == a else "")
                cuts.setdefault(where[line], []).append(at)
        rows = []
        for k, g in enumerate(groups):
            for i, (job, n, text, chunk) in enumerate(zip(g["job_id"], g["line_number"], g["text"], g["chunk"], strict=True)):
                if (-1 if pd.isna(n) else n) // CHUNK != chunk:
                    continue
                out, kinds = text, []
                spans = cuts.get((k, i), [])
                if spans:
                    places = P.scan_places(text)
                    until = len(text) + 1
                    for start, end, kind in sorted(spans, reverse=True):
                        if places[end] > until:
                            continue
                        until = places[start]
                        out = out[:until] + (P.placeholder(kind) if kind else "") + out[places[end] :]
                        kinds += [kind] if kind else []
                rows.append((job, n, text, out, sorted(set(kinds))))
        return pd.DataFrame(rows, columns=["job_id", "line_number", "text", "masked_text", "kinds"])

    schema = "job_id string, line_number int, text string, masked_text string, kinds array<string>"
    return chunks(lines).mapInPandas(lambda b: by_chunk(b, work), schema)


def _readable() -> tuple:
    """Whether masked_text, and whether match_hmac, isn't protected as it should be: no pure mask (a tail of four stays
    allowed), no digest."""
    masked = F.col("masked_text").rlike(r"[\p{L}\p{Nd}]") & ~F.col("masked_text").rlike(r"^[^\p{L}\p{Nd}]*[\p{L}\p{Nd}]{0,4}$")
    digest = F.col("match_hmac").rlike(r"\S") & ~F.col("match_hmac").rlike(r"^\s*[0-9a-fA-F]{32}\s*$")
    return masked, digest


def readable_values(hits: DataFrame) -> DataFrame:
    """(job_id, line_number, field_name, value) of the fields of hits that show a readable value."""
    masked, digest = _readable()
    fields = F.array(
        F.when(masked, F.struct(F.lit("masked_text").alias("field_name"), F.col("masked_text").alias("value"))),
        F.when(digest, F.struct(F.lit("match_hmac").alias("field_name"), F.col("match_hmac").alias("value"))),
    )
    return hits.where(masked | digest).select("job_id", "line_number", F.explode(F.filter(fields, lambda x: x.isNotNull())).alias("f")).select(
        "job_id", "line_number", "f.field_name", "f.value"
    )


def _bare(copy: str) -> str:
    """The value itself in the scanning copy of a field."""
    return copy.removeprefix("raw:").strip("[]• \t")


def mask_hits(hits: DataFrame, model: P.Model) -> DataFrame:
    """hits with the readable values in masked_text and match_hmac replaced by placeholders; protected fields, and what is
    readable but no personal information, stay as they are."""
    held = hits.sparkSession.sparkContext.broadcast(model)

    def masked(values: pd.Series) -> pd.Series:
        out = values.copy()
        for i in values.index[values.notna()]:
            value = values[i]
            copy = P.scan_copy(value)
            bare = _bare(copy)
            at, places = copy.find(bare), P.scan_places(value)
            for _, start, _, end, kind in sorted(P.find([bare], held.value), reverse=True):
                out[i] = out[i][: places[at + start]] + P.placeholder(kind) + out[i][places[at + end] :]
        return out

    fix = F.pandas_udf(masked, T.StringType()).asNondeterministic()
    for name, open_ in zip(("masked_text", "match_hmac"), _readable(), strict=True):
        readable = F.coalesce(open_, F.lit(False))
        hits = hits.withColumn("_fixed", fix(F.when(readable, F.col(name)))).withColumn(name, F.coalesce("_fixed", name)).drop("_fixed")
    return hits


def find_in_hits(hits: DataFrame, model: P.Model) -> DataFrame:
    """(job_id, line_number, field_name, kind) of hits with a readable value."""
    held = hits.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines: list[str] = []
            for value in batch["value"]:
                lines += [_bare(P.scan_copy(value)), P.BREAK]
            rows = [(line // 2, kind) for line, _, _, _, kind in P.find(lines, held.value)]
            at = batch.iloc[[r[0] for r in rows]]
            yield at[["job_id", "line_number", "field_name"]].assign(kind=[r[1] for r in rows])

    schema = "job_id string, line_number int, field_name string, kind string"
    return readable_values(hits).mapInPandas(run, schema).distinct()
