"""Repairing scanned text over tables of text lines.

Lines lie in blocks of one job each, so that a job of any length is many tasks' work; what goes on over the border of a block
(the next line of the running text, a paragraph, a broken word) is handed on through one small row a block, and heads and page
numbers are counted by job. No result depends on where the borders are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwarden.llm import scanned_text as S
from inkwarden.llm.boosting import Boosted
from inkwarden.session import materialise

BLOCK = 400
SAMPLE_ROWS = 20_000  # at most so many weakly labelled rows are fitted on
TRAIN_WORDS, STRANGE_WORDS = 8_000, 1_000  # words the ranker's training cases are made of
LINE = ["job", "block", "n", "row"]
_BREAK = rf"(?U)([\w&&[^\d_]][\w@]*(?:-\w+)*)[{S.MARKS}]\s*$"


@F.pandas_udf(T.StringType())
def _copied(texts: pd.Series) -> pd.Series:
    return texts.map(S.scan_copy, na_action="ignore")


_copied = _copied.asNondeterministic()  # worked out once a line, wherever it is used


def _slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_lines(text_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, words). Lines once each: job (empty where null), block, n (-1 where null), row (a number of its own), page, top, foot,
    text, copy (a scanning copy where it may differ from the text), scanned, written, broken. Null texts are left out.

    Words: job, n, row, scanned and tokens, the pieces of the line without the parts of words that are broken over lines.
    """
    n = F.coalesce("line_number", F.lit(-1))
    top = F.coalesce("line_on_page", F.lit(0))
    rows = text_lines.where(F.col("text").isNotNull()).select(
        F.coalesce("job_id", F.lit("")).alias("job"), F.floor(n / BLOCK).cast("int").alias("block"), n.alias("n"), F.coalesce("page_number", F.lit(1)).alias("page"), top.alias("top"), (F.coalesce("lines_on_page", F.lit(1)) - 1 - top).alias("foot"), "text",
        F.coalesce(F.lower(F.trim("source")) == "ocr", F.lit(False)).alias("scanned"),
    )
    rows = rows.repartition("job", "block").dropDuplicates(["job", "block", "n", "text"])
    plain = F.col("text").rlike(r"^[\t\n\f\r\x20-\x7e]*\z")
    ends = F.col("text").rlike(rf"(?U)[{S.MARKS}]\s*$")  # most lines need no look at their words
    rows = rows.withColumns(
        {
            "row": F.monotonically_increasing_id(), "copy": _copied(F.when(~plain, F.col("text"))), "broken": ends & F.col("text").rlike(_BREAK),
            "written": F.when(plain, F.col("text").rlike(r"\S")).otherwise(F.col("text").rlike(r"(?U)\S")),
        }
    )
    rows = materialise(rows, "lines")
    before = _with_neighbour(rows.where("written").select(*LINE, "text", "copy", "scanned", "broken"), ["broken"], after=False)
    tokens = F.split(F.trim(F.coalesce("copy", "text")), r"\s+")
    head, tail = (F.when(c, 1).otherwise(0) for c in (F.coalesce("near.broken", F.lit(False)), F.col("broken")))
    whole = F.slice(tokens, head + 1, F.greatest(F.lit(0), F.size(tokens) - head - tail))
    words = before.select("job", "n", "row", "scanned", whole.alias("tokens"))
    return rows, materialise(words.where(F.size("tokens") > 0), "line-words")


def _with_neighbour(rows: DataFrame, fields: list[str], after: bool) -> DataFrame:
    """rows with ``near``: the fields of the job's next row (or the one before), whatever block it lies in."""
    place = F.struct("n", "row")
    inside = Window.partitionBy("job", "block").orderBy("n", "row")
    step, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    ends = rows.groupBy("job", "block").agg(edge(F.struct(*fields), place).alias("end"))
    blocks = ends.select("job", "block", step("end").over(Window.partitionBy("job").orderBy("block")).alias("_far"))
    return rows.withColumn("_near", step(F.struct(*fields)).over(inside)).join(blocks, ["job", "block"]).withColumn("near", F.coalesce("_near", "_far")).drop("_near", "_far")


# --- words ---


def wordlike(word: Column) -> Column:
    """As :func:`scanned_text.is_wordlike`."""
    letters = F.length(F.regexp_replace(word, r"[^\p{L}]", ""))
    return (F.length(word) > 2) & (letters >= 2) & (2 * letters > F.length(word)) & ~word.rlike("(?U)" + S.CODE) & ~word.rlike("[./]")


def token_words(words: DataFrame) -> DataFrame:
    """(token, word, native, ocr): each different piece once, with the word in it and its counts by kind of line. Words are
    made out of pieces here, once each, not line by line."""
    each = words.select("scanned", F.explode("tokens").alias("token"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    types = each.groupBy("token").agg(count(~F.col("scanned")).alias("native"), count(F.col("scanned")).alias("ocr"))
    types = materialise(types, "tokens")  # or the words would be made, and judged, before counting
    word = F.lower(F.regexp_replace("token", r"(?U)^[^\w@]+|[^\w@]+$", ""))
    return types.select("token", word.alias("word"), "native", "ocr").where(wordlike(F.col("word")))


def folded(word: Column) -> Column:
    """The same folding as in :func:`scanned_text.fold`, without leaving the JVM."""
    for read, printed in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("c1", "d"), ("vv", "w"), ("li", "h")):
        word = F.replace(word, F.lit(read), F.lit(printed))
    return F.translate(word, "@c01lf6h9q5v", "aeoiitbbggsy")


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit("$$"), word, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 2), lambda i: F.substr(padded, i, F.lit(3))))


def corrections(types: DataFrame, trusted: DataFrame, ranker: S.Ranker) -> DataFrame:
    """(word, replacement, odds) for the untrusted words of scanned lines that are misread trusted words.

    ``types``: word, native, ocr; ``trusted``: word, count. Candidates share half of the q-grams of the folded forms, whose
    lengths differ by three at most. The join meets words on q-grams and the length wanted; on either side the q-grams that
    most trusted words have are left out as far as such a pair must share another one. Every pair that qualifies is ranked.
    """
    spark = types.sparkSession
    schema = "word string, replacement string, odds double"
    if ranker.model is None:
        return spark.createDataFrame([], schema)
    prepared = trusted.select(F.col("word").alias("candidate"), "count", folded(F.col("word")).alias("f"))
    prepared = prepared.select("candidate", "count", F.length("f").alias("m_c"), _grams(F.col("f")).alias("grams_c"))
    common = prepared.select(F.explode("grams_c").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    strange = types.where("ocr > 0").join(trusted, "word", "left_anti").select("word", "ocr", folded(F.col("word")).alias("f"))
    strange = strange.select("word", "ocr", F.length("f").alias("m_w"), _grams(F.col("f")).alias("grams_w"))

    def rarest(rows: DataFrame, key: list[str], grams: str, size: str) -> DataFrame:
        """The q-grams of which any partner has one: all but those that may go unshared, rarest first."""
        least = F.greatest(F.lit(1), F.ceil((F.col(size) - 2) / 2))  # shared with a word shorter by three
        each = rows.select(*key, size, F.size(grams).alias("_g"), F.explode(grams).alias("gram")).join(common, "gram")
        missing = F.col("_g") - F.count(F.lit(1)).over(Window.partitionBy(*key))  # q-grams of no trusted word stand first
        place = F.row_number().over(Window.partitionBy(*key).orderBy("df", "gram"))
        return each.withColumn("_place", place + missing).where(F.col("_place") <= F.col("_g") - least + 1).select(*key, size, "gram")

    asked = rarest(strange, ["word"], "grams_w", "m_w")
    listed = rarest(prepared, ["candidate"], "grams_c", "m_c")
    listed = listed.select("candidate", "gram", F.explode(F.sequence(F.col("m_c") - 3, F.col("m_c") + 3)).alias("m_w"))
    met = asked.join(listed, ["gram", "m_w"]).select("word", "candidate").distinct()
    shared = F.size(F.array_intersect("grams_w", "grams_c"))
    pairs = (
        met.join(prepared, "candidate")
        .join(strange, "word")
        .where(F.abs(F.length("word") - F.length("candidate")) <= 3)
        .select("word", "ocr", "candidate", "count", shared.cast("int").alias("shared"), F.least("m_w", "m_c").alias("m"))
        .where(F.col("shared") * 2 >= F.col("m") + 1)
        .select("word", "ocr", "candidate", "count", "shared")
    )
    held = spark.sparkContext.broadcast(ranker)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield held.value.scored(b)

    # few bytes, much work a row: spread over tasks whatever the size
    odds = pairs.repartition(_slots(types), "word", "candidate").mapInPandas(rank, "word string, candidate string, odds double")
    best = odds.groupBy("word").agg(F.max_by("candidate", F.struct("odds", "candidate")).alias("replacement"), F.max("odds").alias("odds"))
    return best.select("word", "replacement", "odds")


# --- furniture ---


class HeadModel:
    """The head classifier looks at the text and its place only; how often it is printed is asked for separately."""

    def __init__(self, model: Boosted):
        self.model = model

    def score(self, x):
        x = x.copy()
        x[:, 1:3] = 0
        return self.model.score(x) + 1.5  # repeated at the edge already: the odds of a head are raised


def edge_rows(lines: DataFrame) -> DataFrame:
    """(job, block, n, row, page, scanned, near, piece, shift, kind, alone, plain, plain_key, cut, cut_key): the edge lines of pages.

    ``near`` is the place from the nearer edge; piece to alone tell of a possible page number; plain and cut are the text
    with it and without it, with their folded forms. A page may go on over blocks: each gives its first and last lines.
    """
    columns = [*LINE, "page", "scanned"]
    both = lambda w: [F.row_number().over(w.orderBy(*by)) for by in (("n", "row"), (F.desc("n"), F.desc("row")))]
    rows = lines.where("written").select(*columns, F.coalesce("copy", "text").alias("copy"))
    for w in (Window.partitionBy("job", "block", "page"), Window.partitionBy("job", "page")):
        top, foot = both(w)
        rows = rows.withColumn("near", F.least(top, foot) - 1).where("near < 3")

    def of(text: str, page: int) -> tuple:
        copy = text.strip()
        piece, number, kind, alone = S.numbered(copy) or (None,) * 4
        plain, cut = S.head_piece(copy, None), S.head_piece(copy, piece)
        return piece, None if number is None else number - page, kind, alone, plain, plain and S.fold(plain), cut, cut and S.fold(cut)

    made = ["piece", "shift", "kind", "alone", "plain", "plain_key", "cut", "cut_key"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [of(c, p) for c, p in zip(b["copy"], b["page"], strict=True)]
            yield b.drop(columns="copy").assign(**{c: [f[k] for f in found] for k, c in enumerate(made)}).astype({"shift": "Int64"})

    schema = ("job string, block int, n int, row long, page int, scanned boolean, near int, piece string, shift int, kind string, alone boolean, "
              "plain string, plain_key string, cut string, cut_key string")  # fmt: skip
    return rows.select(*columns, "near", "copy").mapInPandas(work, schema)


def numbered_edges(lines: DataFrame) -> DataFrame:
    """(job, block, n, row, scanned, near, total, number, piece, key, on): edge lines with the decision on page numbers, what
    else is printed on them, and on how many pages of the job that is printed at an edge.

    The same decisions as in :func:`scanned_text.page_numbers`, from counts by job, so a job of any length is many tasks' work.
    """
    edges = materialise(edge_rows(lines), "edge-lines")
    totals = lines.groupBy("job").agg(F.countDistinct("page").cast("int").alias("total"))
    runs = edges.where("kind IS NOT NULL").groupBy("job", "shift", "kind").agg(F.countDistinct("page").alias("often"))
    marked = edges.join(totals, "job").join(runs, ["job", "shift", "kind"], "left")
    number = F.expr(
        "kind IS NOT NULL AND CASE WHEN (kind = 'word' AND (alone OR near <= 1)) OR (often >= 2 AND (alone OR kind = 'mark' OR near <= 1)) "
        "THEN shift = 0 OR often >= 2 OR (total = 1 AND kind = 'word') ELSE shift = 0 AND alone AND near <= 1 END"
    )
    marked = marked.withColumn("number", number).select(
        *LINE, "page", "scanned", "near", "total", "number", F.expr("if(number, cut, plain)").alias("piece"), F.expr("if(number, cut_key, plain_key)").alias("key")
    )
    marked = materialise(marked, "numbered-lines")
    seen = marked.where("key IS NOT NULL").groupBy("job", "key").agg(F.countDistinct("page").cast("int").alias("on"))
    return materialise(marked.join(seen, ["job", "key"], "left").select(*LINE, "scanned", "near", "total", "number", "piece", "key", "on"), "edges")


def _head_features(rows: pd.DataFrame) -> list[list[float]]:
    return [
        S.head_features(S.Line(piece, 0, 0, 0, True, 0), key, near, on, total)
        for piece, key, near, on, total in zip(rows["piece"], rows["key"], rows["near"], rows["on"], rows["total"], strict=True)
    ]


def _sample(rows: DataFrame, *key: str) -> pd.DataFrame:
    """At most SAMPLE_ROWS rows, chosen by the hash of their place."""
    return rows.orderBy(F.xxhash64(*key), *key).limit(SAMPLE_ROWS).toPandas()


def train_heads(edges: DataFrame) -> HeadModel:
    """From weak labels: what is printed on three pages or more of a job of three pages or more is a head, what is printed on one isn't."""
    rows = _sample(edges.where("key IS NOT NULL AND total >= 3 AND on <> 2").select("job", "n", "piece", "key", "near", "total", "on"), "job", "n", "piece")
    f = [[x[0], 0.0, 0.0, *x[3:]] for x in _head_features(rows)]
    return HeadModel(_fit(f, (rows["on"] >= 3).tolist(), S.HEAD_CASES))


def _fit(rows: list[list[float]], target: list[bool], cases: tuple[list[list[float]], list[bool]]) -> Boosted:
    """Boosted trees over the weakly labelled rows and a few stated cases, which decide where there is little else."""
    x, y = np.array([*rows, *cases[0]]), np.array([*target, *cases[1]], dtype=float)
    return Boosted(trees=30).fit(x, y)


def furniture(edges: DataFrame, head: HeadModel) -> DataFrame:
    """(job, block, n, row, scanned, number, head): lines with a page number or a running head, decided over whole jobs."""
    held = edges.sparkSession.sparkContext.broadcast(head)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            again = b["key"].notna() & (b["on"].fillna(0) >= 2)
            good = again.copy()
            good[again] = S.good_heads(_head_features(b[again]), held.value)
            yield b[[*LINE, "scanned", "number", "key"]].assign(head=good.astype(bool))

    schema = "job string, block int, n int, row long, scanned boolean, number boolean, key string, head boolean"
    judged = materialise(edges.mapInPandas(score, schema), "judged-lines")
    keys = judged.where("head AND length(key) >= 6").select("job", "key").distinct()
    others = judged.where("NOT head AND key IS NOT NULL").withColumn("part", F.floor(F.col("block") / 50).cast("int"))
    others = others.join(keys.select("job").distinct(), "job", "left_semi").select("job", "part", F.lit(1).alias("after"), "key", "row")
    sent = others.select("job", "part").distinct().join(keys, "job").select(
        "job", "part", F.lit(0).alias("after"), "key", F.lit(None).cast("long").alias("row")
    )
    both = sent.unionByName(others).repartition("job", "part").sortWithinPartitions("job", "part", "after")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The keys of a job come before its other lines."""
        place, held_keys, sizes = None, set(), set()
        for b in batches:
            rows = []
            for job, part, after, key, row in zip(b["job"], b["part"], b["after"], b["key"], b["row"], strict=True):
                if place != (job, part):
                    place, held_keys, sizes = (job, part), set(), set()
                if not after:
                    held_keys.add(key)
                    sizes.add(len(key))
                elif any(key[i : i + size] in held_keys for size in sizes for i in range(len(key) - size + 1)):
                    rows.append(int(row))
            yield pd.DataFrame({"row": rows})

    holding = both.mapInPandas(within, "row long").withColumn("holds", F.lit(True))
    decided = judged.join(holding, "row", "left").withColumn("head", F.expr("head OR coalesce(holds, false)")).where("number OR head")
    return materialise(decided.select(*LINE, "scanned", "number", "head"), "furniture")


def body_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines that are no furniture. The furniture of a block is brought to it as one row, so the lines stay where they lie."""
    aside = found.groupBy("job", "block").agg(F.collect_set("row").alias("_aside"))
    rows = lines.join(aside, ["job", "block"], "left")
    return rows.where(~F.coalesce(F.array_contains("_aside", F.col("row")), F.lit(False))).drop("_aside")


# --- broken words ---


def break_pairs(body: DataFrame, trusted: DataFrame) -> DataFrame:
    """Lines that end in a broken word, with the next line of the running text and what is known of the parts.

    job, block, n, row, text, scanned, next_n, next_row, b, capital, f (features), y (weak label or null).
    """
    written = body.where("written")
    width = written.groupBy("job").agg(F.max(F.length("text")).alias("width"))
    near = _with_neighbour(written.select(*LINE, "text", "scanned", "copy", "broken"), ["n", "row", "text", "copy"], after=True).where("broken AND near IS NOT NULL")
    rows = near.join(width, "job").select(*LINE, "text", "scanned", "width", F.col("near.n").alias("next_n"), F.col("near.row").alias("next_row"), F.coalesce("near.copy", "near.text").alias("next_copy"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [S.break_parts(t, c) for t, c in zip(b["text"], b["next_copy"], strict=True)]
            keep = [g is not None for g in got]
            out = b[keep].drop(columns="next_copy")
            yield out.assign(**{c: [g[k] for g in got if g] for k, c in enumerate(("last", "b", "mark", "capital"))})

    schema = "job string, block int, n int, row long, text string, scanned boolean, width int, next_n int, next_row long, last string, b string, mark string, capital boolean"
    rows = materialise(rows.mapInPandas(parts, schema), "broken-lines")
    forms = F.array(F.concat("last", "b"), F.concat_ws("-", "last", "b"), F.col("last"), F.col("b"))
    asked = rows.select(F.explode(forms).alias("word")).distinct().join(trusted, "word")
    counts = materialise(asked.select("word", "count"), "known-parts")
    for k, form in enumerate((F.concat("last", "b"), F.concat_ws("-", "last", "b"), F.col("last"), F.col("b"))):
        rows = rows.join(counts.select(F.col("word").alias(f"_w{k}"), F.col("count").alias(f"k{k}")), form == F.col(f"_w{k}"), "left").drop(f"_w{k}")
    log = lambda k: F.log1p(F.coalesce(f"k{k}", F.lit(0)).cast("double"))
    f = F.array(
        log(0), log(1), log(2), log(3), F.length("last").cast("double"), F.length("b").cast("double"), (F.col("mark") == "-").cast("double"),
        F.length("text") / F.col("width"), F.col("b").isin(*S.JOINERS).cast("double"),
    )
    whole, both = F.col("k0").isNotNull() | F.col("k1").isNotNull(), F.col("k2").isNotNull() & F.col("k3").isNotNull()
    y = F.when(whole, True).when(both, False)
    return materialise(rows.select(*LINE, "text", "scanned", "next_n", "next_row", "b", "capital", f.alias("f"), y.alias("y")), "break-pairs")


def broken_words(pairs: DataFrame) -> DataFrame:
    """(job, block, n, row, scanned, next_n, next_row, joined): the breaks that are real, with the word that is joined over them."""
    rows = _sample(pairs.where("y IS NOT NULL").select("job", "n", "text", "f", "y"), "job", "n", "text")
    held = pairs.sparkSession.sparkContext.broadcast(_fit(rows["f"].tolist(), rows["y"].tolist(), S.BREAK_CASES))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["f"].tolist()).reshape(len(b), -1)
            good = (held.value.score(x) > 0) & ~b["capital"].to_numpy(dtype=bool) if len(b) else np.zeros(0, bool)
            out = b[good]
            words = [S.joined_word(*r) for r in out[["text", "b", "f"]].itertuples(index=False, name=None)]
            yield out[[*LINE, "scanned", "next_n", "next_row"]].assign(joined=words)

    return pairs.mapInPandas(score, "job string, block int, n int, row long, scanned boolean, next_n int, next_row long, joined string")


class Repair:
    """Everything learned from one table of lines, and the corrections of its words."""

    def __init__(self, text_lines: DataFrame):
        self.lines, self.words = read_lines(text_lines)
        self.tokens = materialise(token_words(self.words), "token-words")
        types = self.tokens.groupBy("word").agg(F.sum("native").alias("native"), F.sum("ocr").alias("ocr"))
        self.types = materialise(types, "word-types")
        spelled = self.types.where((F.col("native") >= 2) & F.col("word").rlike(r"^[\p{L}]+(-[\p{L}]+)*$"))
        self.trusted = materialise(spelled.select("word", F.col("native").alias("count")), "trusted-words")
        known = self.trusted.orderBy(F.desc("count"), "word").limit(TRAIN_WORDS).collect()
        strange = self.types.where("ocr > 0 AND native = 1").orderBy(F.xxhash64("word"), "word").limit(STRANGE_WORDS)
        self.ranker = S.train_ranker({r["word"]: r["count"] for r in known}, [r["word"] for r in strange.collect()])
        self.fixes = materialise(corrections(self.types, self.trusted, self.ranker), "corrections")
        edges = numbered_edges(self.lines)
        self.aside = furniture(edges, train_heads(edges))
        self.breaks = materialise(broken_words(break_pairs(body_lines(self.lines, self.aside), self.trusted)), "broken-words")

    def misread(self) -> DataFrame:
        """(job, n, row, word, replacement) on scanned lines. Few pieces have a correction; they go to the lines."""
        few = materialise(self.tokens.where("ocr > 0").join(self.fixes, "word").select("token", "word", "replacement"), "token-corrections")
        return self.words.where("scanned").select("job", "n", "row", F.explode("tokens").alias("token")).join(few, "token").drop("token")

    def kinds(self) -> DataFrame:
        """(job_id, line_number, kind) of all four kinds, on scanned lines."""
        tell = lambda rows, kind: rows.select("job", "n", F.lit(kind).alias("kind"))
        aside = self.aside.where("scanned")
        found = (
            tell(self.misread(), "misread")
            .unionByName(tell(self.breaks.where("scanned"), "hyphen_break"))
            .unionByName(tell(aside.where("head"), "running_head"))
            .unionByName(tell(aside.where("number"), "page_number"))
        )
        return found.select(F.expr("nullif(job, '')").alias("job_id"), F.expr("nullif(n, -1)").alias("line_number"), "kind").distinct()

    def paragraphs(self) -> DataFrame:
        """(job_id, line_number, paragraph): each document as paragraphs, by the line they begin on.

        Furniture is left out, broken words are joined, misread words of scanned lines replaced (capitals kept). A
        paragraph ends at an empty line within a page, or at a line that ends a sentence well short of the full width.
        Born-digital lines are joined as well but their words stay.
        """
        fixes = self.misread().groupBy("job", "n", "row").agg(F.map_from_entries(F.collect_set(F.struct("word", "replacement"))).alias("fixes"))
        ends = self.breaks.select("job", "n", "row", F.lit(True).alias("ends"))
        begins = self.breaks.select("job", F.col("next_n").alias("n"), F.col("next_row").alias("row"), "joined")
        changes = fixes.join(ends, ["job", "n", "row"], "full").join(begins, ["job", "n", "row"], "full")
        per_block = changes.groupBy("job", F.floor(F.col("n") / BLOCK).cast("int").alias("block"))
        per_block = per_block.agg(F.map_from_entries(F.collect_list(F.struct("row", F.struct("fixes", "ends", "joined").alias("change")))).alias("_changes"))
        body = body_lines(self.lines, self.aside)
        width = body.where("written").groupBy("job").agg(F.max(F.length("text")).alias("width"))
        rows = body.join(per_block, ["job", "block"], "left").withColumn("c", F.try_element_at("_changes", F.col("row"))).drop("_changes")
        flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
        new = F.when(F.col("c").isNull(), flat).otherwise(_repaired("text", "c.fixes", F.coalesce("c.ends", F.lit(False)), "c.joined"))
        rows = rows.withColumn("new", new).join(width, "job", "left")
        ends_here = F.coalesce("c.ends", F.lit(False))
        closes = F.col("written") & ~ends_here & F.col("new").rlike(r"[.!?:]$") & (F.length("text") < 0.75 * F.col("width"))
        rows = materialise(rows.select(*LINE, "written", "new", ends_here.alias("ends"), closes.alias("closes"), ((F.col("top") > 1) & (F.col("foot") > 1)).alias("inner")), "body")
        rows = rows.repartition("job", "block")
        before = Window.partitionBy("job", "block").orderBy("n", "row").rowsBetween(Window.unboundedPreceding, -1)
        by_block = Window.partitionBy("job").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        last = rows.where("written").groupBy("job", "block").agg(F.max_by("ends", F.struct("n", "row")).alias("e"))
        every = rows.select("job", "block").distinct().join(last, ["job", "block"], "left")
        every = every.select("job", "block", F.last("e", ignorenulls=True).over(by_block).alias("_open"))
        rows = rows.join(every, ["job", "block"]).withColumn("open", F.coalesce(F.last(F.when(F.col("written"), F.col("ends")), ignorenulls=True).over(before), "_open", F.lit(False)))
        mark = F.when(F.col("written"), F.col("closes")).otherwise(F.col("inner") & ~F.col("open")).cast("int")
        rows = rows.withColumn("mark", mark)
        sums = rows.groupBy("job", "block").agg(F.sum("mark").alias("m"))
        sums = sums.select("job", "block", F.coalesce(F.sum("m").over(by_block), F.lit(0)).alias("_before"))
        rows = rows.join(sums, ["job", "block"]).withColumn("part", F.col("_before") + F.coalesce(F.sum("mark").over(before), F.lit(0)))
        listed = F.array_sort(F.collect_list(F.struct("n", "row", "new")))
        out = rows.where("written AND new <> ''").groupBy("job", "part").agg(F.min("n").alias("n"), F.array_join(F.transform(listed, lambda x: x["new"]), " ").alias("paragraph"))
        return out.select(F.expr("nullif(job, '')").alias("job_id"), F.expr("nullif(n, -1)").alias("line_number"), "paragraph")


@F.pandas_udf(T.StringType())
def _repaired(text: pd.Series, fixes: pd.Series, ends: pd.Series, joined: pd.Series) -> pd.Series:
    return pd.Series([S.repaired(t, f, e, j) for t, f, e, j in zip(text, fixes, ends, joined, strict=True)], dtype=object)
