"""Groups of records whose texts are nearly the same, found without comparing all pairs.

Exact set-similarity join on word shingles (Jaccard). Texts with one and the same shingle set are one class, so copies
never meet each other. The sets are dealt to blocks, and each two blocks meet in one task (:mod:`inkwarden.llm.set_tiles`).
There, shingles are ordered rarest first by their counts in the two blocks; two alike sets must share one of the rarest
shingles of both (prefix principle):

* *small* sets, whose lists of these shingles are short, scan the inverted lists, among the sets of fitting size only;
* *large* ones, whose lists together hold more sets than there are of fitting size, meet each of these once instead.

So a shingle of very many sets costs no more than a look at the sketches of all sets of fitting size. Pairs whose places or
sketches leave it open whether they share enough are compared on the whole sets. No list, set or pair is cut short.
Only alike pairs leave a task: nothing that grows with the pairs met is shuffled or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarden.llm import set_tiles
from inkwarden.session import discard, materialise

CUTS = (1, 4, 16, 64, 256, 1024, 4096, 16_384, 65_536, 1 << 40)
BLOCK = 4096  # sets of a file; a task reads whole files
SHINGLES = 4_000_000  # of a block, about: two blocks are held by a task


def words(text: Column) -> Column:
    """Maximal runs of Unicode letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def shingles(w: Column, size: int) -> Column:
    """Distinct hashes of ``size`` consecutive words, in ascending order; fewer words have none. ``w``: hashes of the words.

    The words are read from arrays that begin one word later each, so that no expression runs again for each shingle.
    """
    many = F.greatest(F.size(w) - F.lit(size - 1), F.lit(0))
    out = F.slice(w, F.lit(1), many)
    for k in range(1, size):
        out = F.zip_with(out, F.slice(w, F.lit(k + 1), many), lambda x, y: F.xxhash64(x, y))
    return F.sort_array(F.array_distinct(out))


def classes(docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(membership: key, class_id) and (sets: class_id, set_id).

    A class holds the records of one and the same shingle set; its id is the least key. Records whose text is null or
    too short for one shingle belong to no class. A key with several texts belongs to the class of each. Texts are read
    where they lie and never shuffled, and neither are their shingles: these are written once, in the order of the scan,
    in files of BLOCK rows, and the files of that table (``sets._grams``) are read again where sets meet. What is
    shuffled is the key and two 64-bit sums of the set, of one seed each.
    """
    hashes = F.transform(words(F.col(text)), lambda x: F.xxhash64(x))
    w = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_key"), hashes.alias("_words"))
    grams = w.select("_key", shingles(F.col("_words"), size).alias("grams"))  # a filter here would make them twice
    sums = {"_h": F.xxhash64("grams"), "_i": F.xxhash64(F.lit(1), "grams"), "n": F.size("grams"), "set_id": F.monotonically_increasing_id()}
    read = materialise(grams.withColumns(sums), "grams", rows=BLOCK)
    least = read.where("n > 0").groupBy("_h", "_i").agg(F.min(F.struct("_key", "set_id")).alias("least"))
    # the row that gave the class its name stands for it
    least = materialise(least.select("_h", "_i", F.col("least._key").alias("class_id"), F.col("least.set_id").alias("set_id")), "sets")
    own = read.select("_key", "_h", "_i").join(least, ["_h", "_i"]).select(F.col("_key").alias(key), "class_id")
    membership = materialise(own.distinct(), "classes")
    sets = least.select("class_id", "set_id")
    sets._stored_at, sets._grams, sets._rows = least._stored_at, read, BLOCK
    return membership, sets


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(low, high, common, either): set ids, low being the smaller set, of every pair of :func:`classes` that reaches the
    threshold, with the numbers of shingles in both and in either.

    Each two blocks, and each block with itself, meet in one task, which reads them from the shared folder; the only rows
    that leave it are pairs that are alike. A task has the tiles of a square, so that a block is read once for a few others.
    """
    spark, plan = sets.sparkSession, blocks(sets)
    kept = "low long, high long, common long, either long"
    if not plan:
        return spark.createDataFrame([], kept)
    side = min(4, max(1, len(plan) // 5))  # of a square
    squares = -(-len(plan) // side)
    rows = spark.range(0, squares, 1, 1).select(F.col("id").alias("a"), F.explode(F.expr(f"sequence(id, {squares - 1}L)")).alias("b"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["a"], frame["b"], strict=True):
                left = [set_tiles.block(*set_tiles.read(files)) for files in plan[a * side : (a + 1) * side]]
                for k in range(b * side, min((b + 1) * side, len(plan))):
                    other = left[k - b * side] if a == b else set_tiles.block(*set_tiles.read(plan[k]))
                    for one in left[: k - b * side + 1] if a == b else left:
                        yield pd.DataFrame(dict(zip(("low", "high", "common", "either"), set_tiles.alike(one, other, threshold), strict=True)))

    return rows.repartition(min(squares * (squares + 1) // 2, 20_000)).mapInPandas(meet, kept)


def blocks(sets: DataFrame) -> list[list[tuple[str, bytes]]]:
    """The sets of :func:`classes` dealt to blocks of about SHINGLES shingles: (file, bitmap of its rows that stand for a class)."""
    place = {"part": F.shiftright("set_id", 33), "file": F.floor((F.col("set_id") % (1 << 33)) / sets._rows)}
    row = F.col("set_id") % (1 << 33) % sets._rows
    files = sets._grams.select("n", "_metadata.file_path", "set_id").withColumns(place).groupBy("part", "file")
    files = files.agg(F.min("file_path").alias("path"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    marks = sets.select("set_id", row.alias("row")).withColumns(place).groupBy("part", "file")
    marks = marks.agg(F.bitmap_construct_agg("row").alias("marks"), F.count(F.lit(1)).alias("sets"))
    marks = marks.withColumn("marks", F.substring("marks", 1, (sets._rows + 7) // 8))
    plan, shingles, count = [], SHINGLES + 1, 0
    for f in files.join(marks, ["part", "file"]).orderBy("part", "file").collect():
        n = f["n"] * f["sets"] // f["rows"]
        if shingles + n > SHINGLES or count + f["sets"] > set_tiles.MOST:
            plan.append([])
            shingles = count = 0
        plan[-1].append((f["path"], bytes(f["marks"])))
        shingles, count = shingles + n, count + f["sets"]
    return plan


def boundaries(heads: DataFrame, row_cost: float = 4.0) -> tuple[int, int]:
    """(cut, large): the document frequency up to which shingles are light, and the number of heavy shingles up to which a
    set is small, that cost least together.

    Scanning a list costs about half of its length for each of its entries; a small set costs its subsets and their shuffle
    (``row_cost`` times a met pair), a large one the lists of its heavy shingles. Sets are counted by cut and by the power
    of two their heavy shingles fill: one aggregation, of which a few hundred sums come to the driver.
    """
    dfs = F.transform("head", lambda x: x["df"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, d: acc + d)

    def side(cut: int) -> Column:
        light, heavy = F.filter(dfs, lambda d: d <= F.lit(cut)), F.filter(dfs, lambda d: d > F.lit(cut))
        return F.struct(F.lit(cut).cast("long").alias("cut"), F.size(heavy).alias("k"), (total(light) / 2).alias("light"), total(heavy).alias("scan"))

    sides = [side(c) for c in CUTS]
    each = heads.select(F.inline(F.array(*sides)))
    rows = (
        each.groupBy("cut", F.ceil(F.log2(F.greatest(F.col("k"), F.lit(1)))).cast("int").alias("power"))
        .agg(F.sum("light").alias("light"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("subsets"), F.sum("scan").alias("scan"))
        .collect()
    )
    powers = sorted({r["power"] for r in rows})
    costs = {
        (c, p): sum(r["light"] + (row_cost * r["subsets"] if r["power"] <= p else r["scan"]) for r in rows if r["cut"] == c)
        for c in CUTS
        for p in [-1, *powers]
    }
    cut, power = min(costs, key=lambda x: (costs[x], -x[0], x[1])) if rows else (CUTS[-1], 0)
    return cut, (2**power if power >= 0 else 0)


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes whose Jaccard likeness is at least the threshold: class_a, class_b, common, likeness."""
    pairs = materialise(candidates(sets, threshold), "alike")
    side = lambda tag: sets.select(F.col("set_id").alias(tag), F.col("class_id").alias(f"class_{tag}"))
    found = (
        pairs.join(side("low"), "low")
        .join(side("high"), "high")
        .select(
            F.least("class_low", "class_high").alias("class_a"), F.greatest("class_low", "class_high").alias("class_b"),
            F.col("common").cast("int").alias("common"), (F.col("common") / F.col("either")).alias("likeness"),
        )
        .distinct()
    )
    found = materialise(found, "links")
    discard(pairs)
    return found


def near_duplicates(docs: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, links): classes of equal shingle sets, and the links between different classes at the threshold.

    Every record with a key and a text of at least ``size`` words is in a class; null and shorter texts are alike with
    nothing. Repeated rows change nothing; other columns are ignored. Copies of a text cost one class, whatever their
    number; links are complete.
    """
    membership, sets = classes(docs, key, text, size)
    links = similar_classes(sets, threshold)
    discard(sets, sets._grams)
    return membership, links


def groups(membership: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row per record: key, class_id, group_id (least class connected by links), links (of its class).

    Components by rounds of two-sided minimum exchange, each round's labels written to the shared folder.
    """
    edges = materialise(
        links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).unionByName(
            links.select(F.col("class_b").alias("a"), F.col("class_a").alias("b"))
        ),
        "edges",
    )
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialise(labels, "labels")
    while True:
        spread = edges.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        stepped = labels.join(spread, "node").select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        old = labels
        moved = materialise(
            stepped.join(jump, "label", "left").select("node", "was", F.coalesce(F.least("root", "label"), "label").alias("label")), "labels"
        )
        labels = moved.select("node", "label")
        labels._stored_at = moved._stored_at
        discard(old)
        if moved.where("was <> label").isEmpty():
            break
    degree = edges.groupBy(F.col("a").alias("class_id")).agg(F.countDistinct("b").alias("links"))
    labels = labels.select(F.col("node").alias("class_id"), F.col("label").alias("group_id"))
    return (
        membership.join(labels, "class_id", "left")
        .join(degree, "class_id", "left")
        .select(key, "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
