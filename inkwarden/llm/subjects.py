"""Subject areas of documents, from curated and learned weighted subject terms.

Terms are runs of one to three words. Curated ones come with the subjects, as the words of their descriptions; others are
learned from readers' labels: all labelled documents are counted, term by subject, and a term tells of a subject if
documents with it have the subject clearly more often than others. All documents are then matched with one automaton of all
terms. The number of documents each term is in, over all of them, gives its rarity. Each sentence is about the subject its
terms point to most, a term of several subjects leaning to the one the rest of the document is about; a document has every
subject whose share of the sentences exceeds that subject's threshold. Thresholds are calibrated on the labelled documents,
matched and scored exactly as all others are.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.session import materialise

LEAST_DOCUMENTS, LEAST_Z, LEAST_RATE = 2, 4.0, 0.3
CURATED_WEIGHT = 0.5
GRID = np.arange(0.05, 0.951, 0.01)
POOLED = 30.0  # labels of all subjects together count this many beside a subject's own, so that few labels don't decide alone
# Marks between sentences and texts: characters that count as letters but make up no word of their own.
END, NEXT = "\u02d0", "\u02d1"
_CUT = re.compile(r"[.!?…]\s+|\n+")
_GAP = re.compile(r"[\W\d_]+")


def plain_sentences(texts: Iterable[str]) -> list[str]:
    """Of each text the words in lower case, two spaces before and after each, and END between sentences. Numbers are no
    words, and a hyphen parts words. Many texts are worked on as one."""
    text = f" {NEXT} ".join(t.replace(END, " ").replace(NEXT, " ") for t in texts).lower()
    return _GAP.sub("  ", f" {_CUT.sub(f' {END} ', text)} ").split(NEXT)


def _grams(plain: str) -> list[str]:
    """Distinct terms of one to three words that don't reach over a sentence."""
    out: set[str] = set()
    for s in plain.split(END):
        w = s.split()
        out.update(w)
        out.update(map(" ".join, zip(w, w[1:], strict=False)))
        out.update(map(" ".join, zip(w, w[1:], w[2:], strict=False)))
    return sorted(out)


@dataclass
class Lexicon:
    subjects: list[str]
    terms: list[str]
    weight: np.ndarray  # terms x subjects, 0 where a term doesn't tell of a subject


def curated_terms(areas: DataFrame) -> DataFrame:
    """(subject, term): the words of the subjects' names and descriptions, short ones aside."""
    words = F.split(F.regexp_replace(F.lower(F.concat_ws(" ", "subject", "description")), r"[^\p{L}]+", " "), " ")
    known = areas.where(F.col("subject").isNotNull()).select("subject", F.explode(F.array_distinct(words)).alias("term"))
    return known.where(F.length("term") > 3).where(~F.col("term").isin("their", "with", "work"))


def given_subjects(labels: DataFrame) -> DataFrame:
    """(doc_id, subjects): each labelled document once, with the subjects readers gave it; none for the label "none"."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    return known.withColumn("subjects", F.filter("subjects", lambda s: s != "none"))


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame | None = None) -> Lexicon:
    """Terms and weights. Every labelled document is counted where it lies (a document that comes again counts again); only
    terms that tell of a subject come to the driver."""
    spark = documents.sparkSession
    given = given_subjects(labels)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "subjects": b["subjects"], "terms": [_grams(p) for p in plain_sentences(b["text"])]})

    # written first, so that its size is known: the labels go to the texts wherever they are few enough
    labelled = texts.join(materialise(given, "labels"), "doc_id")
    held = materialise(labelled.mapInPandas(grams, "doc_id long, subjects array<string>, terms array<string>"), "labelled-terms")
    base = held.select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    total = held.count()
    rate = {r["subject"]: r["n"] / total for r in base.collect()}  # a row each subject
    curated = [] if areas is None else [(r["subject"], r["term"]) for r in curated_terms(areas).collect()]
    subjects = sorted(rate.keys() | {s for s, _ in curated})
    if not subjects:
        return Lexicon([], [], np.zeros((0, 0)))
    each = held.select(F.explode("terms").alias("term"), "subjects")
    seen = [F.count_if(F.array_contains("subjects", s)).alias(f"s{k}") for k, s in enumerate(subjects)]
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *seen).where(F.col("n") >= LEAST_DOCUMENTS)
    tells = []
    for k, s in enumerate(subjects):
        b = rate.get(s, 0.0)
        p = (F.col(f"s{k}") + 2 * b) / (F.col("n") + 2)
        z = (F.col(f"s{k}") - F.col("n") * b) / F.sqrt(F.col("n") * b * (1 - b) + 1e-9)
        tells.append(F.when((p >= LEAST_RATE) & (p >= 2 * b) & (z >= LEAST_Z), p).otherwise(0.0))
    rows = counts.select("term", F.array(*tells).alias("weight")).where(F.exists("weight", lambda w: w > 0)).collect()
    weight = {r["term"]: np.array(r["weight"]) for r in rows}
    for s, term in curated:
        own = weight.setdefault(term, np.zeros(len(subjects)))
        if not own.any():
            own[subjects.index(s)] = CURATED_WEIGHT
    terms = sorted(t for t in weight if not _said_within(t, weight))
    return Lexicon(subjects, terms, np.array([weight[t] for t in terms]).reshape(len(terms), len(subjects)))


def _said_within(term: str, weight: dict[str, np.ndarray]) -> bool:
    """Whether a longer term says no more than the term within it."""
    w = term.split(" ")
    k = int(weight[term].argmax())
    return len(w) > 1 and any(i in weight and weight[i][k] >= weight[term][k] - 0.1 for i in (" ".join(w[1:]), " ".join(w[:-1])))


class Matcher:
    """Leftmost-longest terms of many documents at a time, whole words only."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(f" {t.replace(' ', '  ')} ", i)
        self.any = bool(terms)
        if self.any:
            self.automaton.make_automaton()

    def __call__(self, plain: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(terms, their sentences) of each document, and its number of sentences with words."""
        text = END.join(plain)
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(text)), dtype=np.int64).reshape(-1, 2) if self.any else np.zeros((0, 2), np.int64)
        starts = np.cumsum([0, *(len(p) + 1 for p in plain)])
        doc = np.searchsorted(starts, found[:, 0], side="right") - 1
        ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") == ord(END))
        sentence = np.searchsorted(ends, found[:, 0])
        cuts = np.searchsorted(doc, np.arange(1, len(plain)))
        count = np.array([sum(bool(s.strip()) for s in p.split(END)) for p in plain])
        return np.split(found[:, 1], cuts), np.split(sentence, cuts), count


def shares(terms: list[np.ndarray], sentence: list[np.ndarray], count: np.ndarray, weight: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """documents x subjects: the share of each document's sentences that are about each subject, for a batch at a time."""
    out = np.zeros((len(terms), weight.shape[1]))
    sizes = np.array([len(t) for t in terms])
    if not sizes.sum():
        return out
    flat, place = np.concatenate(terms).astype(np.int64), np.concatenate(sentence)
    doc = np.repeat(np.arange(len(terms)), sizes)
    w = weight[flat] * rarity[flat, None]
    about = np.zeros_like(out)
    np.add.at(about, doc, weight[flat] ** 3 * rarity[flat, None])
    lean = 0.15 + about / np.maximum(about.sum(axis=1, keepdims=True), 1e-9)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
    score = np.add.reduceat(w, first, axis=0) * lean[doc[first]]
    best = score.argmax(axis=1)
    good = score[np.arange(len(best)), best] > 0
    np.add.at(out, (doc[first][good], best[good]), 1)
    return out / np.maximum(count, 1)[:, None]


def calibrate(got: np.ndarray, given: list[set[str]], subjects: list[str]) -> np.ndarray:
    """Per subject the threshold of the highest F1 on the labelled documents, its own counts and those of all subjects
    together at the weight of POOLED labels; of equals the middle one."""
    truth = np.array([[s in g for s in subjects] for g in given], dtype=bool).reshape(len(given), len(subjects))
    over = np.stack([got >= t - 1e-9 for t in GRID])  # thresholds x documents x subjects
    right, taken, wanted = (over & truth).sum(axis=1).astype(float), over.sum(axis=1).astype(float), truth.sum(axis=0).astype(float)
    part = POOLED / max(POOLED, wanted.sum())
    right, taken, wanted = (x + part * x.sum(axis=-1, keepdims=True) for x in (right, taken, wanted))
    f1 = 2 * right / np.maximum(taken + wanted, 1e-9)
    return np.array([GRID[np.flatnonzero(f1[:, k] >= f1[:, k].max() - 1e-12)].mean() - 1e-9 for k in range(len(subjects))])


def assign(documents: DataFrame, lexicon: Lexicon, labels: DataFrame) -> DataFrame:
    """doc_id, subject, share: every subject above its threshold. Null and empty texts, and texts without terms, have none.

    Rarity is counted over all documents; one number a term comes to the driver, and of the labelled documents one small
    array of shares each, by which the thresholds are calibrated. Repeated rows give repeated results.
    """
    spark = documents.sparkSession
    found = "doc_id long, subject string, share double"
    if not lexicon.terms:
        return spark.createDataFrame([], found)
    terms = spark.sparkContext.broadcast(lexicon.terms)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms.value)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                t, s, n = matcher(plain_sentences(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "sentences": n, "terms": t, "places": s})

    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    matched = materialise(texts.mapInPandas(match, "doc_id long, sentences int, terms array<int>, places array<long>"), "matched")
    counted = matched.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = matched.count()
    rarity = np.full(len(lexicon.terms), math.log(1 + sizes))
    for r in counted.collect():  # one row a term
        rarity[r["term"]] = math.log(1 + sizes / r["df"])
    rarity = rarity / max(rarity.mean(), 1e-9)
    model = spark.sparkContext.broadcast((lexicon.subjects, lexicon.weight, rarity))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        _, weight, rare = model.value
        for b in batches:
            yield b, shares(b["terms"].tolist(), b["places"].tolist(), b["sentences"].to_numpy(), weight, rare)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, got in scored(batches):
            yield pd.DataFrame({"subjects": b["subjects"], "shares": list(got)})

    labelled = matched.join(materialise(given_subjects(labels), "labels"), "doc_id")
    rows = labelled.mapInPandas(known, "subjects array<string>, shares array<double>").toPandas()
    got = np.array(rows["shares"].tolist()).reshape(len(rows), len(lexicon.subjects))
    threshold = calibrate(got, [set(s) for s in rows["subjects"]], lexicon.subjects)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subjects = np.array(model.value[0], dtype=object)
        for b, got in scored(batches):
            doc, k = np.nonzero((got >= threshold) & (got > 0))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[doc], "subject": subjects[k], "share": got[doc, k]})

    return matched.mapInPandas(score, found)
