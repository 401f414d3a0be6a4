import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwarden.llm import heavy_hitters as H
from inkwarden.llm import mixing as M
from inkwarden.llm import p6 as P6
from inkwarden.llm import packing as P
from inkwarden.llm import subjects as SU
from inkwarden.llm import unicode_forms as U
from inkwarden.llm.tokens import VOCABULARY, count_tokens, encoding

# --- most frequent items ---


def test_frequent_items_against_counting(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "A ", "b", None, *(f"x{k}" for k in range(400))]) if i % 3 else "hot") for i in range(6000)]
    rows += [r for r in rows if r[1] == "x7"] * 30 + [(None, "hot")] * 50
    df = spark.createDataFrame(rows, "hit_id long, v string").withColumn("item", F.lit("clash")).repartition(7)
    got = {(r.item, r.exact_count) for r in H.frequent_items(df, ["v"], "hit_id", 0.005).collect()}
    keys = {k: v and v.strip().lower() for k, v in rows if k is not None}
    count = Counter(v for v in keys.values() if v is not None)
    assert got == {(v, n) for v, n in count.items() if n >= 0.005 * len(keys)}


def test_summary_guarantee_and_empty(spark):
    rows = [(i, f"v{min(i % 50, (i * i) % 97)}") for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(40)
    count = Counter(v for _, v in rows)
    got = {r.item: (r["count"], r.removed) for r in H.merge(H.summarise(df, ["v"], 20), 20, 40, 4).collect()}
    for v, n in count.items():
        if n > 5000 / 21:
            assert v in got
    for v, (low, removed) in got.items():
        assert low <= count[v] <= low + removed
    assert H.frequent_items(df.limit(0), ["v"], "k").count() == 0
    assert H.frequent_items(spark.createDataFrame([(1, None)], "k long, v string"), ["v"], "k").count() == 0


def test_summary_without_counters_keeps_what_was_removed(spark):
    rows = [(v,) for v in ["hot", *(f"x{i}" for i in range(49)), *["hot"] * 30, *["cold"] * 20]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "v string")
    assert {r.removed for r in H.summarise(df, ["v"], 5).collect()} == {0, 1}
    got = {r.item: (r["count"], r.removed) for r in H.merge(H.summarise(df, ["v"], 5), 5, 2).collect()}
    assert got["hot"] == (30, 1) and got["cold"] == (20, 1)


# --- Unicode forms ---


def test_forms():
    assert U.consistent("Ｔｅｌ． Cáfe​ STRASSE") == U.consistent("tel. cáfe straße")
    assert U.consistent("сard") == "card" and U.consistent("Договор") == "договор"
    assert U.kinds_of("plain - text") == [] and U.kinds_of("½ m² № … é") == []
    assert U.kinds_of("Ａ") == ["fullwidth"] and U.kinds_of("é") == ["combining"] and U.kinds_of("a­b") == ["zero_width"]
    assert U.kinds_of("a　b") == ["space"] and U.kinds_of("cаt") == ["lookalike"] and U.kinds_of("Η σύμβαση") == []


def test_kinds_in_the_jvm_are_those_of_the_definition(spark):
    rng = random.Random(8)
    odd = "Ａｚ\u0301\u0308\u200b\u00ad\u2060\ufeff\u00a0\u2009\u3000\t\u0085\u2028аеорсΑοԱօᎠᏟßéđ½№…中文русский \u200d\u200e"
    texts = ["".join(rng.choice(odd + "abc XYZ 12 ,.") for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["", "plain", "cаt", "Договор", "ՕK", "Ꭰog"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.kinds for r in U.normalise(df, "text").select("i", "kinds").collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != U.kinds_of(t)] == []
    assert U.consistent("Ꭰog ՕK") == "dog ok"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_forms_are_stable(text):
    once = U.consistent(text)
    assert U.consistent(once) == once


def test_normalise_over_a_table(spark):
    rows = [("A  b",), ("Ａ b",), (None,), ("",), ("x" * 30000 + "é",), ("tab\there",)]
    df = spark.createDataFrame([(i, *r, "c") for i, r in enumerate(rows)], "i int, text string, form2 string")
    got = [r for r in U.normalise(df, "text").orderBy("i").collect()]
    assert [r.form for r in got[:4]] == ["a b", "a b", None, ""] and [r.kinds for r in got[:4]] == [[], ["fullwidth"], [], []]
    assert got[4].form == "x" * 30000 + "é" and got[5].kinds == ["space"]
    assert U.normalise(df.limit(0), "text").count() == 0


def test_kinds_are_found_without_making_forms(spark, tmp_path):
    """Every stage of p6_found counts: what it lists depends on the lines as written, so no form is made on the way."""
    texts = ["A  b", "Ａ b", None, "", "tab\there", "cаt ​x y", "é", "Договор", "Ａ b"]
    rows = [("j", i, t) for i, t in enumerate(texts)] + [("j", 1, "Ａ b")]
    spark.createDataFrame(rows, "job_id string, line_number int, text string").write.parquet(f"{tmp_path}/text_lines.parquet")
    found = P6.p6_found(spark, str(tmp_path))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "_forms" not in plan and " AS form" not in plan
    got = sorted((r.line_number, r.kind) for r in found.collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) if t for k in U.kinds_of(t))
    assert {r.line_number: r.form for r in P6.p6_lines(spark, str(tmp_path)).collect()} == {i: t if t is None else U.consistent(t) for i, t in enumerate(texts)}


# --- packing ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_sum_of_squares_respects_capacity(sizes):
    out = P.sum_of_squares(np.array(sizes, dtype=int), 30)
    fill = Counter()
    for s, b in zip(sizes, out, strict=True):
        fill[b] += s
    assert all(v <= 30 for v in fill.values()) and len(fill) <= len(sizes)


def test_sum_of_squares_packs_tightly():
    sizes = np.random.default_rng(0).integers(1, 100, 4000)
    assert P.sum_of_squares(sizes, 512).max() + 1 <= 1.02 * sizes.sum() / 512 + 1


@pytest.mark.parametrize("group_rows", [20000, 50])
def test_pack_round_trip(spark, group_rows):
    rng = random.Random(3)
    docs = [(i, rng.choice([1, 5, 17, 40, 100, 101, 350, 5000])) for i in range(400)] + [(1, 9), (None, 7), (900, None), (901, 0)]
    df = spark.createDataFrame(docs, "doc_id long, tokens int").withColumn("capacity", F.lit(1))
    specs = spark.createDataFrame([("s", 100), ("m", 700), ("s", 100), (None, None)], "spec_name string, capacity_tokens int")
    got = P.pack(df, specs, "doc_id", "tokens", group_rows).toPandas()
    for name, capacity in (("s", 100), ("m", 700)):
        mine = got[got.spec_name == name]
        assert mine.groupby("container").tokens.sum().max() <= capacity
        assert mine.tokens.sum() == sum(t or 0 for _, t in docs)
        assert Counter(mine[mine.piece == 0].doc_id.fillna(-1).astype(int)) == Counter(-1 if d is None else d for d, t in docs if t)
        whole = mine.groupby("doc_id").size()
        assert all(n == -(-dict(docs)[d] // capacity) for d, n in whole.items() if d not in (1,))
        assert mine.container.nunique() <= 1.1 * mine.tokens.sum() / capacity + 2
    assert P.pack(df.limit(0), specs, "doc_id", "tokens").count() == 0
    assert P.pack(df, specs.limit(0), "doc_id", "tokens").count() == 0


@pytest.mark.parametrize("sizes", [[600], [600, 350, 120], [501]])
def test_no_task_gathers_what_cannot_be_combined(spark, monkeypatch, sizes):
    """However many containers are left loose, a group has about group_rows of them."""
    largest = []
    keep = P.materialise

    def seen(df, name):
        out = keep(df, name)
        if name == "fitting":
            largest.append(out.groupBy("spec_name", "slot").count().agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(P, "materialise", seen)
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % len(sizes) + 1).cast("int")).alias("tokens"))
    specs = spark.createDataFrame([("s", 1000)], "spec_name string, capacity_tokens int")
    got = P.fill_report(P.pack(df, specs, "doc_id", "tokens", 200)).first()
    assert max(largest, default=0) <= 400 and got.fullest <= 1000 and got.pieces == 6000
    assert got.containers <= {1: 6000, 3: 4100}[len(sizes)]


def test_tokens(spark):
    texts = ["", None, "Hello world", "é" * 2000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", count_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got[:3] == [0, None, 2] and got[3] == len(encoding(VOCABULARY).encode_ordinary(texts[3])) and got[4] > 1


# --- mixing ---


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    p, w = np.full(50, 0.3), rng.integers(1, 40, 50).astype(float)
    runs = np.array([M.pivotal(p, w, np.random.default_rng(s)) for s in range(1500)])
    assert np.allclose(runs @ w, p @ w)
    assert (((runs > 0) & (runs < 1)).sum(axis=1) <= 1).all()
    assert abs(runs.mean(axis=0) - 0.3).max() < 0.06


def test_small_rates_are_kept(spark):
    p = M.pivotal(np.full(4000, 2.5e-10), np.ones(4000), np.random.default_rng(1))
    assert p.sum() == pytest.approx(1e-6, rel=1e-6) and ((p > 0) & (p < 1)).sum() == 1
    assert M.pivotal(np.full(40_000, 1e-4), np.ones(40_000), np.random.default_rng(1)).sum() == pytest.approx(4, abs=1e-6)


def test_sizeable_documents_are_dealt_to_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    docs = [(i, "a", 10) for i in range(3000)] + [(9000 + i, "b", 10) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = M.mix(df, targets, "doc_id", "source", "tokens").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m"))
    assert {r.source: (abs(r.t - 200) <= 10, r.m) for r in got.collect()} == {"a": (True, 1), "b": (True, 1)}


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["A", "a ", "A", "b", "b", "c", None, "other"]), rng.randint(1, 60)) for i in range(3000)] + [(5, "a", 0), (6, "a", None), (None, "a", 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens int").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.1, 5), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = M.mix(df, targets, "doc_id", "source", "tokens")
    report = {r.source: r for r in M.mix_report(mixed, df, targets, "source", "tokens").collect()}
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 5)):
        assert abs(report[s].actual_share - share / 0.9) < 0.002 and report[s].most_copies <= cap
    assert report["none"].mixed_tokens == 0
    assert M.mix(df.limit(0), targets, "doc_id", "source", "tokens").count() == 0
    assert M.mix(df, targets.limit(0), "doc_id", "source", "tokens").count() == 0
    big = M.mix_report(M.mix(df, targets, "doc_id", "source", "tokens", total_tokens=1e9), df, targets, "source", "tokens").collect()
    assert all(r.most_copies == r.max_repeats for r in big if r.documents)


# --- subjects ---


def test_subjects(spark):
    rng = random.Random(4)
    terms = {"law": ["claimant", "court order", "statute"], "sport": ["home fixture", "goalkeeper", "relay team"]}
    plain = ["The office was closed on Monday.", "Please return this sheet to the desk.", "Further details follow soon."]

    def text(subject, n, m):
        own = [f"The {rng.choice(terms[subject])} was measured in room {rng.randint(1, 9)}." for _ in range(n)] if subject else []
        body = own + [rng.choice(plain) for _ in range(m)]
        rng.shuffle(body)
        return " ".join(body)

    docs = [(i, text(("law", "sport", None)[i % 3], 4, 4)) for i in range(150)] + [(200, None), (201, ""), (202, text("law", 1, 9)), (203, text("law", 20, 20) * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("clash"))
    labels = spark.createDataFrame([(i, ("law", "sport", "none")[i % 3], "r") for i in range(90)] + [(0, "law", "q"), (None, "law", "r"), (3, None, "r")], "doc_id long, subject string, labelled_by string")
    got = {(r.doc_id, r.subject) for r in SU.assign(df, SU.fit(df, labels), labels).collect()}
    assert got == {(i, ("law", "sport")[i % 3]) for i in range(150) if i % 3 < 2} | {(203, "law")}
    assert SU.assign(df, SU.fit(df, labels.limit(0)), labels).count() == 0
    assert SU.assign(df.limit(0), SU.fit(df, labels), labels).count() == 0
