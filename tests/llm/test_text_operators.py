import random
import re

import numpy as np
from pyspark.sql import functions as F

from inkwarden.llm import near_duplicates as N
from inkwarden.llm import personal_data as P
from inkwarden.llm import personal_data_spark as PS
from inkwarden.llm import scanned_text as S
from inkwarden.llm import scanned_text_spark as SS
from inkwarden.llm import set_tiles as ST
from inkwarden.llm.boosting import Boosted
from inkwarden.llm.scanned_text_spark import Repair

# --- near duplicates ---


def brute(docs, size, threshold):
    sets = {}
    for k, t in docs:
        if k is not None and t is not None:
            w = re.findall(r"[^\W_]+", t.lower())
            grams = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
            if grams:
                sets.setdefault(k, set()).add(grams)
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] for x in sets[a] for y in sets[b] if len(x & y) >= threshold * len(x | y)}


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    docs = []
    for i in range(n):
        base = [rng.choice(common) if rng.random() < 0.7 else f"r{rng.randint(0, 60)}" for _ in range(rng.randint(3, 60))]
        docs.append((f"k{i:03d}", " ".join(base)))
        for j in range(rng.choice([0, 0, 1, 2])):
            edit = [x if rng.random() > 0.08 else f"e{rng.randint(0, 9)}" for x in base]
            docs.append((f"k{i:03d}x{j}", "\n".join(edit)))
    return docs + [(None, "a b c d"), ("null", None), ("short", "a b"), ("long", " ".join(common * 500)), docs[0], ("copy", docs[0][1])]


def pairs(spark, docs, size, threshold):
    df = spark.createDataFrame(docs, "id string, text string").withColumn("n", F.lit(1)).withColumn("class_id", F.lit("clash"))
    membership, sets = N.classes(df, "id", "text", size)
    links = N.similar_classes(sets, threshold)
    m = [(r.id, r.class_id) for r in membership.collect()]
    linked = {(r.class_a, r.class_b) for r in links.collect()}
    return {tuple(sorted((a, b))) for a, x in m for b, y in m if a < b and (x == y or (min(x, y), max(x, y)) in linked)}


def test_all_links_are_found(spark):
    for seed, size, threshold in ((1, 3, 0.5), (2, 2, 0.8), (3, 1, 0.6)):
        docs = corpus(seed, 60)
        assert pairs(spark, docs, size, threshold) == brute(docs, size, threshold)


def test_every_boundary_finds_all_links(spark, monkeypatch):
    docs = corpus(5, 60)
    want = brute(docs, 2, 0.5)
    for cut, large, block in ((1, 1000, 512), (2, 3, 3), (2, 1000, 2), (8, 0, 4), (1, 0, 512)):
        monkeypatch.setattr(N, "boundaries", lambda heads, cut=cut, large=large: (cut, large))
        monkeypatch.setattr(N, "BLOCK", block)
        df = spark.createDataFrame(docs, "id string, text string")
        membership, sets = N.classes(df, "id", "text", 2)
        found = N.candidates(sets, 0.5)
        names = {r.set_id: r.class_id for r in sets.collect()}
        classes = {tuple(sorted((names[r.low], names[r.high]))) for r in found.collect()}
        member = {r.id: r.class_id for r in membership.collect()}
        assert {p for p in want if member[p[0]] != member[p[1]] and tuple(sorted((member[p[0]], member[p[1]]))) not in classes} == set(), (cut, large)


def test_pairs_that_share_one_shingle(spark, monkeypatch):
    docs = [("a", "x y z"), ("b", "x y z u"), ("c", "q x y z"), ("d", "q x y z u"), ("e", "p q r"), ("f", "p q s r")]
    want = brute(docs, 3, 0.5)
    assert ("a", "b") in want and ("a", "d") not in want
    for cut in (1, 8, N.CUTS[-1]):
        monkeypatch.setattr(N, "boundaries", lambda heads, cut=cut: (cut, 48))
        assert pairs(spark, docs, 3, 0.5) == want, cut


def test_boundaries_follow_the_cost(spark):
    """Long lists make shingles heavy; many heavy shingles make a set large."""
    head = "array<struct<df:long,gram:long>>"
    few = [(i, [{"df": 100_000, "gram": k} for k in range(5)]) for i in range(50)]
    many = [(100 + i, [{"df": 40, "gram": k} for k in range(400)]) for i in range(50)]
    rare = [(200 + i, [{"df": 2, "gram": k} for k in range(60)]) for i in range(50)]
    choose = lambda rows: N.boundaries(spark.createDataFrame(rows, f"set_id int, head {head}"))
    cut, large = choose(few + many + rare)
    assert 2 <= cut < 100_000 and 5 <= large < 400
    assert choose(rare)[0] >= 2 and choose([]) == (N.CUTS[-1], 1)


def test_a_shingle_of_all_sets_is_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    docs = [(f"k{i:03d}", f"same old words a{i} b{i // 2} c{i // 2} d{i // 2}") for i in range(120)]
    assert pairs(spark, docs, 1, 0.6) == brute(docs, 1, 0.6)


def test_what_is_shuffled_follows_the_records_not_the_pairs_met(spark):
    """Every two records share rare-looking phrases, few are alike: no shingle, met pair or candidate goes through a shuffle."""
    rng = random.Random(4)
    phrases = [" ".join(f"p{k}x{j}" for j in range(8)) for k in range(24)]
    docs = [(f"k{i:03d}", " ".join([*rng.sample(phrases, 8), *(f"u{i}x{j}" for j in range(20))])) for i in range(100)] + [("copy", phrases[0])]
    docs += [(f"{k}x", t + " once more") for k, t in docs[:5]]
    written = lambda: sum(
        s.shuffleWriteRecords() for s in (stages.apply(i) for stages in [spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)] for i in range(stages.size()))
    )
    df = spark.createDataFrame(docs, "id string, text string")
    before = written()
    membership, links = N.near_duplicates(df, "id", "text", 3, 0.5)
    assert written() - before <= 12 * len(docs)
    got = {(r.class_a, r.class_b) for r in links.collect()}
    assert got == brute(docs, 3, 0.5) and membership.count() == len(docs)


def test_array_join_over_blocks_and_chunks():
    """Small chunks, sets that meet through lists and sets that meet all of fitting size, within a block and between two."""
    rng = random.Random(7)
    for threshold in (0.3, 0.5, 0.8):
        sets = [set(rng.sample(range(40), rng.randint(1, 30))) for _ in range(50)]
        sets += [s ^ {rng.randint(0, 39)} or {1} for s in sets[:25]]
        value = [rng.getrandbits(62) for _ in range(40)]
        block = lambda at: ST.block(np.array(at), np.array([len(sets[i]) for i in at]), np.concatenate([sorted(value[v] for v in sets[i]) for i in at]))
        x, y = block(range(0, 75, 2)), block(range(1, 75, 2))
        got = [
            (min(a, b), max(a, b), c, e)
            for p, q in ((x, x), (x, y), (y, y))
            for a, b, c, e in zip(*(v.tolist() for v in ST.alike(p, q, threshold, chunk=13)), strict=True)
        ]
        both = lambda i, j: (len(sets[i] & sets[j]), len(sets[i] | sets[j]))
        want = [(i, j, *both(i, j)) for i in range(75) for j in range(i + 1, 75) if both(i, j)[0] >= threshold * both(i, j)[1] - 1e-9]
        assert sorted(got) == want


def test_groups_and_empty(spark):
    docs = [("a", "x y z u v w q"), ("b", "x y z u v w r"), ("c", "x y z u v w r s"), ("d", "other words stand here alone now")]
    df = spark.createDataFrame(docs, "id string, text string")
    membership, links = N.near_duplicates(df, "id", "text", 2, 0.6)
    got = {r.id: (r.group_id, r.links) for r in N.groups(membership, links, "id").collect()}
    assert got["a"][0] == got["b"][0] == got["c"][0] == "a" and got["d"] == ("d", 0) and got["b"][1] == 2
    membership, links = N.near_duplicates(df.limit(0), "id", "text")
    assert N.groups(membership, links, "id").count() == 0


# --- personal data ---

FILL = ["The draft lists an open item next to the desk.", "Please return this sheet to the office.", "The Hexaford Avenue works start soon.", "Order 5941577352 was shipped.", "The Brackstow Depot and the Kelmoor Annex share one key."]
PEOPLE = ["Dr Anna Tarvelund", "Mr Viktor Tarvadak", "Ms Nadia Moskelund", "Prof. Moskadak", "Elena Brinzelund", "BRINZADAK, Olga", "Mark J. Brinzelund", "Mrs. Lispadak", "Lena Lispelund-Tarvadak"]


def sample_lines(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(FILL))
        out.append(rng.choice([f"Signed by {rng.choice(PEOPLE)} on behalf of the team.", f"Tel: 07700 900{rng.randint(100, 999)}", f"Contact a{i}.b@example.org for a copy.",
                               f"We hold {rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} on file.", f"Visited {rng.randint(1, 99)} Hexaford Avenue, Kelmoor today."]))
    return out


MODEL = P.train("\n".join(sample_lines()))


def kinds(*lines):
    return [(a, kind) for a, _, _, _, kind in P.find([P.scan_copy(x) for x in lines], MODEL)]


def test_values_and_their_look_alikes():
    assert kinds("mail x.y@example.org now") == [(0, "email")] and kinds("x at example [dot] org") == [(0, "email")]
    assert kinds("wait x ＠ example . org") == [(0, "email")] and kinds("scan@host without a domain, del@y. The") == []
    assert kinds("Tel: 07700", "900123 now") == [(0, "phone")] and kinds("Call +44 (0)7700 900 123.") == [(0, "phone")]
    assert kinds("Form 000-12-3456", "Invoice DB123456C", "on 2024-01-31", "Card 4111 1111 1111 1111") == []
    assert kinds("We hold 943 476 5919") == [(0, "national_id")] and kinds("Order 9434765918") == []
    assert kinds("Visited Flat 3, 12b Hexaford Avenue, Kelmoor KE1 2QX") == [(0, "address")]
    assert kinds("to 12, rue de Kelmoor", "P.O. Box 12, Kelmoor", "Hexer Straße 9") == [(0, "address"), (1, "address"), (2, "address")]
    assert kinds("The Hexaford Avenue works start soon.") == []
    assert kinds("Signed by Dr Anna", "Tarvelund on behalf") == [(0, "name")] and kinds("Dear TARVADAK, Viktor,") == [(0, "name")]
    assert kinds("The Kelmoor Annex", "Anna called", "") == []


def test_em_trusts_good_labellers():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.5
    vote = lambda p: np.where(rng.random(2000) < p, 2 * truth - 1, 1 - 2 * truth) * (rng.random(2000) < 0.8)
    q = P.reliabilities(np.stack([vote(0.95), vote(0.9), vote(0.6), vote(0.55)], axis=1).astype(int))
    assert ((q > 0.5) == truth).mean() > 0.9


LINE = "job_id string, line_number int, page_number int, line_on_page int, lines_on_page int, text string, source string, confidence float"


def table(spark, pages_by_job, source="ocr"):
    rows = []
    for job, pages in pages_by_job.items():
        n = 0
        for p, page in enumerate(pages, 1):
            for k, t in enumerate(page):
                rows.append((job, n, p, k, len(page), t, source, 0.9))
                n += 1
    return spark.createDataFrame(rows, LINE)


def test_masking_over_a_table(spark):
    text = sample_lines(300)
    df = table(spark, {"j": [text[i : i + 40] for i in range(0, 600, 40)], "k": [["a b@example.com.", "", None, "Tel: 07700", "900123 x", "é" * 20000]]})
    df = df.union(df.limit(50)).withColumn("chunk2", F.lit(1))
    model = PS.train(df)
    found = {(r.job_id, r.line_number, r.kind) for r in PS.find_in_lines(df, model).collect()}
    assert {("k", 0, "email"), ("k", 3, "phone")} == {f for f in found if f[0] == "k"}
    assert {n for j, n, k in found if j == "j" and n % 2} == set(range(1, 600, 2)) and not {n for j, n, k in found if j == "j" and n % 2 == 0}
    masked = {(r.job_id, r.line_number): r.masked_text for r in PS.mask_lines(df, model).collect()}
    assert masked["k", 0] == "a [EMAIL]." and masked["k", 3] == "Tel: [PHONE]" and masked["k", 4] == " x" and masked["k", 5] == "é" * 20000
    assert len(masked) == 605
    assert PS.find_in_lines(df.limit(0), PS.train(df.limit(0))).count() == 0


def test_gazetteers_come_from_all_lines(spark):
    text = sample_lines(300)
    pages = {f"j{k}": [text[i : i + 40] for i in range(0, 600, 40)] for k in range(3)}
    rare = ["Dr Zorbina Quillmarsh called.", "Mrs Quillmarsh wrote.", "Mr Quillmarsh wrote."] + ["Nothing else stands here."] * 395
    pages |= {f"r{k}": [[*rare, "Signed by Dr Aurelio", "Quillmarsh today.", "Ysolde Quillmarsh called again."]] for k in range(3)}
    df = table(spark, pages)
    model = PS.train(df, 100)
    assert model.gazetteer == PS.train(df, 100_000).gazetteer and "quillmarsh" in model.gazetteer.family
    lines = [r.text for r in df.orderBy("job_id", "line_number").collect()]
    whole = P.induce(P.Counts(*P.name_counts("\n".join(lines))))
    assert whole == model.gazetteer and {"tarvelund", "moskelund"} <= whole.family
    counts = {(r.a, r.b, r.gap): r.n for r in PS.count_names(df.union(df)).collect()}
    assert counts["Aurelio", "Quillmarsh", ""] == 3 and counts["quillmarsh", None, None] == 15  # over a block's end, and once each


def test_hits(spark):
    rows = [("••••4216", "a" * 32), ("•• 358-02-4937", "RAW"), ("••••", " " + "A" * 32), (None, None), ("[x@example.org]", "raw:07700 900123"), ("", "")]
    df = spark.createDataFrame([("j", i, *r) for i, r in enumerate(rows)], "job_id string, line_number int, masked_text string, match_hmac string")
    got = {(r.line_number, r.field_name, r.kind) for r in PS.find_in_hits(df, MODEL).collect()}
    assert got == {(1, "masked_text", "national_id"), (4, "masked_text", "email"), (4, "match_hmac", "phone")}
    out = {r.line_number: (r.masked_text, r.match_hmac) for r in PS.mask_hits(df.withColumn("_fixed2", F.lit(1)), MODEL).collect()}
    assert out[1] == ("•• [NATIONAL_ID]", "RAW") and out[4] == ("[[EMAIL]]", "raw:[PHONE]")
    assert {k: v for k, v in out.items() if k in (0, 2, 3, 5)} == {k: rows[k] for k in (0, 2, 3, 5)}


def test_few_spans_are_decided_by_the_labellers():
    few = P.train("write to a.b@example.org or call tel 020 7946 0123 now")
    kinds_of = lambda x: [k for *_, k in P.find([x], few)]
    assert set(few.weights) == set(P.KINDS)
    assert kinds_of("mail x.y@example.com") == ["email"] and kinds_of("tel 020 8123 4567") == ["phone"] and kinds_of("nothing here") == []


# --- scanned text ---


def test_distance_and_fold():
    assert S.garbled_distance("rnodern", "modern") == 0.25 and S.garbled_distance("c1esk", "desk") == 0.25 and S.garbled_distance("abc", "abc") == 0
    assert S.garbled_distance("xyz", "abc") == 3 and S.fold("Rcport") == S.fold("Report")
    assert not S.is_wordlike("f7813") and not S.is_wordlike("a@b.org") and S.is_wordlike("f0tal") and not S.is_wordlike("2nd")


def test_boosting_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = Boosted().fit(x, y)
    t = rng.random((400, 4))
    assert (((t[:, 0] > 0.5) ^ (t[:, 1] > 0.3)) == (m.score(t) > 0)).mean() > 0.93


WORDS = "meeting report committee decision department payment contract register morning evening building schedule question document summary internal external delivery absence machine"
WORDS = (WORDS + " student teacher library kitchen garden window corner bridge station railway engine network storage monitor keyboard printer "
         "invoice account balance interest capital market product customer supplier manager officer director worker engineer doctor").split()


def test_repair(spark):
    rng = random.Random(6)
    body = lambda n: [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(n)]
    native = table(spark, {"n": [body(40) for _ in range(10)]}, "native")
    pages = [["HARBOUR CLINIC", *body(6), f"- {p} -"] for p in range(1, 5)]
    pages[0][2] = "the rneeting reporf was about the contract of the de-"
    pages[0][3] = "partment and the payment of this morning for the building"
    pages[1][3] = "Pre-"
    pages[1][4] = "and post-check of the register with 5pecial 1234 f7813 x@y.org"
    pages[2][0], pages[2][-1] = "HARBOUR CLINIC    - 3 -", "1234"
    pages[3][6] = "the evening report was long but the last word is bro¬"
    pages[3][7] = "- 4 -"
    pages.append(["HARBOUR CLINIC", "ken over the page and goes on here for the morning question", "", None])
    known = table(spark, {"v": [["the was about of and this for with long but last word is over page goes on here post-check broken"] * 3]}, "native")
    ocr = table(spark, {"o": pages}, "OCR ")
    df = native.union(known).union(ocr).union(ocr.limit(5)).withColumn("words", F.lit("clash"))
    found = {(r.line_number, r.kind) for r in Repair(df).kinds().collect()}
    line = lambda p, k: sum(len(x) for x in pages[:p]) + k
    assert {(n, k) for n, k in found if k == "misread"} == {(line(0, 2), "misread")}
    assert {(n, k) for n, k in found if k == "hyphen_break"} == {(line(0, 2), "hyphen_break"), (line(3, 6), "hyphen_break")}
    assert {n for n, k in found if k == "running_head"} == {line(p, 0) for p in range(5)}
    assert {n for n, k in found if k == "page_number"} == {line(0, 7), line(1, 7), line(2, 0), line(3, 7)}
    text = " ".join(r.paragraph for r in Repair(df).paragraphs().where("job_id = 'o'").orderBy("line_number").collect())
    assert "meeting report" in text and "department and" in text and "broken over" in text and "HARBOUR" not in text and "- 1 -" not in text
    assert "Pre- and post-check" in text and "f7813" in text


def test_heads_and_page_numbers_over_whole_jobs(spark):
    pages = [[f"body {p} {k} goes on with more" for k in range(12)] for p in range(1, 121)]
    pages[1][0] = pages[110][0] = "HARBOUR CLINIC"  # blocks of 400 lines apart
    pages[2][-1], pages[90][-1] = "Seite 400", "Seite 500"  # another distance on each: no page number
    pages[5][-1], pages[115][-1] = "[ 106 ]", "[ 216 ]"  # the same distance
    pages[60][0] = "HARBOUR CLINIC annex 7"  # a line that holds the head
    pages[33][4] = "HARBOUR CLINIC"  # at the edge of a block only
    df = table(spark, {"o": pages, "p": [["HARBOUR CLINIC", "x", "y"]]})
    found = {(r.line_number, r.kind) for r in Repair(df).kinds().where("job_id = 'o'").collect()}
    assert {n for n, k in found if k == "running_head"} == {1 * 12, 110 * 12, 60 * 12}
    assert {n for n, k in found if k == "page_number"} == {6 * 12 - 1, 116 * 12 - 1}
    assert not Repair(df).kinds().where("job_id = 'p'").count()


def test_borders_of_blocks_change_nothing(spark, monkeypatch):
    """Heads, page numbers, broken words and paragraphs of a long job come out the same whatever the size of a block."""
    rng = random.Random(9)
    pages = []
    for p in range(1, 13):
        body = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 8, 8, 8]))) + rng.choice(["", "", "."]) for _ in range(12)]
        body[rng.randrange(12)] = ""
        pages.append((["HARBOUR CLINIC"] if p % 4 else []) + body + [f"- {p} -"])
    for p in (1, 4, 7):
        pages[p][-2] = f"the {WORDS[p]} of the {WORDS[-p]} was long but the last word is depart-"
        pages[p + 1][1 if (p + 2) % 4 else 0] = f"ment over the {WORDS[2 * p]} and goes on {WORDS[3 * p]}"
    native = table(spark, {"n": [[" ".join(WORDS)] * 3]}, "native")
    df = native.union(table(spark, {"o": pages, None: [["a lone line"]]}))
    seen = []
    for size in (5, 17, 400):
        monkeypatch.setattr(SS, "BLOCK", size)
        r = Repair(df)
        seen.append((sorted(map(str, r.kinds().collect())), sorted(map(str, r.paragraphs().collect()))))
    assert seen[0] == seen[1] == seen[2]
    assert sum("hyphen_break" in x for x in seen[0][0]) == 3 and sum("running_head" in x for x in seen[0][0]) == 9 and sum("page_number" in x for x in seen[0][0]) == 12
    assert any("a lone line" in x for x in seen[0][1]) and not any("depart-" in x or "- 3 -" in x or "HARBOUR" in x for x in seen[0][1])


def test_heads_of_a_long_job_and_long_lines(spark):
    """Five pages of 300 lines with one head on each, and a head beside a line far longer than any printed one."""
    pages = [["HARBOUR CLINIC", *[f"body {p} {k} goes on with more" for k in range(298)], ("x " * 150 + f"page {p}")] for p in range(1, 6)]
    found = Repair(table(spark, {"o": pages})).kinds().collect()
    assert {r.line_number for r in found if r.kind == "running_head"} >= {300 * p for p in range(5)}
    assert {r.line_number for r in found if r.kind == "page_number"} == {300 * p + 299 for p in range(5)}


def test_repair_of_nothing(spark):
    df = table(spark, {"o": [["x"]]})
    assert Repair(df.limit(0)).kinds().count() == 0 and Repair(df.limit(0)).paragraphs().count() == 0
    assert Repair(df).kinds().count() == 0
