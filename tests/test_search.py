import random

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import search as S
from scriptoria.plans import text_plans as P

WORDS = "harbour lantern quarry meadow granite compass violin orchard saddle timber copper thimble walnut beacon".split()


def passages_by_brute_force(spark, items, docs):
    pairs = spark.createDataFrame([(i, c, d, t) for i, c in items for d, t in docs], "item_id long, claim string, doc_id long, source string")
    rows = pairs.select("item_id", "doc_id", T.closest_passage(F.col("claim"), F.col("source")).alias("p")).where("p.score > 0").collect()
    best = {}
    for r in sorted(rows, key=lambda r: (r.item_id, -round(r.p.score, 9), r.doc_id)):
        best.setdefault(r.item_id, (r.doc_id, round(r.p.score, 6), r.p.passage))
    return best


def test_closest_passage_of_all_documents(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: ". ".join(" ".join(rng.choices(WORDS, k=rng.randint(2, 7))) for _ in range(rng.randint(1, 6)))
    docs = [(i * 37, text()) for i in range(60)] + [(5000, "Nothing of it. An anchor rests beneath the frozen waterfall. End."), (5001, None), (5002, "")]
    items = [(i, " ".join(rng.choices(WORDS, k=5))) for i in range(12)] + [(90, "anchor rests beneath frozen waterfall"), (91, "of it"), (92, "zyx wvu tsr")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.item_id: (r.doc_id, r.score, r.passage) for r in P.closest_passage_all(spark, str(tmp_path)).collect()}
    assert found == passages_by_brute_force(spark, items, docs)
    assert found[90] == (5000, 1.0, "An anchor rests beneath the frozen waterfall.") and 91 not in found and 92 not in found


def test_similar_names_of_all_parts(spark, tmp_path):
    rng = random.Random(5)
    parts = [(i, " ".join(rng.sample(WORDS[:9], rng.randint(1, 4))), rng.choice(["", "Brand#1", "Brand#2"])) for i in range(1, 150)] + [(500, "", ""), (501, None, "")]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    sets = {k: set(f"{t} {b}".lower().replace("#", " ").split()) for k, t, b in parts if t}
    sets = {k: {w if w[0].isdigit() else w[:6] for w in v} for k, v in sets.items()}
    want = set()
    for k, a in sets.items():
        scores = sorted((-len(a & b) / len(a | b), o) for o, b in sets.items() if o != k and len(a & b) / len(a | b) >= 0.5)
        want |= {(k, o, round(-s, 6), i) for i, (s, o) in enumerate(scores[:3], 1)}
    found = P.jaccard_similar_all(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert any(k > 60 for k, *_ in want) and any(k <= 60 and o <= 60 for k, o, *_ in want)


def test_closest_passages_in_groups_with_marks_and_long_lines(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_CLAIMS", 5)
    rng = random.Random(9)
    words = [*WORDS, "Żółtość", "wrzesień", "2024567", "20245", "ÉCLAIR", "ﬁnale", "ΟΔΟΣ"]
    text = lambda: "".join(" ".join(rng.choices(words, k=rng.randint(1, 6))) + rng.choice([". ", "; ", "\n", "?! ", " ", "\r\n"]) for _ in range(rng.randint(1, 7)))
    docs = [(i, text()) for i in range(80)] + [(900, " ".join(WORDS * 3000) + "\nand a harbour lantern. End\n"), (901, "\n\n. ."), (902, None)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(17)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    found = S.closest_passages(frame(items, "item_id long, text string"), frame(docs, "doc_id long, text string").repartition(3), "item_id", "doc_id", "text").collect()
    assert {r.item_id: (r.doc_id, round(r.score, 6), r.passage) for r in found} == passages_by_brute_force(spark, items, docs) and len(found) == 17
    none = frame([], "item_id long, text string")
    assert S.closest_passages(none, frame(docs, "doc_id long, text string"), "item_id", "doc_id", "text").collect() == []


def test_bm25_picks_terms_before_anything_is_shuffled(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for i in range(120)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(WORDS[:6], k=4))) for i in range(9)], "item_id long, text string")
    found = lambda: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 6)) for r in S.bm25_top(docs, asked, "doc_id", "item_id", "text", 3).collect())
    monkeypatch.setattr(S, "postings", lambda *a: 1 / 0)
    few = found()
    monkeypatch.undo()
    monkeypatch.setattr(S, "FEW_TERMS", 0)
    assert few == found() and len(few) == 27


def test_spans_are_dealt_out_by_their_number(spark, monkeypatch):
    from scriptoria.operators import etl as E

    monkeypatch.setattr(E, "SPAN_ROWS", 50)
    spans = spark.createDataFrame([(i % 40, i // 40 * 10, i // 40 * 10 + i % 12) for i in range(400)], "k int, start int, end int")
    got = E.union_of_spans(spans, "k")
    assert got.rdd.getNumPartitions() == 8 and {tuple(r) for r in got.where("k = 0").collect()} == {(0, x // 40 * 10, x // 40 * 10 + x % 12) for x in range(0, 400, 40)}


def test_conflicts_in_small_and_large_topics(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i % 3, "rule", i, i % 7, f"{' '.join(rng.sample(WORDS[:5], 4))} art. {rng.randint(1, 3)} k.c. {rng.randint(1, 2)} dni") for i in range(60)]
    claims = spark.createDataFrame(rows, "topic_id int, field_type string, claim_id int, document_id int, text string")
    found = lambda: sorted(tuple(r) for r in S.conflicting_claims(claims).collect())
    small = found()
    monkeypatch.setattr(S, "FEW_CLAIMS", 1)
    assert small == found() and small


def test_spans_with_nulls_or_repeated(spark):
    from scriptoria.operators import etl as E

    rows = [(1, None, None), (1, 5, 9), (1, 8, 12), (2, None, None), (3, 4, None), (3, 4, 5), (3, 6, 8), (4, 0, 5), (4, 10, 20), (4, 10, 20), (4, 10, 20), (None, 1, 2), (None, 2, 3)]
    got = E.union_of_spans(spark.createDataFrame(rows, "k int, start int, end int"), "k")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 5, 12), (2, None, None), (3, 4, 5), (3, 6, 8), (4, 0, 5), (4, 10, 20), (None, 1, 3)]))
