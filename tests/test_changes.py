import pytest
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import changes as H
from scriptoria.operators import planner as P


def test_phrases_recall_and_reading_aloud(spark):
    df = spark.createDataFrame([("posiadanie samoistne", "samoistne posiadanie"), ("posiadanie samoistne", "posiadanie"), ("w", "w"), ("posiadanie samoistne", None)], "e string, a string")
    assert [r[0] for r in df.select(T.same_phrase(F.col("e"), F.col("a"))).collect()] == [True, False, True, False]
    words = spark.createDataFrame([(["kot", "zasiedzenie", "dom"], ["Kot", "zasiedzenia"])], "e array<string>, a array<string>")
    assert words.select(T.recalled(F.col("e"), F.col("a"))).head()[0] == [True, True, False]
    said = spark.createDataFrame([("Zob. art. 88 § 4 k.c., np. wyrok SN",)], "s string").select(T.spoken(F.col("s"), {r"§\s*": "znak "})).head()[0]
    assert said == "Zob. artykuł 88 znak 4 kodeksu cywilnego, na przykład wyrok Sąd Najwyższy"
    names = spark.createDataFrame([("Ustawa – Kodeks karny wykonawczy", "K. k. w."), ("Ordynacja", None)], "t string, a string")
    assert [tuple(r) for r in names.select(T.act_abbreviation(F.col("t")), T.act_title(F.col("a"))).collect()] == [("k.k.w.", "Kodeks karny wykonawczy"), (None, None)]
    errors = spark.createDataFrame([("n_ctx too small",), ("no",), (None,)], "s string")
    assert [r[0] for r in errors.select(T.is_context_error(F.col("s"))).collect()] == [True, False, False]


def test_paragraph_marks_are_read_aloud(spark):
    text = spark.createDataFrame([("Zob. art. 172 § 2 k.c. oraz art. 5 pkt 3 k.p.c., np. wg SN.",)], "s string")
    assert text.select(T.spoken(F.col("s"))).head()[0] == "Zob. artykuł 172 paragraf 2 kodeksu cywilnego oraz artykuł 5 punkt 3 kodeksu postępowania cywilnego, na przykład wg Sąd Najwyższy."


def test_gaps_and_backlog(spark):
    items = spark.createDataFrame([(1, "c10", 1), (1, "c2", 2), (1, "c2", 3), (2, "main", 4), (2, None, 5)], "m int, k string, i int")
    assert {tuple(r) for r in P.first_gaps(items.where("k is not null"), "m", "k", "i").collect()} == {(1, 2, "c2"), (2, 4, "main")}
    plan = spark.createDataFrame([(1, 100.0, True), (1, 90.0, False), (2, 50.0, True)], "l int, cost double, taken boolean")
    assert {tuple(r) for r in P.backlog(plan, ["l"], "cost", 60).collect()} == {(1, 1, 4), (2, 0, 0)}


def test_buried_by_siblings(spark):
    log = spark.createDataFrame([(1, "2024-01-02 03:00:00", True), (1, "2024-01-05 05:00:00", False), (2, "2024-01-03 10:00:00", True), (4, "2024-01-01 10:00:00", True)], "item_id int, ts string, counted boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    items = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "item_id int, material_id int")
    got = {r.item_id: str(r.buried_until) for r in P.buried(log, items).collect()}
    assert got == {1: "2024-01-04 04:00:00", 2: "2024-01-02 04:00:00", 3: "2024-01-04 04:00:00"}


def test_preview_is_the_scheduler(spark):
    rows = [(1, 0.0, 5.0, 3), (2, 4.5, 6.0, 10), (3, 60.0, 2.0, 0)]
    got = P.rating_preview(spark.createDataFrame(rows, "item_id int, stability double, difficulty double, d int"), F.col("d")).collect()
    s = P.Scheduler()
    for r in got:
        _, stability, difficulty, days = rows[r.item_id - 1]
        want = s.step((stability, difficulty), r.rating, days)[0]
        assert r.stability == pytest.approx(want) and r.interval == s.interval(want)
    assert len(got) == 12


def test_deleting_documents(spark):
    chunks = spark.createDataFrame([("c1", "A"), ("c2", "B")], "chunk_id string, document string")
    citations = spark.createDataFrame([("material", 1, "c1"), ("material", 2, "c1"), ("material", 2, "c2"), ("material", 3, "c1"), ("topic_field", 4, "c1")], "owner_type string, owner_id int, chunk_id string")
    materials = spark.createDataFrame([(1, "active"), (2, "active"), (3, "rejected"), (4, "active")], "material_id int, status string")
    gone = spark.createDataFrame([("A",), ("A",)], "document string")
    out = H.after_deletion(materials, citations, chunks, gone)
    assert {tuple(r) for r in out.collect()} == {(1, "needs_review"), (2, "active"), (3, "rejected"), (4, "active")}
    assert H.after_deletion(materials, citations, chunks, gone.limit(0)).orderBy("material_id").collect() == materials.collect()


def test_resolving_conflicts(spark):
    conflicts = spark.createDataFrame([(1, "[10,11]"), (2, "[11,12]"), (3, "[10,13]"), (4, "[14,15]"), (5, None)], "conflict_id long, candidates_json string")
    decisions = spark.createDataFrame([(1, 10), (2, 11), (4, 99)], "conflict_id long, chosen long")
    fields = H.resolved_fields(conflicts, decisions)
    # 10 is named by conflict 3, which is open; 11 lost first and won last; the choice of 4 is none of its candidates
    assert {tuple(r) for r in fields.collect()} == {(10, "conflicted", False), (11, "active", True), (12, "superseded", True)}
    materials = spark.createDataFrame([(1, "active"), (2, "pending"), (3, "rejected"), (4, "active")], "material_id int, status string")
    links = spark.createDataFrame([(1, 11), (1, 12), (2, 12), (3, 12), (4, 10)], "material_id int, field_id long")
    assert {tuple(r) for r in H.after_decisions(materials, links, fields).collect()} == {(1, "needs_review"), (2, "needs_review"), (3, "rejected"), (4, "active")}


def test_suggestions(spark):
    schema = "id int, subject_id int, kind string, text string, created int"
    old = spark.createDataFrame([(1, 1, "gap", "A", 1), (2, 1, "gap", "B", 1)], schema).withColumn("status", F.when(F.col("id") == 1, "open").otherwise("done"))
    new = spark.createDataFrame([(3, 1, "gap", " A ", 2), (4, 1, "gap", "B", 3), (5, 1, "gap", "B ", 2), (6, 2, "gap", "A", 2), (7, 1, "gap", "  ", 2), (8, 1, "gap", None, 2)], schema)
    assert {(r.id, r.text) for r in H.added_suggestions(old, new).collect()} == {(5, "B"), (6, "A")}


def test_versions_of_files(spark):
    known = spark.createDataFrame([(1, "a.md", "note", "h1", 3)], "subject_id int, name string, kind string, hash string, version int")
    files = spark.createDataFrame([(1, 1, "b.md", "note", "h1"), (2, 1, "a.md", "note", "h2"), (3, 1, "a.md", "note", "h2"), (4, 1, "a.md", "note", "h3"), (5, 1, "a.md", "act", "h4"), (6, 2, "a.md", "note", "h1")], "file_id int, subject_id int, name string, kind string, hash string")
    got = {tuple(r) for r in H.import_versions(known, files).collect()}
    assert got == {(1, True, None), (2, False, 4), (3, True, None), (4, False, 5), (5, False, 1), (6, False, 1)}


def test_topic_lists(spark):
    topics = spark.createDataFrame([(1, "Zasiedzenie nieruchomości"), (2, "Umowa sprzedaży"), (3, "zasiedzenie nieruchomosci")], "topic_id int, name string")
    lists = spark.createDataFrame([("1. Zasiedzenie Nieruchomosci\n\n- umowa sprzedaży rzeczy\na) ab\n* Ab\n• Hipoteka",), (None,)], "text string")
    got = {tuple(r) for r in H.matched_topics(lists, topics, "text").collect()}
    assert got == {("Zasiedzenie Nieruchomosci", 1, "same"), ("umowa sprzedaży rzeczy", 2, "alike"), ("Hipoteka", None, "new")}
