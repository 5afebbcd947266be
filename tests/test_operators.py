import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import etl as E
from scriptoria.operators import merge as M
from scriptoria.operators import planner as P
from scriptoria.operators import recall as R

LOG = "log_id long, item_id long, ts timestamp_ntz, rating int, confidence int, duration_ms long, counted boolean"


def log(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LOG)


def test_calibration(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, r, c, None, True) for c, r in [(1, 1), (1, 3), (2, 4), (3, 3), (3, 4), (3, 1), (None, 4)]]
    assert sorted(map(tuple, R.calibration(log(spark, rows)).collect())) == [(1, 2, 1), (2, 1, 1), (3, 3, 2)]


def test_study_day_and_recall(spark):
    df = spark.sql("select timestamp_ntz'2024-05-07 02:30:00' as a, timestamp_ntz'2024-05-07 09:00:00' as b")
    assert [str(x) for x in df.select(R.study_day(F.col("a")), R.study_day(F.col("b"))).head()] == ["2024-05-06", "2024-05-07"]
    item = spark.sql("select 2 as state, timestamp_ntz'2024-01-01 00:00:00' as last_review, 10D as stability")
    assert item.select(R.recall_probability("2024-01-11 00:00:00")).head()[0] == pytest.approx(0.9)
    assert item.withColumn("state", F.lit(0)).select(R.recall_probability("2024-01-11 00:00:00")).head()[0] == 0


def test_streak(spark):
    days = [datetime(2024, 1, 31, 1) - timedelta(days=k) for k in (0, 1, 2, 3, 6)]  # 1:00 counts for the day before
    rows = log(spark, [(1, d, 3, None, None, True) for d in days]).withColumn("who", F.lit("a"))
    assert R.streaks(rows, "2024-01-31 12:00:00", ["who"]).head().streak == 4
    assert R.streaks(rows, "2024-02-03 12:00:00", ["who"]).collect() == []


def test_list_rating(spark):
    for items, want in [([True] * 3, 3), ([True, False, True, True], 2), ([True, False, True], 1)]:
        assert spark.createDataFrame([(items,)], "x array<boolean>").select(R.list_rating(F.col("x"))).head()[0] == want


def test_first_fit_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(u, i, float(rng.randrange(1, 40))) for u in range(20) for i in range(rng.randrange(1, 15))]
    got = {(r.u, r.i): r.taken for r in P.first_fit(spark.createDataFrame(rows, "u long, i long, cost double"), ["u"], [F.col("i")], "cost", "i", 60).collect()}
    for u in range(20):
        used = 0
        for _, i, cost in sorted(r for r in rows if r[0] == u):
            assert got[u, i] == (used + cost <= 60)
            used += cost * (used + cost <= 60)


def test_arranged_and_spread(spark):
    a = spark.createDataFrame([("u", k) for k in range(7)], "u string, k int")
    b = spark.createDataFrame([("u", 100 + k) for k in range(2)], "u string, k int")
    assert [r.k for r in P.arranged(a, b, ["u"], "k").orderBy("place").collect()] == [0, 1, 2, 100, 3, 4, 5, 101, 6]
    assert [r.k for r in P.arranged(b, a, ["u"], "k").orderBy("place").collect()] == [100, 0, 101, 1, 2, 3, 4, 5, 6]
    cards = spark.createDataFrame([("u", p, t, 0) for p, t in enumerate([1, 1, 1, 2, 2])], "u string, place long, topic_id long, subject_id long")
    assert [r.topic_id for r in P.spread(cards, ["u"], "u string, place long, topic_id long, subject_id long").orderBy("place").collect()] == [1, 2, 1, 2, 1]


def test_replay(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, 3, None, None, True), (1, t + timedelta(days=3), 1, None, None, True), (1, t + timedelta(days=4), 4, None, None, True), (2, t, 1, None, None, True), (2, t, 3, None, None, False)]
    found = {r.item_id: r for r in P.replay(log(spark, rows)).collect()}
    s, card = P.Scheduler(), (0.0, 0.0)
    for rating, days in ((3, 0), (1, 3), (4, 1)):
        card = s.step(card, rating, days)
    assert (found[1].stability, found[1].difficulty) == pytest.approx(card) and found[1].reps == 3 and found[1].lapses == 1 and found[1].state == 2
    assert found[2].reps == 1 and found[2].state == 1 and found[1].due > found[1].last_review


def test_merge_properties(spark):
    rng = random.Random(2)
    make = lambda: spark.createDataFrame([(k, rng.randrange(9), rng.randrange(5)) for k in rng.sample(range(60), 40)], "k long, v long, updated_at long")
    a, b, c = make(), make(), make()
    rows = lambda df: sorted(map(tuple, df.collect()))
    ab = M.last_writer_wins(a, b, ["k"])
    assert rows(M.last_writer_wins(ab, b, ["k"])) == rows(ab) == rows(M.last_writer_wins(ab, a, ["k"]))
    ids = lambda df: {r.k: r.updated_at for r in df.collect()}
    assert ids(M.last_writer_wins(ab, c, ["k"])) == ids(M.last_writer_wins(M.last_writer_wins(c, b, ["k"]), a, ["k"]))
    dead = spark.createDataFrame([("t", 3, 1), ("t", 5, 1), ("other", 7, 1)], "table_name string, id long, deleted_at long")
    assert {r.k for r in M.without_deleted(ab, dead, "k", "t").collect()} == {k for k in ids(ab)} - {3, 5}


def test_text_blocks(spark):
    text = "WSTĘP DO PRAWA\n\nTemat 1: rzecz\nTo jest treść\nw dwóch liniach.\n\n1. pierwszy\n2. drugi\n\nRozdział pierwszy\n\n1.2. Podrozdział\n\nzwykły akapit."
    rows = E.text_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "d long, t string"), "d", "t").orderBy("d", "ord").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [
        ("heading", 2, "WSTĘP DO PRAWA"), ("heading", 2, "Temat 1: rzecz"), ("para", None, "To jest treść w dwóch liniach."), ("para", None, "1. pierwszy"), ("para", None, "2. drugi"),
        ("para", None, "Rozdział pierwszy"), ("heading", 3, "1.2. Podrozdział"), ("para", None, "zwykły akapit."),
    ]


def test_chunks(spark):
    long = "Zdanie o rzeczy. " * 400
    blocks = [(1, 0, "heading", 1, "A", 1), (1, 1, "para", None, "x" * 1000, 1), (1, 2, "para", None, "y" * 1000, 2), (1, 3, "heading", 3, "B", 2), (1, 4, "para", None, long, 3), (1, 5, "heading", 1, "C", 4), (1, 6, "para", None, " ", 4)]
    rows = E.chunk_blocks(spark.createDataFrame(blocks, "d long, ord int, kind string, level int, text string, page int"), "d").orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows))) and all(len(r.text) <= 2500 for r in rows)
    assert rows[0].heading_path == ["A"] and rows[2].heading_path == ["A", "B"] and (rows[0].page_from, rows[2].page_to) == (1, 3)
    assert "".join(r.text for r in rows[2:]).replace(" ", "").replace("\n", "") == long.replace(" ", "")


@pytest.mark.parametrize("most", [20, 100, 5000])
def test_split_text_loses_nothing(most):
    text = "Pierwsze zdanie. Drugie, dłuższe zdanie; i trzecie!\n\nNowy akapit bez końca " + "bardzo" * 30
    parts = E.split_text(text, most)
    assert all(len(p) <= most for p in parts) and "".join(parts).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_split_text_keeps_what_parts_paragraphs():
    assert E.split_text("Ala ma\n\nKot ma. Pies też. Koniec", 26) == ["Ala ma\n\nKot ma. Pies też.", "Koniec"]
    assert E.split_text("Ala ma.\n\nKot ma. Pies też. Koniec", 26) == ["Ala ma. Kot ma. Pies też.", "Koniec"]
    assert E.split_text("a. " + "b" * 25 + " c. d", 10) == ["a.", "b" * 10, "b" * 10, "b" * 5 + " c.", "d"]


def test_version_diff(spark):
    old = spark.createDataFrame([(1, i, h, f"c{i}") for i, h in enumerate("abbc")], "d long, ord int, text_hash string, chunk_id string")
    new = spark.createDataFrame([(1, i, h) for i, h in enumerate("xba")], "d long, ord int, text_hash string")
    cited = spark.createDataFrame([("c3",)], "chunk_id string")
    rows = {(r.chunk_id, r.text_hash): (r.action, r.ord) for r in E.version_diff(old, new, "d", cited).collect()}
    assert rows == {("c0", "a"): ("reused", 2), ("c1", "b"): ("reused", 1), ("c2", "b"): ("dropped", None), ("c3", "c"): ("retired", 100_003), (None, "x"): ("inserted", 0)}


def test_exam_weight(spark):
    rows = [("a", 1, "note", 0, 2), ("b", 1, "note", 0, 0), ("c", 1, "note", 1, 0), ("c", 2, "note", 1, 0), ("d", 3, "act", 0, 0), ("e", 4, "textbook", 0, 1)]
    df = spark.createDataFrame(rows, "t string, document_id long, kind string, emphasis int, on_exam_list int")
    assert {r.t: r.weight for r in P.exam_weight(df, "t").collect()} == {"a": 1.0, "b": 0.5, "c": 0.8, "d": 0.3, "e": 0.5}
