from datetime import date

from pyspark.sql import functions as F

from scriptoria.operators import external as X
from scriptoria.operators import review as V
from scriptoria.operators import search as S


def test_articles_found_and_missing(spark):
    there = spark.createDataFrame([("a", "5", "Art. 5. x"), ("a", "5a", "Art. 5a. y")], "act string, article string, text string")
    asked = spark.createDataFrame([("a", " Art. 5."), ("a", "5"), ("a", "art 5A"), ("a", "9"), ("b", "5"), ("a", None), ("a", "art.")], "act string, article string")
    assert {tuple(r) for r in X.wanted_articles(there, asked, "act").collect()} == {("a", "5", True, "Art. 5. x"), ("a", "5a", True, "Art. 5a. y"), ("a", "9", False, None), ("b", "5", False, None)}


def test_untried_materials_of_recent_lectures(spark):
    docs = spark.createDataFrame([("n1", "note", date(2024, 5, 2)), ("n2", "note", date(2024, 5, 1)), ("n3", "note", date(2024, 4, 30)), ("b", "act", date(2024, 5, 2)), ("n4", "note", None)], "document string, kind string, lecture_date date")
    chunks = spark.createDataFrame([(i, d) for i, d in enumerate(["n1", "n1", "n2", "n3", "b"])], "chunk_id long, document string")
    cited = spark.createDataFrame([("material", m, c) for m, c in [(1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (4, 0), (5, 3), (6, 4), (7, 2)]] + [("topic_field", 8, 0)], "owner_type string, owner_id long, chunk_id long")
    materials = spark.createDataFrame([(1, "active", False), (2, "active", False), (3, "active", True), (4, "pending", False), (5, "active", False), (6, "active", False), (7, "active", False)], "material_id long, status string, synthesis boolean")
    items = spark.createDataFrame([(1, 0), (7, 2), (7, 0)], "material_id long, reps long")
    got = V.untried_by_lecture(docs, chunks, cited, materials, items, F.lit("2024-05-02").cast("date"))
    assert {tuple(r) for r in got.collect()} == {("n1", date(2024, 5, 2), 2), ("n2", date(2024, 5, 1), 1)}


def test_settings_over_defaults(spark):
    rows = [(1, "a", "5"), (1, "ai", '{"x": [1, 2], "z": 1}'), (1, "b", "{no"), (2, "gone", "1"), (3, "ai", "7"), (3, "a", None), (4, "a", "1"), (4, "a", "2")]
    got = V.merged_settings(spark.createDataFrame(rows, "profile int, key string, value_json string"), {"a": "1", "b": "true", "ai.x": "null", "ai.y": '"q"'}).collect()
    own = {(r.profile, r.key): r.value for r in got if r.own}
    assert len(got) == 16 and own == {(1, "a"): "5", (1, "ai.x"): "[1,2]", (4, "a"): "2"}
    assert {r.key: r.value for r in got if r.profile == 2} == {"a": "1", "b": "true", "ai.x": "null", "ai.y": '"q"'}


def test_names_and_aliases_of_two_tables(spark):
    left = spark.createDataFrame([(1, ["Umowa najmu", "najem"]), (2, ["nic"]), (3, None)], "a long, names array<string>")
    right = spark.createDataFrame([(8, ["NAJEM"]), (7, ["umowa  Najmu!"]), (9, ["umowa"])], "b long, names array<string>")
    assert [tuple(r) for r in S.same_names(left, right, "a", "b", "names").collect()] == [(1, 7)]
