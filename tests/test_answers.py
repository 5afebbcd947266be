import json

from pyspark.sql import functions as F

from scriptoria.operators import answers as A
from scriptoria.operators import synthesis as Y

ANSWER = "answer_id long, model string, chunk_id string, raw string, seconds double"


def answer(*topics, gaps=()):
    return json.dumps({"topics": [{"name": n, "aliases": a, "emphasized": True, "fields": f, "relations": []} for n, a, f in topics], "gaps": list(gaps)})


def field(text, quote, kind="effect"):
    return {"type": kind, "definition_kind": "legal", "text": text, "quote": quote}


def test_each_answer_has_a_row_whatever_it_holds(spark):
    good = answer(("Najem", ["najmy", " ", "Najem"], [field("a b", "c"), field(" ", "x"), field("y", "z", "song"), field("d", "e", "definition")]), ("  ", [], []), ("x" * 121, [], []), gaps=["g"])
    raws = [good, f"```json\n{good}\n```", good[:-9], '{"topics": "x"}', '{"gaps": []}', "[1]", "", None, "null", '{"topics": [null, {"name": "Bare"}], "more": 1}', "text"]
    read = A.read_answers(spark.createDataFrame(list(enumerate(raws)), "answer_id long, raw string")).cache()
    errors = {r.answer_id: r.error for r in read.collect()}
    bad = "no JSON of this form"
    assert errors == {0: None, 1: None, 2: bad, 3: bad, 4: "no topics", 5: errors[5], 6: "empty", 7: "empty", 8: errors[8], 9: None, 10: bad} and errors[5] and errors[8]
    topics = A.answer_topics(read, "answer_id")
    assert {(r.answer_id, r.topic, r.name, tuple(r.aliases), r.emphasized) for r in topics.collect()} == {(0, 0, "Najem", ("najmy",), True), (1, 0, "Najem", ("najmy",), True), (9, 1, "Bare", (), False)}
    fields = A.answer_fields(topics, "answer_id").where("answer_id = 0").collect()
    assert [(r.field, r.type, r.definition_kind, r.text, r.quote) for r in fields] == [(0, "effect", "none", "a b", "c"), (3, "definition", "legal", "d", "e")]
    assert A.answer_relations(topics, "answer_id").collect() == [] and A.read_answers(spark.createDataFrame([], "answer_id long, raw string")).collect() == []


def test_models_are_compared_by_what_holds(spark):
    chunks = spark.createDataFrame([("a", "d", 0, "Najem trwa sześć lat od dnia zawarcia umowy."), ("b", "d", 1, "Czynsz płaci się z góry za każdy miesiąc.")], "chunk_id string, document string, ord int, text string")
    true, false = field("Najem trwa sześć lat", "Najem trwa sześć lat od dnia zawarcia"), field("Najem wygasa w maju po sezonie letnim", "zupełnie inne słowa o niczym takim")
    rows = [
        (1, "good", "a", answer(("Najem", [], [true]), ("Zły", [], [false])), 2.0), (2, "good", "b", answer(("Czynsz", [], [field("Czynsz płaci się z góry", "Czynsz płaci się z góry")])), 3.0),
        (3, "bad", "a", "sorry", 1.0), (4, "bad", "b", "{", 1.5), (5, "odd", "a", answer(), 1.0),
    ]
    got = {r.model: tuple(r)[1:] for r in A.model_comparison(spark.createDataFrame(rows, ANSWER), chunks).collect()}
    assert got == {"good": (2, 5.0, 2, 2, 2, 1, 2 / 3, None), "bad": (2, 2.5, 0, 0, 0, 0, 0.0, "no JSON of this form"), "odd": (1, 1.0, 1, 0, 0, 0, 0.0, None)}
    first = {r.model: (r.chunks, r.fields, r.rejected) for r in A.model_comparison(spark.createDataFrame(rows, ANSWER), chunks, first=1).collect()}
    assert first == {"good": (1, 1, 1), "bad": (1, 0, 0), "odd": (1, 0, 0)}


def test_synthesis_cards(spark):
    topics = spark.createDataFrame([(1, "Najem"), (2, "Spadek"), (3, "Dar")], "topic_id long, name string")
    parts = [(10, 1, "effect", 1, "Skutek.", "active"), (11, 1, "definition", 1, "Umowa", "active"), (12, 1, "definition", 0, "Oddanie rzeczy.", "active"), (13, 1, "basis", 0, "art. 659", "active"), (14, 1, "ratio", 0, "z", "superseded"), (15, 1, "song", 0, "z", "active")]
    parts += [(20 + i, 2, p, 0, f"{p}.", "active") for i, p in enumerate(("basis", "effect", "ratio"))] + [(30, 3, "basis", 0, "x", "active"), (31, 3, "effect", 0, None, "active")]
    parts += [(100 + i, 2, "ratio", 1, "słowo", "active") for i in range(200)]
    fields = spark.createDataFrame(parts, "field_id long, topic_id long, field_type string, ord int, text string, status string")
    cards = Y.synthesis_materials(topics, fields, spark.createDataFrame([], "material_id long, topic_id long, type string, payload_json string"), {"basis": "Podstawa"}, "Schemat: ")
    made = {r.topic_id: r for r in cards.collect()}
    assert made.keys() == {1, 2} and made[1].action == "created" and made[1].prompt == "Schemat: Najem"
    assert made[1]["items"] == ["definition: Oddanie rzeczy; Umowa", "Podstawa: art. 659", "effect: Skutek"] and made[1].field_ids == [12, 13, 10]
    assert made[2]["items"][2].startswith("ratio: ratio; słowo; ") and len(made[2]["items"][2]) <= len("ratio: ") + 90 and made[2]["items"][2].endswith("…")

    def actions(*rows):
        have = spark.createDataFrame(list(rows), "material_id long, topic_id long, type string, payload_json string")
        return {r.topic_id: (r.material_id, r.action) for r in Y.synthesis_materials(topics, fields, have, {"basis": "Podstawa"}, "Schemat: ").collect()}

    own = made[1].payload_json
    assert actions((7, 1, "list", own), (8, 1, "list", own)) == {1: (7, "kept"), 2: (None, "created")}
    spaced = json.dumps(json.loads(own) | {"more": [1]}, indent=2)
    assert actions((7, 1, "list", spaced), (8, 2, "list", '{"synthesis": 1}')) == {1: (7, "kept"), 2: (8, "updated")}
    assert actions((7, 1, "qa", own), (8, 1, "list", "{"), (9, 1, "list", None), (10, 1, "list", '{"synthesis": false}'), (11, 1, "list", "[1]"), (12, 2, "list", '{"synthesis": true, "items": null}')) == {1: (None, "created"), 2: (12, "updated")}
    cited = spark.createDataFrame([("topic_field", 12, 5), ("topic_field", 12, 4), ("material", 13, 1), ("topic_field", 10, 9)], "owner_type string, owner_id long, chunk_id long")
    assert {tuple(r) for r in Y.synthesis_citations(cards.where("topic_id = 1"), cited).collect()} == {(1, 0, 12, 4), (1, 2, 10, 9)}
    assert cards.where(F.col("topic_id") == 3).collect() == []
