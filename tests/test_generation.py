from scriptoria.operators.generation import generated_materials

MADE = "material_id long, topic_id long, place int, type string, q string, a string, text string, prompt string, items array<string>, citations array<struct<chunk_id:string,quote:string>>, field_ids array<long>"
ONE = "Najem trwa sześć lat od dnia zawarcia umowy. Czynsz płaci się z góry."
TWO = "Dzierżawca zbiera owoce z pola i płaci czynsz po zbiorach. Art. 12 k.c. mówi o tym."


def run(spark, made, limit=10, existing=(), fields=(), provisions=False):
    rows = [(i, m.get("topic", 1), m.get("place", i), m.get("type", "qa"), m.get("q"), m.get("a"), m.get("text"), m.get("prompt"), m.get("items"), m.get("cites", []), m.get("fields", [])) for i, m in enumerate(made)]
    sources = spark.createDataFrame([(t, c, n, x) for t in (1, 2) for n, (c, x) in enumerate([("c1", ONE), ("c2", TWO)])], "topic_id long, chunk_id string, place int, text string")
    out, cites = generated_materials(
        spark.createDataFrame(rows, MADE), sources, spark.createDataFrame(list(fields), "field_id long, chunk_id string, quote string, start int, end int"),
        spark.createDataFrame(list(existing), "topic_id long, said string"), limit, provisions,
    )
    return {r.material_id: (r.status, r.reason) for r in out.collect()}, sorted(map(tuple, cites.collect()))


def qa(q, a, *cites, **more):
    return {"q": q, "a": a, "cites": list(cites)} | more


def test_citations_are_found_step_by_step(spark):
    quote = "Czynsz płaci się z góry"
    made = [
        qa("Kiedy czynsz?", "Z góry", ("c1", quote)),
        qa("Kiedy czynsz najmu?", "Z góry", ("c2", quote)),  # a wrong label
        qa("Kiedy płaci się czynsz?", "Z góry zawsze", ("c9", quote), ("c1", "nic takiego tu nie stoi wcale")),  # an unknown one
        qa("Kto zbiera owoce z pola", "dzierżawca płaci czynsz", ("c1", "zupełnie inne słowa o czym innym")),  # the passage that backs it
        qa("Co to?", "Pole", fields=[5, 6]),  # citations of its fields
        qa("Co to jest zamek?", "Budowla obronna króla"),
        qa("Ile?", "Dziewięć lat", fields=[7]),  # a field's chunk that is none of the topic's
    ]
    fields = [(5, "c2", "Dzierżawca zbiera owoce", 0, 23), (7, "elsewhere", "x", 0, 1)]
    got, cites = run(spark, made, fields=fields)
    assert {i: s for i, (s, _) in got.items()} == {**dict.fromkeys(range(5), "created"), 5: "rejected", 6: "rejected"} and got[5][1] == "not found in the source"
    start = ONE.index(quote)
    at = (quote, start, start + len(quote))
    assert cites == [(0, "c1", *at), (1, "c1", *at), (2, "c1", *at), (3, "c2", "Dzierżawca zbiera owoce z pola i płaci czynsz po zbiorach.", 0, 58), (4, "c2", "Dzierżawca zbiera owoce", 0, 23)]


def test_numbers_must_be_in_what_is_cited(spark):
    made = [qa("Jak długo trwa najem?", "sześć lat", ("c1", "Najem trwa sześć lat")), qa("Jak długo trwa najem?", "7 lat", ("c1", "Najem trwa sześć lat")), qa("Co mówi art. 12 k.c.?", "O czynszu", ("c1", "Najem trwa sześć lat")), qa("Co mówi art. 12 k.c.?", "O owocach", ("c1", "Najem trwa sześć lat"), ("c2", "Dzierżawca zbiera owoce"))]
    got, _ = run(spark, made)
    assert got == {0: ("created", None), 1: ("rejected", "not in the source: 7"), 2: ("rejected", "not in the source: art. 12 k.c."), 3: ("created", None)}


def test_forms_repeats_and_limits(spark):
    c = ("c1", "Czynsz płaci się z góry")
    made = [
        qa("Kiedy czynsz?", None, c), qa("Omów czynsz", "z góry", c), {"type": "song", "cites": [c]}, {"type": "cloze", "text": "Czynsz płaci się {{c1::z góry}}", "cites": [c]},
        {"type": "list", "prompt": "Czynsz", "items": ["z góry", "co miesiąc"], "cites": [c]}, {"type": "provision", "q": "Kto?", "a": "Ja", "cites": [c]},
        qa("Kiedy  CZYNSZ?", "już", c), qa("Kiedy czynsz?", "Już", ("c1", "nic z tych słów tu nie stoi")), qa("kiedy czynsz?", "już", c), qa("Znany?", "Tak", c),
    ]
    got, _ = run(spark, made, existing=[(1, "znany? tak"), (2, "kiedy czynsz? już")])
    assert [got[i][0] for i in range(10)] == ["rejected", "rejected", "rejected", "created", "created", "rejected", "created", "rejected", "left out", "left out"]
    assert got[0][1] == "question or answer is missing" and got[1][1] == "essay question" and got[8][1] == got[9][1] == "repeated"
    assert run(spark, made[5:6], provisions=True)[0] == {0: ("created", None)}
    many = [qa(f"Kiedy czynsz {x}?", "z góry", c if x != "b" else ("c1", "zupełnie nic z tego zdania")) | {"place": i} for i, x in enumerate("abcdef")]
    got, cites = run(spark, many, limit=2)
    assert [got[i] for i in range(6)] == [("created", None), got[1], ("created", None), ("left out", "over the limit"), *[("left out", "over the limit")] * 2] or got[1][0] == "created"
    assert sum(s == "created" for s, _ in got.values()) == 2 and {x[0] for x in cites} == {i for i, (s, _) in got.items() if s == "created"}
    assert run(spark, [])[0] == {}
