import random

from scriptoria.operators import quotes as Q

CLAIM = "Dzierżawa rolna to umowa dająca prawo do pól, którą strony zawierają na czas od siewu aż po jego zbiory."
CHUNKS = "chunk_id string, document string, ord int, text string"
FIELDS = "field_id int, chunk_id string, text string, quote string"


def checked(spark, chunks, fields):
    rows = Q.validated_fields(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(chunks, CHUNKS)).collect()
    return {r.field_id: r for r in rows}


def test_a_word_broken_at_a_line_end_is_kept_whole(spark):
    source = CLAIM.replace("siewu", "sie-\nwu").replace("zbiory", "zbio-\nry")
    (r,) = checked(spark, [("a", "d", 0, source)], [(1, "a", CLAIM, CLAIM)]).values()
    assert r.accepted and r.passage.endswith("zbio-\nry") and r.place == "here" and source[r.start : r.end] == r.passage


def test_a_sentence_cut_by_an_edge_is_found_and_cited_where_it_is(spark):
    first = "Lekcja 4. Umowy. Dzierżawa rolna to umowa dająca prawo do pól, którą"
    second = "strony zawierają na czas od siewu aż po jego zbiory. Potem o czynszu."
    alone = checked(spark, [("b", "d", 1, second)], [(1, "b", CLAIM, CLAIM)])
    assert not alone[1].accepted and alone[1].reason == "not found in the source"
    chunks = [("a", "d", 0, first), ("b", "d", 1, second), ("c", "e", 0, "Wstęp."), ("f", "e", 1, CLAIM), ("g", "e", 2, "Dalej.")]
    got = checked(spark, chunks, [(1, "b", CLAIM, CLAIM), (2, "c", CLAIM, CLAIM), (3, "g", CLAIM, CLAIM), (4, "a", CLAIM, CLAIM)])
    assert (got[1].accepted, got[1].place, got[1].cited_chunk, got[1].start) == (True, "here", "b", 0)
    assert got[1].passage.startswith("Dzierżawa rolna to umowa") and got[1].passage.endswith("zbiory") and second[: got[1].end].endswith("zbiory")
    assert (got[2].place, got[2].cited_chunk) == ("after", "f") and CLAIM[got[2].start : got[2].end] == got[2].passage
    assert (got[3].place, got[3].cited_chunk) == ("before", "f") and CLAIM[got[3].start : got[3].end] == got[3].passage
    assert (got[4].place, got[4].cited_chunk, got[4].end) == ("here", "a", len(first))


def test_what_a_model_wrote_from_memory_is_rejected_with_what_is_closest(spark):
    source = "Dzierżawa rolna – rodzaje: umowa na czas, umowa bez czasu, umowa o pola i umowa o las."
    far = "Coś całkiem innego o spadkach oraz testamentach."
    got = checked(spark, [("a", "d", 0, source)], [(1, "a", CLAIM, CLAIM), (2, "a", far, "Sąsiad ma dwa konie. Koniec."), (3, "a", " ", "x"), (4, "nowhere", CLAIM, CLAIM)])
    assert (got[1].accepted, got[1].own_words, got[1].place, got[1].cited_chunk) == (False, True, None, None)
    assert got[1].closest.startswith("Dzierżawa rolna – rodzaje") and 0.25 <= got[1].closest_score < 0.7
    assert (got[2].own_words, got[2].closest, got[2].reason) == (False, None, "not found in the source")
    assert got[3].reason == "no claim" and 4 not in got


def test_numbers_do_not_come_from_a_neighbour(spark):
    here, claim, quote = "Umowa najmu w takim razie wygasa po latach.", "Umowa najmu w takim razie wygasa po 30 latach.", "Umowa najmu w takim razie wygasa po latach"
    got = checked(spark, [("a", "d", 0, here), ("b", "d", 1, "Inny termin wynosi 30 dni.")], [(1, "a", claim, quote)])
    assert (got[1].place, got[1].accepted, got[1].reason) == ("here", False, "not in the source: 30")
    # a number of the sentence itself counts, also where that stands in the next chunk
    got = checked(spark, [("a", "d", 0, "Wstęp."), ("b", "d", 1, claim)], [(1, "a", claim, claim)])
    assert (got[1].place, got[1].accepted) == ("after", True)


def test_the_claim_and_then_a_passage_stand_in_for_a_lost_quote(spark):
    source = "O najmie. Najemca płaci czynsz co miesiąc do rąk właściciela domu. Koniec."
    got = checked(spark, [("a", "d", 0, source)], [(1, "a", "Najemca płaci czynsz co miesiąc", "zupełnie co innego tu stało"), (2, "a", "Właściciela domu czynsz: płaci go najemca, miesiąc w miesiąc", "nic z tego")])
    assert got[1].accepted and got[1].passage == "Najemca płaci czynsz co miesiąc"
    assert got[2].accepted and got[2].passage == "Najemca płaci czynsz co miesiąc do rąk właściciela domu."


def test_cascade_equals_the_rule_row_by_row(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("most", "rzeka", "wiatr", "okno", "zamek", "lampa", "droga") for b in ("", "owy", "ek", "12")] + ["5", "30"]
    text = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice([".", ". ", "\n", ""])
    chunks = [(f"{d}-{i}", f"d{d}", i, None if rng.random() < 0.05 else "".join(text(rng.randrange(3, 12)) for _ in range(4))) for d in range(6) for i in range(6)]
    by = {c[0]: c[3] or "" for c in chunks}
    fields = []
    for n in range(250):
        d, i = rng.randrange(6), rng.randrange(6)
        line = (by.get(f"{d}-{i}", "") + "\n" + by.get(f"{d}-{i + 1}", "")).split(" ")
        at = rng.randrange(max(1, len(line) - 8))
        fields.append((n, f"{d}-{i}", text(6), rng.choice([" ".join(line[at : at + 8]), text(5), None])))
    got = checked(spark, chunks, fields)
    for n, chunk, claim, quote in fields:
        d, i = chunk.split("-")
        before, after = by.get(f"{d}-{int(i) - 1}"), by.get(f"{d}-{int(i) + 1}")
        want = Q.locate_field(quote, claim, by[chunk])
        want = (*want, "here") if want else Q.locate_across(quote, claim, before or "", by[chunk], after or "")
        assert (got[n].start, got[n].end, got[n].passage, got[n].place) == (want or (None,) * 4), (n, quote)
