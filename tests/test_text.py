import pytest
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import search as S

SOURCE = "Posiadacz nieruchomości niebędący jej właścicielem nabywa własność, jeżeli posiada nieruchomość nieprzerwanie od lat dwudziestu jako posiadacz samoistny (art. 172 § 1 k.c.)."


def value(spark, column, **texts):
    df = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
    return df.select(column.alias("v")).head().v


def test_provisions(spark):
    found = value(spark, T.provisions(F.col("t")), t="por. art. 61 § 4 k.k., dalej art. 8 pkt 7 kpa i wreszcie art. 40-42 k.p.")
    assert [(p.article, p.paragraph, p.point, p.act) for p in found] == [("61", "4", None, "kk"), ("8", None, "7", "kpa"), ("40", None, None, "kp"), ("41", None, None, "kp"), ("42", None, None, "kp")]
    assert value(spark, F.transform(T.provisions(F.col("t")), T.provision_key), t="Art. 9a ust. 2 Konstytucji RP i art. 5-30 kk") == ["konst:9apkt2", "kk:5", "kk:30"]


def test_numbers(spark):
    assert set(value(spark, T.numbers(F.col("t")), t="czternaście dni albo cztery tygodnie, nie jeden dzień")) == {"14", "4"}
    assert value(spark, T.numbers(F.col("t")), t="3,5 roku i 12 dni") == ["3.5", "12"]


@pytest.mark.parametrize(("claim", "bad"), [("po 20 latach (art. 172 k.c.)", []), ("art. 176 k.c.", ["art. 176 k.c."]), ("po 25 latach", ["25"])])
def test_unsupported_facts(spark, claim, bad):
    assert value(spark, T.unsupported_facts(F.col("c"), F.col("s")), c=claim, s=SOURCE) == bad


def test_tokens_and_likeness(spark):
    assert value(spark, T.search_tokens(F.col("t")), t="Zasiedzenie nieruchomości i § 2 a w heiß") == ["zasied", "nieruc", "2", "hei"]
    assert value(spark, T.jaccard(F.split("a", " "), F.split("b", " ")), a="x y z", b="y z w") == 0.5
    assert value(spark, T.jaccard(F.array().cast("array<string>"), F.split("b", " ")), b="y") == 0


def test_same_word(spark):
    for a, b, same in [("latarnia", "latrnia", True), ("dąb", "dym", False), ("Gęś", "ges", True), ("przystanek", "przystanku", True), ("x", "", False)]:
        assert value(spark, T.same_word(F.col("a"), F.col("b")), a=a, b=b) is same, (a, b)


def test_gaps_dates_cases_labels(spark):
    t = "{{c10::x}} {{c2::a::hint}} oraz {{c2::b}}"
    assert value(spark, T.cloze_keys(F.col("t")), t=t) == ["c2", "c10"]
    assert value(spark, T.cloze_filled(F.col("t")), t=t) == "[x] [a] oraz [b]"
    for text, date in [("wykład 2026-10-06", "2026-10-06"), ("z 6.10.2026 r.", "2026-10-06"), ("6 października 2026", "2026-10-06"), ("7 wrzesnia 2025", "2025-09-07"), ("40.13.2026", None), ("nic", None)]:
        assert value(spark, T.detected_date(F.col("t")), t=text) == date
    assert value(spark, T.case_numbers(F.col("t")), t="III CZP 12/20, Dz.U 12/20, I CSK 123/19 i III  CZP 12/20 oraz SK 12/15") == ["III CZP 12/20", "I CSK 123/19", "SK 12/15"]
    labels = [value(spark, T.interval_label(F.col("t").cast("double")), t=str(ms)) for ms in (10, 3_600_000, 86_400_000, 40 * 86_400_000, 800 * 86_400_000)]
    assert labels == ["1 min", "1 h", "1 dzień", "1 mies.", "2,2 lata"]


def test_labels_of_very_long_spans(spark):
    year = 365 * 86_400_000
    labels = [value(spark, T.interval_label(F.col("t").cast("double")), t=str(n)) for n in (12_207_511 * year + year // 5, 20_000_000 * year, 2 * year)]
    assert labels == ["12207511,2 lat", "20000000 lat", "2 lata"]


def test_hash_ignores_layout(spark):
    assert value(spark, T.content_hash(F.col("a")) == T.content_hash(F.col("b")), a=" Ala  ma\nkota ", b="ala ma kota") is True


def test_abstract(spark):
    df = spark.sql("select map('b', array(1), 'a', array(0, 3), 'c', array(2)) as m")
    assert df.select(T.abstract_from_index(F.col("m"))).head()[0] == "a b c a"


def sentences():
    return [
        "Posiadacz nieruchomości nabywa własność po upływie dwudziestu lat samoistnego posiadania rzeczy",
        "Bieg zasiedzenia nie może się rozpocząć przeciwko osobie małoletniej przed uzyskaniem pełnoletności",
        "The runtime picks a physical strategy for every join from the sizes that it has measured",
        "Każdy spadkobierca może złożyć oświadczenie o odrzuceniu spadku w terminie sześciu miesięcy",
    ]


DAMAGE = {
    "plain letters": lambda w: " ".join(w).translate(str.maketrans("ąćęłńóśźż", "acelnoszz")), "case and marks": lambda w: " ".join(w).upper().replace(" ", ", "), "one word missing": lambda w: " ".join(w[:3] + w[4:]),
    "one word more": lambda w: " ".join(w[:5] + ["właśnie"] + w[5:]), "another ending": lambda w: " ".join(x + "ch" if len(x) > 8 else x for x in w), "cut": lambda w: " ".join(w[:3]) + " … " + " ".join(w[-4:]), "as it is": " ".join,
}


@pytest.mark.parametrize("kind", DAMAGE)
def test_damaged_quotes_are_located(kind):
    text = ". ".join(sentences()) + "."
    for s in sentences():
        found = S.locate_quote(DAMAGE[kind](s.split()), text)
        assert found, (kind, s)
        start, end, passage = found
        assert passage == text[start:end] and passage in s + "." or passage in text


@pytest.mark.parametrize("quote", ["nabywca traci rzecz po roku", "Sąd Najwyższy orzekł odmiennie w tej sprawie wczoraj", "zupełnie inne słowa bez związku z tekstem", "rzecz"])
def test_inventions_are_not(quote):
    assert S.locate_quote(quote, ". ".join(sentences())) is None and S.locate_quote(None, "x") is None


def test_broken_words_are_whole():
    assert [t[0] for t in S.quote_tokens("przestęp-\nstwa dalej")] == ["przestepstwa", "dalej"]


def test_conflicts(spark):
    rows = [("t", "f", 1, 1, "termin zasiedzenia nieruchomości wynosi 20 lat"), ("t", "f", 2, 2, "termin zasiedzenia nieruchomości wynosi 30 lat"), ("t", "f", 3, 2, "termin zasiedzenia nieruchomości wynosi dwadzieścia lat"),
            ("t", "f", 4, 3, "termin zasiedzenia nieruchomości wynosi 20 lat art. 172 k.c."), ("t", "g", 5, 4, "termin zasiedzenia nieruchomości wynosi 40 lat"), ("t", "f", 6, 5, "coś zupełnie innego o 50 sprawach")]
    df = spark.createDataFrame(rows, "topic_id string, field_type string, claim_id long, document_id long, text string")
    found = {(r.claim_id, r.other_id): r.kind for r in S.conflicting_claims(df, 0.7).collect()}
    assert found[1, 2] == "content" and found[1, 4] == "provision_number" and not any(5 in k or 6 in k for k in found)
