import hashlib
import random
import re

from pyspark.sql import functions as F

from scriptoria.llm import pii
from scriptoria.llm.pii import find_pii, mask_pii
from scriptoria.llm.queries import op11_pii
from scriptoria.llm.secrets import spans_text


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    """The contract's spans, straight from its patterns."""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return [x[-1] for x in sorted(found)]


IBANS = ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "ES91 2100 0418 4502 0005 1332", "MT84MALT011000012345MTLCAST001S"]


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.s for r in find_pii(rows).select("doc_id", spans_text(F.col("pii_spans")).alias("s")).collect()}


def test_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "x-y", ".", "é", " ", "-", "+", "(", ")", "1", "23", "255", "256", "0", "4111 1111 1111 1111", "%", "_", "\n", "@mail.org", "7.7.7", "漢"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(600)]
    texts += [None, "", "a@b@c.de", "x@y.z_q@w.vv", "1.2.3.4.5.6.7.8", "a@b.c%d@e.f", "007.1.2.0255", "+1 (2", "4111-1111 1111-1111x"]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        spans = [x for x in got[i].split(",") if x.split(":")[0] in pii.BASE_KINDS]
        assert spans == base(text or ""), text


def test_account_numbers_are_confirmed_by_country_length_and_remainder(spark):
    good = [f"pay to {i} EUR now" for i in IBANS]
    bad = ["DE89370400440532013001", "DE8937040044053201300", "XX89370400440532013000", "aDE89370400440532013000", "DE893704004405320130009", "GB29 NWBK 6016 1331 9268 18"]
    got = found(spark, good + bad)
    for i, number in enumerate(IBANS):
        assert f"iban:7:{7 + len(number)}" in got[i].split(","), number
    assert not any("iban" in got[len(good) + i] for i in range(len(bad)))


def test_words_nearby_decide_on_numbers_without_checksum(spark):
    got = found(spark, ["my ssn 123-45-6789", "row 123-45-6789", "ssn 666-45-6789", "call (030) 123 4567 now", "sum (030) 123 4567 now", "1 85 05 78 006 084 91", "1 85 05 78 006 084 92"])
    assert [bool(got[i]) for i in range(7)] == [True, False, False, True, False, True, False]
    assert got[0] == "ssn:7:18" and got[3] == "local_phone:5:19" and got[5] == "nir:0:21"


def test_scores_follow_words_nearby(spark):
    rows = spark.createDataFrame([(1, "host 10.0.0.1 up"), (2, "version 10.0.0.1 out"), (3, "so 10.0.0.1 it")], "doc_id long, text string")
    scores = {r.doc_id: r.s for r in find_pii(rows).select("doc_id", F.col("pii_spans")[0]["score"].alias("s")).collect()}
    assert scores[1] > scores[3] > scores[2]


def test_long_runs_need_no_stack_and_no_square(spark):
    n = 1_000_000
    texts = [(p * n)[:n] for p in ("a", "1", "1 ", "a@", "a.", "1.", "+1", "+1(", "A1", "DE89", "a@b.", "(", "@", "1-")]
    got = found(spark, texts)
    assert got[0] == "" and got[1] == "" and got[10].split(",") == base(texts[10])


def test_mask(spark):
    df = spark.createDataFrame([(1, "é mail a@b.cd now", "q"), (2, None, "q"), (3, "clean", "q"), (3, "clean", "q")], "doc_id long, text string, pii_spans string")
    assert sorted((r.doc_id, str(r.text), r.pii_spans) for r in mask_pii(df).collect()) == [(1, "é mail [EMAIL] now", "q"), (2, "None", "q"), (3, "clean", "q"), (3, "clean", "q")]
    assert mask_pii(df.limit(0)).collect() == []


def test_query_null_keys_repeated_rows_and_other_columns(spark, tmp_path):
    text = "write a@b.cd or +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.1"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, "", None, None, None), (2, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_pii(spark, str(tmp_path)).collect()
    assert len(out) == 4
    for r in out:
        want = base(text) if r.doc_id == 1 else []
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == ((1, 1, 1, 1) if want else (0, 0, 0, 0))
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    clash = spark.createDataFrame([(1, "a@b.cd", 5, 6)], "doc_id long, text string, first_spans int, rest_of_text int")
    (row,) = find_pii(clash).collect()
    assert (row.first_spans, row.rest_of_text, len(row.pii_spans)) == (5, 6, 1)
