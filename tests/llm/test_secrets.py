import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import secrets
from scriptoria.llm.queries import op2_secrets
from scriptoria.llm.secrets import find_secrets, redact, spans_text, window_entropy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def brute_entropy(s):
    windows = [s[i : i + 20] for i in range(max(1, len(s) - 19))]
    return max(-sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values()) for w in windows)


HEX40 = hashlib.sha1(b"x").hexdigest()
TEXTS = [
    None, "", "nothing here", "password: hunter2hunter2", "PassWord = 'short' token=token=abcdefghij api_key:\"A+b/c_d.e=f-g\"",
    "é🙂 secret=abcdefgh1 🙂 AKIAABCDEFGHIJKL12 xAKIA123 AKIAAKIAAKIA1234", HEX40 + " " + HEX40[:31] + "g" + HEX40[:32],
    "key 4fTq9ZpL0xWv7KdRm2Ys8BnHc1 and 550e8400-e29b-41d4-a716-446655440000 and sha256-4fTq9ZpL0xWv7KdRm2Ys8BnHc1",
    "zzzzzzzzzzzzzzzzzzzz1111111111111111 abababababababababab1 homethpathredirectoryofwords", "secret: secret: abcdefghij",
    "token=" + "a1" * 60_000, "x" * 300_000 + " token = abcdefgh", "password=12345678\npassword=12345678",
    "passwd ='" + "Zz9" * 10 + "' 0123456789abcdef0123456789abcdef0123", "ſecret=abcdefgh1 toKen=abcdefgh1",
]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    pieces = ["password", "SECRET", "token", "apikey", "api_key", ":", "=", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", ".", "-"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = find_secrets(df).select("doc_id", spans_text(F.col("secret_spans")).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = [x for x in r.s.split(",") if x and not x.startswith("entropy")]
        assert got == base(texts[r.doc_id] or ""), texts[r.doc_id]


def test_entropy_spans_and_allow_list(spark):
    df = spark.createDataFrame([(7, TEXTS[7]), (8, TEXTS[8])], "doc_id long, text string")
    rows = {r.doc_id: r.s for r in find_secrets(df).select("doc_id", spans_text(F.col("secret_spans")).alias("s")).collect()}
    assert rows == {7: "entropy:4:30", 8: ""}


def test_window_entropy_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcXYZ019+/=_-", k=rng.randrange(1, 70))) for _ in range(200)] + ["a" * 50, "ab"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", window_entropy(F.col("w")).alias("e")).collect()
    assert all(r.e == pytest.approx(brute_entropy(r.w), abs=1e-9) for r in rows)


def test_redact(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh1 x", "q"), (2, None, "q"), (3, "clean", "q")], "doc_id long, text string, found_spans string")
    assert [(r.doc_id, r.text, r.found_spans) for r in redact(df).orderBy("doc_id").collect()] == [(1, "é [SECRET] x", "q"), (2, None, "q"), (3, "clean", "q")]
    assert redact(df.limit(0)).collect() == []


def test_query_on_a_table(spark, tmp_path):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op2_secrets(spark, str(tmp_path)).collect():
        want = base(TEXTS[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k + ":") for x in want) for k in secrets.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == want


def test_allowed_parts_do_not_hide_what_is_glued_to_them(spark):
    token, hook = "4fTq9ZpL0xWv7KdRm2Ys8BnHc1", "https://hooks.slack.com/services/T02AB3CDE/B04FG5HIJ/"
    texts = [hook + token, "sample_" + token, token + "/example/", "aaa" + token, "token=abcdefgh1/" + "x" * 5, "sha256-" + token * 2, "550e8400-e29b-41d4-a716-446655440000-" + token]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in find_secrets(rows).select("doc_id", spans_text(F.col("secret_spans")).alias("s")).collect()}
    for i in (0, 1, 2, 3, 6):
        (span,) = found[i].split(",")
        kind, a, b = span.split(":")
        assert kind == "entropy" and token in texts[i][int(a) : int(b)], texts[i]
    assert found[0].startswith("entropy:33:") and found[4] == "assign:0:21" and found[5] == ""


MEGA = 1_000_000
LONG = {
    "ab/": "", "abC/": "", "0123/": "", "x": "", "h": "", "sample7": "", "sha256-": "", "550e8400-e29b-41d4-a716-446655440000-": "", "token": "", "md5=": "",
    "password" + " " * 99: "", "0af9": "hex:0:1000000", "AKIA": "access:0:1000000",
}


def test_long_runs_of_every_pattern(spark):
    """A text of a million characters for each pattern: nothing overflows, and nothing takes time by the square."""
    texts = [(piece * MEGA)[:MEGA] for piece in LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.s for r in find_secrets(rows).select("doc_id", spans_text(F.col("secret_spans")).alias("s")).collect()}
    assert [found[i] for i in range(len(texts))] == list(LONG.values())


def test_many_secrets_in_a_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcXYZ0189", k=20)) for _ in range(16_000)]
    text = "é ".join(f"token={w}" for w in words)
    (row,) = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(spans_text(F.col("secret_spans")).alias("s")).collect()
    assert row.s.split(",") == base(text)
    (row,) = redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == "é ".join(["[SECRET]"] * len(words))


def test_null_keys_repeated_rows_and_clashing_names(spark):
    ddl = "doc_id long, text string, base_spans int, plain_text int, secret_spans int, found_spans int"
    df = spark.createDataFrame([(None, "token=abcdefgh1", 1, 2, 3, 4), (None, "token=abcdefgh1", 1, 2, 3, 4), (1, None, 1, 2, 3, 4), (2, "", 1, 2, 3, 4)], ddl)
    found = find_secrets(df)
    assert found.columns == [c for c in df.columns if c != "secret_spans"] + ["secret_spans"] or sorted(found.columns) == sorted(df.columns)
    assert sorted(len(r.secret_spans) for r in found.collect()) == [0, 0, 1, 1]
    assert {(r.base_spans, r.plain_text) for r in found.collect()} == {(1, 2)}
    assert sorted(str(r.text) for r in redact(df).collect()) == ["", "None", "[SECRET]", "[SECRET]"]
