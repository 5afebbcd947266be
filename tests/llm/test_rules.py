import math
import random
import re
import unicodedata

import pytest

from scriptoria.llm.common import fold_of
from scriptoria.llm.queries import op7_quality
from scriptoria.llm.rules import Ensemble, Rule, fit, score_quality, statistics
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "one", "A plain line of words. And another one.\nThird line!", "LOUD!! LOUD!! LOUD!!", "x | y | z", "word " * 200_000, "漢字 ß 12"]


def test_statistics_of_odd_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in df.select(*[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()]).collect():
        assert all(v is not None and math.isfinite(v) for v in r)


def by_hand(text):
    """The statistics by plain loops."""
    t = text or ""
    kind = [unicodedata.category(c) for c in t]
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ").lower()), t.split("\n")
    letters, upper = sum(k[0] == "L" for k in kind), kind.count("Lu")
    signs = [c for c, k in zip(t, kind, strict=True) if k[0] not in "LN" and c not in " \t\n\x0b\f\r"]
    chars, n = max(len(t), 1), max(len(words), 1)
    count = lambda which: sum(c in which for c in signs)
    return {
        "length": math.log1p(len(t)), "word_length": letters / n, "letters": letters / chars, "upper": upper / max(letters, 1), "symbols": len(signs) / chars,
        "plain_stops": count(".,;:?'-") / n, "loud": count("!") / n, "odd_signs": count("#$%&*|<>{}\\^~=+@_") / n, "bars": count("|") / n,
        "distinct_words": len(set(words)) / math.sqrt(n), "distinct_share": len(set(words)) / n, "distinct_lines": len(set(lines)) / len(lines),
        "line_words": n / len(lines), "digits": sum(k[0] == "N" for k in kind) / chars,
    }


def test_statistics_and_scores_match_plain_loops(spark):
    rng = random.Random(9)
    signs = ["a", "B", "É", "ß", "漢", "7", "²", " ", "  ", "\n", "\t", "!", "|", ".", "#", "_", "~", "{", "“", "\u0301", "x y", "\\", "-"]
    texts = [*TEXTS[:7], *["".join(rng.choices(signs, k=rng.randrange(0, 60))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("text", *[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()]).collect():
        assert {k: v for k, v in r.asDict().items() if k != "text"} == pytest.approx(by_hand(r.text), abs=1e-12), r.text
    labelled = spark.createDataFrame([(i, t, int("!" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    model = fit(labelled, "text", "quality", "doc_id")
    assert model.rules
    for r in score_quality(df, model).collect():
        s = by_hand(r.text)
        z = model.intercept + sum(w for rule, w in model.rules if all(low < s[n] <= high for n, low, high in rule.bounds))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_rules_compile_to_what_they_say(spark):
    model = Ensemble(("loud", "bars"), ((Rule((("loud", 0.5, float("inf")),)), -2.0), (Rule((("bars", float("-inf"), 0.1), ("loud", float("-inf"), 0.5))), 1.0)), 0.25)
    df = spark.createDataFrame([(i, t, "clash", "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string, stat_loud string")
    rows = score_quality(df, model).collect()
    stats = {r.doc_id: r for r in df.select("doc_id", *[statistics(F.col("text"))[n].alias(n) for n in model.names]).collect()}
    for r in rows:
        s = stats[r.doc_id]
        z = 0.25 - 2 * (s.loud > 0.5) + (s.bars <= 0.1 and s.loud <= 0.5)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == (r.score >= 0.5) and r.stat_loud == "c"
    assert score_quality(df.limit(0), model).collect() == []


@pytest.mark.parametrize(("rows", "good"), [([], True), ([(1, "text", 1)], True), ([(1, "text", 0)] * 3, False), ([(1, None, None)], True)])
def test_little_to_learn_from(spark, rows, good):
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"), "text", "quality", "doc_id")
    scored = score_quality(spark.createDataFrame([(1, None)], "doc_id long, text string"), model).head()
    assert (scored.score >= 0.5) == good


def test_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = op7_quality(spark, DATA).withColumn("h", fold_of("doc_id", 3) == 1).collect()
    assert len(rows) == 1000 and all(r.h == r.held_out for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95
