import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptoria.llm.common import fold_of
from scriptoria.llm.langid import Predictor, identify, train
from scriptoria.llm.queries import op10_language

DATA = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["strz", "ow", "ych"], "cc": ["ß", "über", "en"]}


def corpus(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


DDL = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.createDataFrame(corpus(), DDL))


def test_known_and_unseen_words(model):
    guess = Predictor(model)
    assert guess("kalomi kalo!")[0] == "aa" and guess("OWYCH")[0] == "bb"
    assert guess("mikalolokamikalomilo")[0] == "aa" and guess("enüberß")[0] == "cc"
    assert model.rows_of("mikalolokami") and not model.rows_of("漢字")


def test_odd_texts(spark, model):
    texts = [None, "", "123 !!! __", "漢字", "ka " * 200_000, "x" * 300_000, "ow", "ow"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred int")
    rows = {r.doc_id: r for r in identify(df, model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0
    assert rows[3].lang_pred in model.langs and rows[4].lang_pred == "aa" and rows[6] [1:] == rows[7][1:]
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == len(texts)
    assert identify(df.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, "aa"), (2, "text", None)], DDL)
    empty = train(df)
    assert [r.lang_pred for r in identify(df, empty).collect()] == ["und", "und"]


def test_bounded_sample(spark):
    assert train(spark.createDataFrame(corpus(), DDL), most=50).langs == ["aa", "bb", "cc"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = op10_language(spark, DATA).join(docs, "doc_id").select("lang_pred", "lang", "held_out", (fold_of("doc_id", 4) == 2).alias("h")).collect()
    assert len(rows) == docs.count() and all(r.h == r.held_out for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9


def test_labels_are_no_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    other = docs.withColumn("lang", F.when(fold_of("doc_id", 4) != 2, F.col("lang"))).withColumn("source", F.lit("z"))
    other.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(op10_language(spark, DATA).collect()) == sorted(op10_language(spark, str(tmp_path)).collect())


def brute(train_rows, texts):
    """The prediction from its description, with plain dictionaries: no cuts, since the fixture is small."""
    words, grams = {}, {n: {} for n in (4, 3, 2, 1)}
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    pieces = lambda w, n: [x[i : i + n] for x in [f"^{w}$" if n > 1 else w] for i in range(len(x) - n + 1)]
    for _, text, lang in train_rows:
        for w in letters(text):
            words.setdefault(lang, Counter())[w] += 1
            for n in grams:
                grams[n].setdefault(lang, Counter()).update(pieces(w, n))
    langs = sorted(words)

    def table(counts):
        kept = {x for lang in langs for x, c in counts[lang].items() if c > 1}
        of = lambda lang, x: counts[lang][x] if counts[lang][x] > 1 else 0
        return {x: [math.log((of(lang, x) + 0.5) / (counts[lang].total() + 0.5 * max(1, len(kept)))) for lang in langs] for x in kept}

    by_word, by_gram = table(words), {n: table(grams[n]) for n in grams}
    out = []
    for text in texts:
        found, sums, seen = letters(text or ""), [0.0] * len(langs), False
        for w in found:
            rows = [by_word[w]] if w in by_word else next((r for n in (4, 3, 2, 1) if (r := [by_gram[n][g] for g in pieces(w, n) if g in by_gram[n]])), [])
            for row in rows:
                seen, sums = True, [a + b / len(rows) for a, b in zip(sums, row, strict=True)]
        if not found:
            out.append(("und", 0.0))
            continue
        if not seen:
            whole = sum(words[lang].total() for lang in langs)
            sums = [math.log((words[lang].total() + 1) / (whole + len(langs))) for lang in langs]
        else:
            sums = [x * min(len(found), 40) / len(found) for x in sums]
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        out.append((langs[best], 1 / sum(math.exp(x - sums[best]) for x in sums)))
    return out


def test_against_brute_force(spark, model):
    rng = random.Random(9)
    texts = [None, "", "½ ²", "①Ⅷ", "x²y", "漢字", "KALO 3 mi_lo strz½owych"]
    texts += [" ".join("".join(rng.choices(sum(SYLLABLES.values(), []) + ["q", "é"], k=rng.randrange(1, 5))) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in identify(df, model).collect()}
    for i, (lang, score) in enumerate(brute(corpus(), texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9), texts[i]
    assert got[2].lang_pred == got[3].lang_pred == "und"


def test_rare_language_is_learned(spark):
    rows = corpus(300) + [(1000 + i, "zuzu zazu zuza", "rare") for i in range(3)]
    model = train(spark.createDataFrame(rows * 20, DDL).withColumn("doc_id", F.monotonically_increasing_id()), most=400)
    assert "rare" in model.langs and Predictor(model)("zazu zuzu")[0] == "rare"


def test_counts_are_handed_over(spark, model, monkeypatch):
    """Small buffers and very long words change nothing."""
    from scriptoria.llm import langid

    batches = [pa.RecordBatch.from_arrays([pa.array(["aa"] * 3), pa.array(["ka lo ka", "k" * 300_000, "mi"])], names=["lang", "text"])]
    whole = Counter()
    for b in langid.count_words(iter(batches)):
        whole.update({tuple(r.values())[:3]: r["n"] for r in b.to_pylist()})
    monkeypatch.setattr(langid, "HELD", 1)
    parts = [r for b in langid.count_words(iter(batches)) for r in b.to_pylist()]
    assert len(parts) == 4 and sum(r["n"] for r in parts) == whole.total() == 5


def test_grams_by_expressions_and_by_loops(spark, monkeypatch):
    from scriptoria.llm import langid

    rows = [(lang, "w", w, n) for lang in ("aa", "bb") for n, w in enumerate(["k", "lo", "mił", "über", "漢字漢", "k" * 64, "ab" * 40, "x" * 200_000], 1)]
    words = spark.createDataFrame(rows, langid.COUNTS_DDL)
    want = Counter()
    for lang, _, w, n in rows:
        for k in langid.LENGTHS:
            for g in langid.grams(w, k):
                want[lang, str(k), g] += n
    assert {(r.lang, r.kind, r.item): r.n for r in langid.summed_grams(words).collect()} == want
    monkeypatch.setattr(langid, "LONG", 0)
    assert {(r.lang, r.kind, r.item): r.n for r in langid.summed_grams(words).collect()} == want


def test_no_language_falls_out_of_the_sample_for_its_size(spark):
    """A rate far below one in a million still gives a language its part."""
    from scriptoria.llm.langid import even_sample

    df = spark.range(40_000_010).selectExpr("id AS doc_id", "IF(id < 40000000, 'en', 'xx') AS lang")
    picked = {r.lang: r["count"] for r in even_sample(df, "lang", "doc_id", 4).groupBy("lang").count().collect()}
    assert picked["xx"] == 10 and 10 < picked["en"] < 60
    many = {r.lang: r["count"] for r in even_sample(df, "lang", "doc_id", 400).groupBy("lang").count().collect()}
    assert 120 < many["en"] < 300 and many["xx"] == 10
    assert even_sample(df, "lang", "doc_id", 4, most_langs=1).where("lang = 'xx'").count() == 0
