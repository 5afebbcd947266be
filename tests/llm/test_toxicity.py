import math
import random

import pytest

from scriptoria.llm.common import fold_of
from scriptoria.llm.queries import op1_toxicity
from scriptoria.llm.toxicity import FEATURES, FuzzyLexicon, Weigher, allowed_errors, fit, learned_terms, score_toxicity

DATA = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    terms = ["scum", "idiot", "clown", "worthless", "pathetic", "disgusting", "idiotic", "été"]
    lexicon, rng = FuzzyLexicon(terms), random.Random(3)
    words = ["", "scam", "scum", "idiots", "idot", "wortless", "wrothless", "dsgustin", "漢字", "x" * 300]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "t", "s", "0"])
        words.append("".join(w))
    for w in words:
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= allowed_errors(t))
        assert lexicon.match(w) == (near[0][::-1] if near else None), w


def test_context_tells_quotation_from_abuse():
    weigh = Weigher(["idiot", "scum"])
    f = lambda text: dict(zip(FEATURES, weigh(text), strict=True))
    abuse, plain, quote = f("you are an idiot !"), f("the thing idiot stands here"), f('she said the word "idiot" was used')
    assert abuse["exact"] > plain["exact"] > quote["exact"] > 0 and quote["quoted"] > plain["quoted"] == 0
    assert f("an idiott here")["fuzzy"] > 0 and f("an idiott here")["exact"] == 0
    assert weigh(None) == weigh("") == weigh("nothing") == (0.0,) * len(FEATURES)


ROWS = [(i, f"w{i} x{i} plain words y{i}", 0) for i in range(60)] + [(100 + i, f"a{i} grumpel b{i} and c{i}", 1) for i in range(30)] + [(200 + i, "one shared passage with blorf inside", 1) for i in range(20)]


def test_learns_terms_but_not_passages(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, label int")
    assert learned_terms(rows.selectExpr("text", "cast(label as double) as label")) == ["grumpel"]


def test_edge_rows(spark):
    model = fit(spark.createDataFrame(ROWS, "doc_id long, text string, toxic int"))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "grumpel " * 100_000, "a"), (4, "grumpel z", "a"), (4, "grumpel z", "a")], "doc_id long, text string, score string")
    rows = score_toxicity(df, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].score == by[2].score < 0.5 and by[3].predicted == 1
    assert score_toxicity(df.limit(0), model).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, "text", 1)], [(1, None, 0)], [(1, "text", None), (2, "t", 7)]])
def test_little_to_learn_from(spark, rows):
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    found = score_toxicity(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.predicted for r in found] == [1, 0]


def test_held_out(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").withColumn("h", fold_of("doc_id", 5) == 0).collect()}
    rows = op1_toxicity(spark, DATA).collect()
    assert len(rows) == 1000
    held = [(labels[r.doc_id].toxic, r) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(t == r.predicted for t, r in held) / len(held) > 0.93
    assert all(r.held_out == labels[r.doc_id].h for r in rows if r.doc_id in labels)


def brute_features(text, terms):
    """Features from their description, with plain edit distances."""
    from scriptoria.llm import toxicity as X

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    tokens = X.TOKEN.findall((text or "").lower())
    edits = {}
    for t in set(tokens):
        near = [d for term in terms if (d := distance(t, term)) <= X.allowed_errors(term)]
        if near and t not in X.QUOTES:
            edits[t] = min(near)
    inside, sums, strongest, n_words = False, [0.0, 0.0, 0.0], 0.0, 0
    for i, t in enumerate(tokens):
        if t in X.QUOTES:
            inside = not inside
            continue
        n_words += 1
        if t in edits:
            around = [tokens[j] for j in range(max(0, i - X.CONTEXT), min(len(tokens), i + X.CONTEXT + 1)) if j != i]
            marks = [x for x in around if x in X.QUOTES]
            quote = (0.5 if inside and marks else 0) + (0.4 if set(around) & X.REPORT_WORDS else 0) + (0.2 if len(marks) >= 2 else 0)
            abuse = (0.5 if set(around) & X.ADDRESS_WORDS else 0) + (0.2 if "!" in around else 0) + (0.5 if set(around) & set(edits) else 0)
            weight = max(0.1, 1 + abuse - quote) * {0: 1.0, 1: 0.6, 2: 0.4}[edits[t]]
            sums[1 if edits[t] else 0] += weight
            sums[2] += quote
            strongest = max(strongest, weight)
    return (*(math.log1p(x) for x in sums), min(1.0, 10 * (sums[0] + sums[1]) / max(1, n_words)), strongest)


def test_features_against_brute_force():
    from scriptoria.llm import toxicity as X

    rng = random.Random(12)
    terms = ("idiot", "moronic", "scum", "worthless")
    pieces = ["idiot", "idoit", "idi0t", "moronc", "scum", "skum", "worthles", "you", "said", '"', "!", "the", "a", "house", "x", "'", "."]
    weigher = X.Weigher(terms)
    for text in [None, "", '"'] + [" ".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(300)]:
        assert weigher(text) == pytest.approx(brute_features(text, terms)), text


def test_automaton_begins_anew(monkeypatch):
    from scriptoria.llm import toxicity as X

    words = ["idiot", "idoit", "house", "moronic", "mornic", "xyz"] * 3
    want = [X.FuzzyLexicon(("idiot", "moronic")).match(w) for w in words]
    monkeypatch.setattr(X, "MOST_STATES", 3)
    lexicon = X.FuzzyLexicon(("idiot", "moronic"))
    assert [lexicon.match(w) for w in words] == want and len(lexicon.states) < 40
