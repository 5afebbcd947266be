import random

from scriptoria.operators import quotes as Q
from scriptoria.operators import search as S


def test_no_quote_is_lost_before_alignment(spark):
    rng = random.Random(8)
    often, once = ["alder", "birch", "cedar"], ["maple", "poplar", "rowan", "spruce", "walnut", "willow", "hazel", "larch"]
    quotes = [(1, "alder birch cedar alder birch cedar alder birch maple poplar"), (2, "alder birch cedar … birch cedar alder birch maple"), (3, "alder alder alder alder"), (4, None), (5, "granite harbour lantern meadow")]
    docs = [(1, "so alder birch cedar alder birch cedar alder birch it ends"), (2, "gran-\nite har-\nbour lan-\ntern mea-\ndow"), (3, None), (4, "")]
    for i in range(60):
        words = rng.choices(often, k=8) + rng.sample(once, 2)
        quotes.append((10 + i, " ".join(words)))
        docs.append((10 + i, " ".join(["lead"] + words[:8] + rng.sample(once, 2))))
    found = Q.located_quotes(spark.createDataFrame(quotes, "q long, text string"), spark.createDataFrame(docs, "d long, text string"), "q", "d", "text")
    got = {(r.q, r.d, r.start, r.end, r.passage) for r in found.collect()}
    assert got == {(q, d, *x) for q, a in quotes for d, b in docs if (x := S.locate_quote(a, b))}
    assert {(1, 1), (5, 2)} <= {g[:2] for g in got}


def test_the_fast_search_is_the_plain_one(spark):
    """All stretches with tuples, as the rule says, against whole-number arithmetic and passing over."""
    rng = random.Random(11)
    letters = [f"w{c}xyz" for c in "abcdefgh"]
    for _ in range(300):
        q, src = ([(w, w[:5], 0, 0) for w in rng.choices(letters, k=rng.randrange(4, 14))] for _ in range(2))
        src = src + q[: rng.randrange(len(q) + 1)] + src
        wanted, span = [t[1] for t in q], S.stretch(len(q))
        every = [(*S.longest_common(wanted, [t[1] for t in src[i : i + span]]), i) for i in range(len(src)) if src[i][1] in wanted[:3]]
        length, first, last, i = max(every, key=lambda f: f[0], default=(0, 0, 0, 0))
        good = length and length >= 0.8 * len(q) and length >= 0.7 * (last - first + 1)
        assert S.nearly(q, src, 0) == ((i + first, i + last) if good else None)
        assert S.common_length(wanted)([t[1] for t in src]) == S.longest_common(wanted, [t[1] for t in src])[0]


def test_copies_frequent_words_and_empty_tables(spark, monkeypatch):
    docs = [(i, "the cat of the house sat on the mat by the door " * 3) for i in range(40)] + [(99, "a silver lantern of the house sat on the mat"), (100, None)]
    quotes = [(1, "the lantern of the house sat on the mat"), (2, "on the mat"), (3, "the"), (4, "of the … the door"), (5, "")]
    q, d = spark.createDataFrame(quotes, "q long, text string"), spark.createDataFrame(docs, "d long, text string")
    got = {(r.q, r.d, r.start, r.end, r.passage) for r in Q.located_quotes(q, d, "q", "d", "text").collect()}
    assert got == {(a, b, *x) for a, t in quotes for b, u in docs if (x := S.locate_quote(t, u))}
    assert {g[0] for g in got} >= {1, 2, 4} and len(got) > 80
    monkeypatch.setattr(Q, "FEW_STEMS", 0)
    assert {(r.q, r.d, r.start, r.end, r.passage) for r in Q.located_quotes(q, d, "q", "d", "text").collect()} == got
    assert Q.located_quotes(q.limit(0), d, "q", "d", "text").collect() == Q.located_quotes(q, d.limit(0), "q", "d", "text").collect() == []


def test_python_gets_few_rows_at_once(spark, monkeypatch):
    name, seen, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", [], Q._located_quotes
    before = spark.conf.get(name)
    monkeypatch.setattr(Q, "_located_quotes", lambda *a: seen.append(spark.conf.get(name)) or rows(*a))
    q, d = spark.createDataFrame([(1, "silver lantern of the house")], "q long, text string"), spark.createDataFrame([(i, "a silver lantern of the house") for i in range(300)], "d long, text string")
    assert Q.located_quotes(q, d, "q", "d", "text").count() == 300 and seen == [str(Q.ARROW_ROWS)] and spark.conf.get(name) == before
