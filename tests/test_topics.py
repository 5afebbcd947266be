import random

from scriptoria.operators import topics as K
from scriptoria.operators.graph import components

MENTION = "mention_id long, subject_id string, name string, aliases array<string>"


def reached(links):
    up = {}
    for a, b in links:
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)

    def top(x):
        return x if up[x] == x else top(up[x])

    return {x: top(x) for x in up}


def test_components_match_a_plain_union(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000), (7, 7)] + [(9000, 9001 + i) for i in range(300)]
    rows = [*links, *links[:20], *[(b, a) for a, b in links[:20]], (None, 4), (4, None)]
    got = components(spark.createDataFrame(rows, "x long, y long").repartition(5), "x", "y").collect()
    assert {r.node: r.component for r in got} == reached(links) and len(got) == len(reached(links))
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []
    names = components(spark.createDataFrame([("b", "c"), ("c", "a")], "x string, y string"), "x", "y")
    assert {(r.node, r.component) for r in names.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def resolved(spark, rows, **more):
    return {r.mention_id: r.topic_id for r in K.resolved_topics(spark.createDataFrame(rows, MENTION), **more).collect()}


def test_a_chain_of_fifty_names_is_one_topic(spark):
    words = [f"word{i:02d}" for i in range(60)]
    chain = [(i, "s", f"a{i:02d}", [words[i], words[i + 1]]) for i in range(50)]
    other = [(100 + i, "t", f"a{i:02d}", [words[i], words[i + 1]]) for i in range(0, 50, 2)]
    got = resolved(spark, chain + other)
    assert {got[i] for i in range(50)} == {0} and [got[100 + i] for i in range(0, 50, 2)] == [100 + i for i in range(0, 50, 2)]


def test_equal_alike_and_different_names(spark):
    rows = [
        (1, "s", "Umowa najmu lokalu", []), (2, "s", "UMOWA najmu  lokalu!", None), (3, "s", "Najem lokalu", ["umowa najmu lokali"]), (4, "s", "Umowa najmu", []), (5, "s", "Spadek", []),
        (6, "s", "inne", ["Spadek"]), (7, "s", "", None), (8, "s", None, None), (9, None, "Spadek", []), (10, None, "spadek", []), (11, "s", "x1", ["wspólny znak towarowy"]), (12, "s", "x2", ["znak towarowy nowy"]), (5, "s", "Spadek", []),
    ]
    got = resolved(spark, rows)
    assert got[1] == got[2] == got[3] == got[4] == 1 and got[5] == got[6] == 5 and got[9] == got[10] == 9
    assert (got[7], got[8]) == (7, 8) and len(got) == 12
    assert got[11] != got[12]  # two aliases that are only alike join nothing
    apart = spark.createDataFrame([("s", "umowa najmu", "Umowa najmu lokalu")], "subject_id string, name string, other_name string")
    kept = resolved(spark, [rows[0], rows[3]], apart=apart)
    assert kept == {1: 1, 4: 4} and resolved(spark, [rows[0], rows[1]], apart=apart) == {1: 1, 2: 1}
    assert resolved(spark, []) == {}


def test_alike_names_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"q{c}" for c in "abcdefghijkl"]
    rows = [(i, rng.choice("st"), " ".join(rng.sample(words, rng.randrange(1, 4))), [" ".join(rng.sample(words, 3))] if rng.random() < 0.3 else []) for i in range(60)]
    sets = [(i, s, [(frozenset(x.split()), n == 0) for n, x in enumerate([name, *more])]) for i, s, name, more in rows]
    links = [(i, i) for i, _, _ in sets]
    for i, s, a in sets:
        for j, t, b in sets:
            if i < j and s == t and any(x == y or ((p or q) and len(x & y) >= 0.5 * len(x | y)) for x, p in a for y, q in b if x == y or p or q):
                links.append((i, j))
    got = resolved(spark, [(i, s, " ".join(sorted(n.split())), [" ".join(sorted(x.split())) for x in m]) for i, s, n, m in rows])
    # whether a label is a name is a matter of its subject, not of the mention alone
    main = {(s, x) for _, s, a in sets for x, p in a if p}
    for i, s, a in sets:
        for j, t, b in sets:
            if i < j and s == t and any(len(x & y) >= 0.5 * len(x | y) and ((s, x) in main or (s, y) in main) for x, _ in a for y, _ in b):
                links.append((i, j))
    assert got == reached(links)


def test_topics_fields_and_relations(spark):
    rows = [(1, "s", "Umowa najmu", ["najem"], True), (2, "s", "umowa  najmu", ["Czynsz najmu"], True), (3, "s", "Spadek", [], False)]
    m = spark.createDataFrame(rows, f"{MENTION}, emphasized boolean")
    r = K.resolved_topics(m)
    topics = K.topics_of(m, r)
    assert {tuple(t) for t in topics.collect()} == {(1, "s", "Umowa najmu", 2, 2), (3, "s", "Spadek", 1, 0)}
    assert {tuple(a) for a in K.topic_aliases(m, r, topics).collect()} == {(1, "najem"), (1, "Czynsz najmu")}
    said = spark.createDataFrame([(1, "is_a", "spadek"), (2, "is_a", "SPADEK"), (2, "is_a", "najem"), (3, "distinguish", "Nieznane prawo"), (3, "is_a", " "), (3, "distinguish", "czynsz najmu")], "mention_id long, type string, target string")
    relations = K.resolved_relations(said, m, r)
    assert {tuple(x) for x in relations.collect()} == {(1, "is_a", 3, None), (3, "distinguish", None, "niezna prawo"), (3, "distinguish", 1, None)}
    assert {tuple(x) for x in K.related_topics(relations, "distinguish", 2).collect()} == {(1, 3, 1), (3, 1, 1)}
    fields = [(1, 1, "effect", "Tekst  pierwszy", "q1"), (2, 1, "effect", "tekst pierwszy", "q2"), (3, 1, "effect", "inny", "Q2"), (4, 1, "basis", "tekst pierwszy", ""), (5, 2, "effect", "tekst pierwszy", None), (6, 1, "effect", "trzeci", "")]
    kept = {x.field_id: x.kept_id for x in K.merged_fields(spark.createDataFrame(fields, "field_id long, topic_id long, field_type string, text string, quote string")).collect()}
    assert kept == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
