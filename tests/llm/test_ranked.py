import math
import random
import re
from collections import Counter

import pytest

from scriptoria.llm import ranked
from scriptoria.llm.ranked import index_documents, search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=20):
    """The contract's formula over every document."""
    bags = [(key, Counter(terms(t))) for key, t in docs]
    bags = [(key, b) for key, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for key, b in bags:
            n, score = sum(b.values()), 0
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            for t in terms(text):
                if b[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key, score))
        out += [(item, rank, key, score) for rank, (_, _, key, score) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, k=20, partitions=4):
    index = index_documents(spark.createDataFrame(docs, DOCS).repartition(partitions))
    found = search(index, spark.createDataFrame(items, ITEMS), k).collect()
    return sorted((r.item_id, r["rank"], r["key"], r.score) for r in found)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(6)
    words = [f"W{i}" for i in range(300)] + ["é", "Straße", "ÄB", "漢字", "x²"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", ", ", "--"]).join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(700)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]  # copies, so scores tie
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(25)] + [(90, docs[3][1]), (91, "nowhere"), (92, None), (93, "..."), (94, "W0 w0 W0")]
    return docs, items


def test_all_ranks_match_brute_force(spark, made):
    assert run(spark, *made) == brute(*made)


def test_small_blocks_chunks_and_groups_change_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(ranked, "GROUP_QUERIES", 7)
    monkeypatch.setattr(ranked, "GROUP_CELLS", 900)
    index = index_documents(spark.createDataFrame(made[0], DOCS).repartition(9))
    got = search(index, spark.createDataFrame(made[1], ITEMS), 3)
    assert sorted((r.item_id, r["rank"], r["key"], r.score) for r in got.collect()) == brute(*made, k=3)


def test_blocks_bound_the_scores_of_their_documents(spark, made):
    index = index_documents(spark.createDataFrame(made[0], DOCS).repartition(3))
    for block in index.blocks.collect():
        most = [0] * len(block.terms)
        for place, part in zip(block.places, block.parts, strict=True):
            most[place] = max(most[place], part)
        assert most == block.maxima and list(block.terms) == sorted(block.terms) and len(block["keys"]) <= ranked.BLOCK_DOCS
    assert index.blocks.selectExpr("size(keys) AS n").agg({"n": "sum"}).head()[0] == index.n_docs


def test_groups_of_queries_keep_all_terms(made):
    queries = [(i, Counter(t.encode() for t in terms(text))) for i, text in made[1] if terms(text)]
    group = ranked.Asked.of(queries)
    assert group.terms == sorted({t for _, c in queries for t in c}) and group.weighted([1] * len(group.terms)).sum() == sum(sum(c.values()) for _, c in queries)


def test_sums_beyond_doubles_are_integers(spark, made, monkeypatch):
    monkeypatch.setattr(ranked, "EXACT", 1)
    assert ranked._matrix(ranked.Asked.of([(1, Counter([b"a"]))]).weighted([5])).dtype.kind == "i"
    assert ranked._matrix(ranked.Asked.of([(1, Counter([b"a"]))]).weighted([5])).shape == (1, 1)


def test_long_texts_come_in_pieces(monkeypatch):
    text = ("Ab cd-é " * 50).encode()
    whole = ranked.counted(text)
    monkeypatch.setattr(ranked, "PIECE_BYTES", 7)
    assert ranked.counted(text) == whole == (150, Counter({b"ab": 50, b"cd": 50, "é".encode(): 50}))


def test_nulls_repeated_rows_and_empty_tables(spark):
    docs = [(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (6, None), (7, ""), (8, "c")]
    items = [(1, "a"), (1, "a"), (None, "c"), (2, None)]
    by_one = sorted((r for r in (search(index_documents(spark.createDataFrame(docs, DOCS)), spark.createDataFrame([(1, "a"), (1, "a")], ITEMS)).collect())), key=lambda r: r["rank"])
    assert [(r["rank"], r["key"]) for r in by_one] == [(1, 5), (2, 5), (3, None), (4, None)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    clash = spark.createDataFrame([(1, "a", "x", "y")], "doc_id long, text string, block string, terms string")
    assert search(index_documents(clash), spark.createDataFrame([(1, "a")], ITEMS)).count() == 1


def test_few_blocks_are_read_at_once(spark, monkeypatch):
    """Searches read short batches and small row groups, whatever the files' sizes, and the session's settings come back."""
    import pyarrow.parquet as pq

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before, seen, scored = [spark.conf.get(n) for n in names], [], ranked._scored
    monkeypatch.setattr(ranked, "GROUP_BYTES", 100_000)
    monkeypatch.setattr(ranked, "_scored", lambda *args: seen.append([spark.conf.get(n) for n in names]) or scored(*args))
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(12_000)]
    index = index_documents(spark.createDataFrame(docs, DOCS).coalesce(1))
    found = search(index, spark.createDataFrame([(1, docs[7][1])], ITEMS), k=3).collect()
    assert [r.key for r in found if r["rank"] == 1] == [7] and len(found) == 3
    assert seen and all(int(rows) == ranked.ARROW_ROWS <= 64 for s in seen for rows in s) and [spark.conf.get(n) for n in names] == before
    (file,) = [f.removeprefix("file:") for f in index.blocks.inputFiles()]
    assert pq.ParquetFile(file).metadata.num_row_groups > 1
