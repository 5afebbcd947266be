import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import merkle
from scriptoria.llm.merkle import fold, merkle_proofs, row_digest
from scriptoria.llm.queries import op13_merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Levels of a tree and, by leaf, its proof as (before, after)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for i in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            run = i // 3 * 3
            way.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def brute(rows):
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = (own, *climb([leaf(r, r[1]) for r in own]))
    root, over = climb([trees[s][1] for s in order])
    out = []
    for s, above in zip(order, over, strict=True):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways, strict=True):
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            node = leaf(r, r[1] if odd or r[1] is None else r[1].replace("\n", ""))
            for a, b in way + above:
                node = h(a, node, b)
            out.append((r[0], leaf(r, r[1]), subroot, root, h(*[a + b for a, b in way + above]), node, node == root))
    return sorted(out, key=str)


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    texts = ["a\nb", "plain", "", None, "é\n\n", "x" * 50]
    return [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 5, 12])) for i in range(n)]


CASES = {
    "uneven": rows_of(400, ["a", "a", "a", "b", "é", "", None]),
    "many sources": rows_of(60, [f"s{i}" for i in range(50)]),
    "one row": rows_of(1, ["a"]),
    "one source": rows_of(28, ["a"]),
    "repeated and null keys": [*rows_of(20, ["a", "b"]), *rows_of(20, ["a", "b"]), (None, "x\ny", None, None, None), (None, "z", "en", "a", 1), (3, "other\n", "en", "a", 1)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("levels", [1, 3])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, case, levels):
    monkeypatch.setattr(merkle, "merkle_proofs", functools.partial(merkle_proofs, levels=levels))
    spark.createDataFrame(CASES[case], DDL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_merkle(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(CASES[case])


def test_empty_table_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_merkle(spark, str(tmp_path)).collect() == []
    df = spark.createDataFrame([(1, "a", "s", 7, 8), (2, "b", "s", 7, 8)], "doc_id long, text string, source string, mark int, tree int").withColumn("own", row_digest([F.col("text")]))
    out = merkle_proofs(df, "own", "source", "doc_id", keep=["doc_id", "mark", "tree"]).withColumn("back", fold(F.col("leaf"), F.col("path"))).collect()
    assert [(r.doc_id, r.mark, r.tree, r.back == r.root) for r in sorted(out)] == [(1, 7, 8, True), (2, 7, 8, True)]
    with pytest.raises(ValueError):
        merkle_proofs(df, "own", "source", "doc_id", keep=["path"])


def test_a_hot_source_is_spread(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'hot' AS source", "sha2(cast(id AS string), 256) AS own")
    out = merkle_proofs(rows, "own", "source", "doc_id", keep=["doc_id"])
    assert out.select(fold(F.col("leaf"), F.col("path")).alias("r"), "root").where("r = root").count() == 20_000
    assert out.selectExpr("floor(place / 2187) AS block").distinct().count() == 10
