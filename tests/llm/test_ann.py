import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.llm.ann import nearest

NAN, INF = float("nan"), float("inf")


def brute(rows, queries, k):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in good:
        if q in queries:
            found = sorted({(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), i) for i, y in good if i != q and len(y) == len(x)})
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def vectors(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[50:120] = v[0]  # a large class of copies
    v[130:160] = v[129] + rng.normal(size=(30, dim)).astype(np.float32) * 1e-4
    v[200:210] = v[199] * np.float32(4)
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(n)]
    rows += [(1000, None), (1010, []), (1020, [0.0] * dim), (1030, [NAN] * dim), (1040, [INF] * dim), (1050, [None] * dim), (None, rows[3][1]), (1060, [1.0, 2.0]), (1070, [2.0, 1.0]), (1080, [-0.0] * dim)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [(4096, 1024), (37, 11)])
def test_against_brute_force(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = sorted(tuple(r) for r in nearest(df, F.col("vec_id") % 10 == 0, 5, candidate_block=blocks[0], query_block=blocks[1]).collect())
    want = brute(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 5)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[3] == pytest.approx(w[3], abs=1e-12)
        # a tie in exact arithmetic may fall to either side of rounding
        assert g[2] == w[2] or abs(g[3] - w[3]) < 1e-12


def test_few_candidates_repeats_and_empty(spark):
    ddl = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])], ddl)
    rows = nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(1, 1), (2, 2)] and rows[1].score == 0
    assert nearest(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert nearest(df.where("vec_id = 2"), F.col("vec_id") == 2).collect() == []
    assert nearest(df, F.lit(None).cast("boolean")).collect() == []
