import hashlib
import random

import pytest

from scriptoria.llm.common import shard_bounds
from scriptoria.llm.cws import Sampler, edited_fingerprints, fingerprints, likeness


def generalised_jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    rng, made = random.Random(1), Sampler(samples=4096)
    for n in (3, 40, 3000):
        a = {f"w{i}": rng.choice([1, 1, 1, 2, 5, 0.5]) for i in range(n)}
        b = {k: rng.choice([v, v, 2 * v, 1]) for k, v in a.items() if rng.random() < 0.7} | {f"x{i}": 1 for i in range(n // 3)}
        want = generalised_jaccard(a, b)
        assert likeness(made.signature(a), made.signature(b)) == pytest.approx(want, abs=0.035)
    assert likeness(made.signature({"a": 1}), made.signature({"b": 1})) < 0.01


def brute(rows):
    order = sorted([(k, t or "") for k, t in rows if k is None], key=lambda r: r[1]) + sorted([(k, t or "") for k, t in rows if k is not None], key=lambda r: (-r[0], r[1]))
    out = []
    for i, (k, t) in enumerate(order):
        nxt, h = order[(i + 1) % len(order)][1], len(t) // 2
        out.append((k, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", [range(60), [5] * 10 + [7, 9, None, None], [3], range(-40, 4000, 101)])
def test_edited_texts(spark, ids):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "é🙂 x", "word " * rng.randrange(40), " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(200)))])) for i in ids]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string")
    got = edited_fingerprints(df).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    plain = {r.text or "": r.fingerprint for r in fingerprints(df.drop("fingerprint")).collect()}
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, set()).add(r.fingerprint)
    for k, t in rows:
        assert plain[t or ""] in texts[k]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert edited_fingerprints(df).collect() == [] and fingerprints(df).collect() == []


def test_half_of_a_text_is_left(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{i}w{rng.randrange(10**6)}" for _ in range(400))) for i in range(12)]
    for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.15 < r.near_edited < 0.55 and r.near_next < 0.1


def test_likenesses_against_brute_force(spark):
    """near_edited and near_next are the shares of agreeing samples, recomputed here from the fingerprints of plain texts."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["", "!!! ??", "-- --", "é🙂", " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(120)))])) for i in range(50)]
    order = sorted(rows, key=lambda r: -r[0])
    after = {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}
    changed = {k: t[: len(t) - len(t) // 2] + after[k][: len(t) // 2] for k, t in rows}
    plain = {r.t: r.fingerprint for r in fingerprints(spark.createDataFrame([(t,) for t in {*changed.values(), *(t for _, t in rows)}], "t string"), "t").collect()}
    share = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)
    for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        mine, other = plain[dict(rows)[r.doc_id]], plain[changed[r.doc_id]]
        assert (r.fingerprint, r.edited_fingerprint) == (mine, other)
        assert r.near_edited == pytest.approx(share(mine, other)) and r.near_next == pytest.approx(share(mine, plain[after[r.doc_id]]))
    assert share(plain["!!! ??"], plain["-- --"]) < 0.1


def test_very_long_text_and_small_shards(spark, monkeypatch):
    from scriptoria.llm import cws

    monkeypatch.setattr(cws, "shard_bounds", lambda rows: shard_bounds(rows, shard_bytes=2000))
    rng = random.Random(8)
    rows = [(rng.choice([None, 4, 4, i]), " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(60)))) for i in range(80)] + [(77, "word " * 400_000)]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(rows)
