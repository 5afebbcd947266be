import random

import numpy as np
import pytest
import xxhash

from scriptoria.llm.simhash import components, fingerprint_texts, forest, keep_first, link_fingerprints, near_duplicates


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        r = find(i)
        least[r] = min(k, least.get(r, k))
    return [least[find(i)] for i in range(len(ids))]


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus():
    rng, texts = random.Random(3), [None, "", "  \n\t", "One", "one TWO", "ÀÉ Straße  x y z", "a a a a a a a"]
    for _ in range(12):
        base = words(rng, rng.randrange(20, 400))
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append("\n".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    texts += [texts[8]] * 5
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    ids = random.Random(1).sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, simhash string")
    rows = {r.doc_id: r for r in near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [rows[i].simhash & (2**64 - 1) for i in ids] == fps
    want = brute_components(ids, fps)
    assert [rows[i].component_id for i in ids] == want
    assert len(set(want)) < len(ids) / 2
    kept = keep_first(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want)) and kept[0].simhash == "x"


@pytest.mark.parametrize("tile", [6, 20_000])
def test_links_connect_all_within_three_bits(spark, tile):
    rng, fps = random.Random(5), [0]
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(rng.randrange(12)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            fps.append(base)
    fps += [(0xABCD << 32) | rng.getrandbits(32) for _ in range(50)]  # one half in common
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), tile=tile)
    comp = {r.node: r.root for r in components(links).collect()}
    got = [comp.get(f, f) for f in signed]
    assert got == brute_components(signed, fps)


def test_forest():
    a, b = forest(np.array([0, 1, 3, 7, 15, 3 << 40], np.int64), 1)
    assert len(a) == 4 and set(b.tolist()) == {1, 3, 7, 15}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    rows = {r.node: r.root for r in components(links).collect()}
    assert rows == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_null_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words entirely here now")], "doc_id long, text string")
    rows = near_duplicates(df).collect()
    assert sorted(str(r.component_id) for r in rows) == ["5", "5", "5", "None"]
    assert sorted(str(r.doc_id) for r in keep_first(df).collect()) in (["5", "None", "None"], ["5", "None"])
    assert near_duplicates(df.limit(0)).collect() == [] and keep_first(df.limit(0)).collect() == []


def test_fingerprint_keeps_columns(spark):
    assert fingerprint_texts(spark.createDataFrame([(1, "a b c")], "id long, text string")).columns == ["id", "text", "simhash"]


def test_rows_of_one_key_with_different_texts(spark):
    """Key 5 has a copy of key 1's text and a text of its own: only the latter stands for key 5."""
    rows = [(1, "a b c d e f", "x", "s"), (5, "a b c d e f", "y", "s"), (5, "quite other words stand in this one", "z", "s"), (5, "quite other words stand in this one", "z", "s"), (None, "a b c d e f", "n", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, simhash string")
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.tag, r.simhash) for r in kept.collect()) == [(1, "x", "s"), (5, "z", "s")]


def test_very_long_text(spark):
    text = " ".join(f"w{i % 997}" for i in range(300_000))
    df = spark.createDataFrame([(2, text), (1, text), (3, "x" * 1_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert rows[2].component_id == rows[1].component_id == 1 and rows[3].component_id == 3
    assert rows[2].simhash & (2**64 - 1) == brute_fingerprint(text)
