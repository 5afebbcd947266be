import hashlib

import public_tokenizers
import pytest
from test_secrets import base
from test_simhash import brute_components, brute_fingerprint
from test_bpe import reference

import corpus_pipeline as cp
from scriptoria.llm.common import cut

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """The stages' results on the smallest documents and some odd rows, each read again by the next."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "123 456", "en", "s", 7), (9004, "the and token=abcdefgh1 of the é and", "en", None, 36), (9005, None, None, None, None)]
    docs = cut(docs.unionByName(spark.createDataFrame(odd, DDL)), "docs")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cut(stage(spark, out[-1], "/nowhere"), name))
    return [o.collect() for o in out], out


def test_stages_against_brute_force(stages):
    (docs, lang, dedup, clean, mixed, ids), frames = stages
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    gone = {r.doc_id for r in docs} - {r.doc_id for r in lang}
    assert {9001, 9002, 9003, 9005} <= gone and len(gone) < 0.05 * len(docs)
    names = [r.doc_id for r in lang]
    assert {r.doc_id for r in dedup} == set(brute_components(names, [brute_fingerprint(r.text) for r in lang])) and len(dedup) < len(lang)
    before = {r.doc_id: r for r in dedup}
    for r in clean:
        if base(before[r.doc_id].text):
            assert "[SECRET]" in r.text and not base(r.text.replace("[SECRET]", " ")) and r.n_chars == len(r.text)
        elif "[SECRET]" not in r.text:
            assert r == before[r.doc_id]
    assert next(r for r in clean if r.doc_id == 9004).text == "the and [SECRET] of the é and"
    assert sorted(map(str, mixed)) == sorted(map(str, clean))
    enc, texts = reference(), {r.doc_id: r.text for r in mixed}
    assert len(ids) == len(mixed)
    for r in ids:
        want = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert hashlib.sha256(r.token_ids).hexdigest() == r.ids_sha256


def test_empty(spark):
    docs = spark.createDataFrame([], DDL)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "/nowhere")
    assert docs.collect() == []


def test_run_gives_the_stages_rows(spark):
    assert public_tokenizers.path and cp.ORACLE_SQL is None
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 100


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, text_before string, mix_position string, simhash string, c0 string, secret_spans string"


def test_clashing_names_repeats_and_long_texts(spark):
    """A caller's columns stay as they are in every stage, repeated rows are treated alike, and long texts stay whole."""
    words = "the quick brown fox jumps over the lazy dog and runs away into the dark wood "
    long = " ".join(f"the fox {i} runs away from dog {i * 7} in the wood" for i in range(60_000))
    texts = [words * 3, words * 3, "ein kleiner Hund lief durch den Wald und sah den Fuchs", long, words + "token=abcdefgh1", None]
    extra = ("S", "L", "B", "M", "H", "C", "P")
    rows = [(i % 5 + 1 if i < 5 else None, t, "de" if t and "Hund" in t else "en", None, len(t or ""), *extra) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[4:5], CLASHING)
    for name, stage in cp.STAGES[:-1]:
        out = cut(stage(spark, docs, "/nowhere"), name)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r[5:]) == extra for r in got), name
        want = {"language_id": 6, "near_dedup": 4, "secrets": 4, "mixing": 4}[name]
        assert len(got) == want, (name, got)
        docs = out
    assert max(len(r.text) for r in got) == len(long) and sum("[SECRET]" in r.text for r in got) == 1
    ids = cp.encode_bytes(spark, docs, "/nowhere").collect()
    assert len(ids) == 4 and len({r.mix_position for r in ids}) == 4
