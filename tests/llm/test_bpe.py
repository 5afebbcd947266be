import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from scriptoria.llm.bpe import decode_ids, encode_texts, load_ranks, safe_pieces

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "Hello  world\n\n it's 12345 o'clock!?  ", "\x1c\x1c!\x1c x", "naïve façade 漢字 🙂🙂   x", "x" * 3000,
    ("some words, 'll 42 \t tabs\n" * 9000), "<|endoftext|>", "no-space-" * 500,
]


def reference():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_pieces_join_and_do_not_change_ids():
    enc = reference()
    for text in filter(None, TEXTS):
        for size in (1, 3, 50):
            parts = list(safe_pieces(text[:4000], size))
            assert "".join(parts) == text[:4000]
            assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text[:4000])


def test_round_trip(spark):
    enc = reference()
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_tokens string")
    rows = encode_texts(df, PATH, public_tokenizers.PATTERN, decode=True).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        want = enc.encode_ordinary(text)
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == text.encode()
    back = decode_ids(encode_texts(df, PATH, public_tokenizers.PATTERN, keep=["doc_id"]), PATH, public_tokenizers.PATTERN)
    assert {(r.doc_id, hashlib.sha256(r.decoded).hexdigest()) for r in back.collect()} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(TEXTS)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_texts(df, PATH, public_tokenizers.PATTERN).collect() == []
