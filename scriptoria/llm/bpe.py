"""Byte-level BPE with a local rank file: encoding to packed ids and decoding to bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scriptoria.llm.common import with_texts_mapped

#: Characters of text that go to the tokenizer at once, as far as a safe boundary allows.
PIECE_CHARS = 100_000


#: White space that is such for every regular expression engine, after something that is none for any.
BOUNDARY = re.compile(r"(?<=\S)[ \t\r\n]")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where the split pattern always has a boundary.

    No match of the pattern goes on from a character that is no white space to one that is: white space stands only at
    the start of a match or fills it. So a cut right before white space that follows something else changes no match, and
    as the left part does not end in white space, the look-ahead of the white-space branch sees no difference either.
    A stretch without such a place is not cut.
    """
    start, n = 0, len(text)
    while n - start > size:
        found = BOUNDARY.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def tokenizer(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


_READY: dict = {}


def _ready(key: tuple, make):
    """One tokenizer for each worker process, as building it takes longer than a small task."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = make()
    return _READY[key]


def encode_texts(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, decode: bool = False
) -> DataFrame:
    """keep's columns (all unless given) and n_tokens, token_ids (unsigned 32-bit little-endian ids in a row) and, on
    request, decoded (the bytes that the ids stand for).

    No special token is known, so their strings are ordinary text. Null and empty texts have no tokens and empty binaries.
    The rank file is read where the job starts and broadcast: its size is the vocabulary's (0.8 MB for 50k ranks), whatever
    the data. Each text is handled by itself, in pieces cut at safe boundaries; the ids do not depend on the cuts. Every row
    gives one, repeated rows too; an empty table gives none; a kept column with the name of an output is replaced.
    """
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        import numpy as np

        enc = _ready((ranks_path, pattern), lambda: tokenizer(shared.value, pattern))

        def work(text):
            if not text:
                return (0, b"", b"") if decode else (0, b"")
            parts = [enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in safe_pieces(text)]
            ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
            packed = ids.astype("<u4", copy=False).tobytes()
            return (len(ids), packed, enc.decode_bytes(ids.tolist())) if decode else (len(ids), packed)

        return work

    fields = [("n_tokens", T.LongType()), ("token_ids", T.BinaryType())] + [("decoded", T.BinaryType())] * decode
    return with_texts_mapped(df, text_col, df.columns if keep is None else keep, make, fields)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Add decoded: the bytes that packed ids stand for. Null gives null, empty ids empty bytes, of any length; an id outside the
    vocabulary fails the job. Rows are handled one by one, repeated ones too; an empty table gives an empty one; a column
    decoded is replaced."""
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    from pyspark.sql import functions as F

    import pandas as pd

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        enc = _ready((ranks_path, pattern), lambda: tokenizer(shared.value, pattern))
        for ids in batches:
            yield ids.map(lambda b: None if b is None else enc.decode_bytes(np.frombuffer(b, "<u4").tolist()))

    decoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("decoded", F.pandas_udf(decoded, "binary")(df[ids_col]))
