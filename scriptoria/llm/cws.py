"""Document fingerprints by consistent weighted sampling: two signatures agree at a place with a chance equal to the
generalised Jaccard similarity of the weighted terms."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import PLACE, cut, place_of, shard_bounds, shard_of, with_texts_mapped

#: Samples in a signature; the error of a likeness s is about sqrt(s * (1 - s) / SAMPLES).
SAMPLES = 96
#: log2 of the number of random triples that (term, sample) pairs draw from.
POOL_BITS = 18
#: Terms handled at once, so that a very long text needs no large matrix.
CHUNK = 2048
#: Characters of a text by which rows of one key are dealt out.
TIE = 32
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000

WORD = re.compile(r"\w+")


class Sampler:
    """Signatures of weighted terms.

    For each term and sample there are r and c, drawn from Gamma(2, 1), and beta, uniform on (0, 1). With weight w,
    t = floor(ln w / r + beta), y = exp(r * (t - beta)) and a = c / (y * exp(r)); the sample is the (term, t) with the
    smallest a. The triples come from a fixed pool: sample d of a term uses entry (h1 + d * h2) modulo the pool's size, h1
    and h2 being two halves of the term's XXH64, so equal terms draw equal triples in every task.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        rng, size = np.random.default_rng(seed), 1 << POOL_BITS
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.single = self.ln_c + self.r * (self.beta - 1)  # ln a for weight 1, where t is 0
        self.steps = np.arange(samples, dtype=np.uint32)[:, None]
        self.samples, self.known = samples, {}

    def hashes(self, words) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxh64_intdigest(w, 0)
            out.append(h)
        return np.array(out, np.uint64)

    def signature(self, weights: dict[str, float]) -> bytes:
        """Two bytes for each sample; none of weight: zeros."""
        if not weights:
            return bytes(2 * self.samples)
        terms, w = self.hashes(weights), np.fromiter(weights.values(), np.float32, len(weights))
        best = np.full(self.samples, np.inf, np.float32)
        pick = np.zeros(self.samples, np.uint64)
        rows = np.arange(self.samples)
        for at in range(0, len(terms), CHUNK):
            h, lw = terms[at : at + CHUNK], np.log(w[at : at + CHUNK])
            h1, h2 = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            index = (h1 + self.steps * h2) & np.uint32((1 << POOL_BITS) - 1)
            index = index.astype(np.intp)
            value = self.single.take(index)
            if (many := np.flatnonzero(lw != 0)).size:
                sub = index.take(many, axis=1)
                r = self.r.take(sub)
                t = np.floor(lw[many] / r + self.beta.take(sub))
                value[:, many] -= r * t  # ln a is that of weight 1 less r * t
            least = value.argmin(axis=1)
            found = value[rows, least]
            better = found < best
            key = h[least]
            if many.size:
                column = np.full(len(h), -1)
                column[many] = np.arange(many.size)
                at_least = column[least]
                steps = np.where(at_least >= 0, t[rows, at_least], 0).astype(np.int64)
                key = key + steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            best, pick = np.where(better, found, best), np.where(better, key, pick)
        pick = (pick ^ (pick >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        short = (pick >> np.uint64(48)).astype(">u2")
        return np.maximum(short, 1).astype(">u2").tobytes()  # zeros are kept for texts without terms


@lru_cache(maxsize=2)
def sampler(samples: int) -> Sampler:
    return Sampler(samples)


def text_terms(text: str | None) -> Counter:
    """Words of the text in lower case, each weighted with how often it occurs; the characters other than white space of a
    text that has no words."""
    low = (text or "").lower()
    return Counter(WORD.findall(low)) or Counter("".join(low.split()))


def likeness(a: bytes, b: bytes) -> float:
    """The share of samples that agree."""
    return float(np.mean(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)))


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, samples: int = SAMPLES) -> DataFrame:
    """keep's columns (all unless given) and fingerprint, 4 hex digits for each sample. Null and empty texts and those
    of white space have all zeros, which agree with each other and with no other fingerprint. Repeated rows have equal
    fingerprints, texts of any length are read whole, and an empty frame gives an empty one."""

    def make():
        made = sampler(samples)
        return lambda text: (made.signature(text_terms(text)).hex(),)

    return with_texts_mapped(df, text_col, df.columns if keep is None else keep, make, [("fingerprint", T.StringType())])


EDITED_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """For each row: the key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Rows stand in descending order of the key, rows without one first and ties by text; after the last comes the first. A
    row's edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next row's
    text. near_edited and near_next are the likeness of the row's fingerprint to its edited text's and to the next row's.
    One row alone is its own next. Null texts are empty.

    Texts are shuffled once, into ranges of the order with about SHARD_BYTES of text each, whose bounds come from a
    hash-picked sample; rows of one key, or without one, are cut apart by the first TIE characters of their texts. A range's
    last row needs the first row of the following range: a copy of each range's first row goes there as well.
    """
    k, t = df[key_col].cast("long"), F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(k.alias("k"), t.alias("t"), place_of(F.bitwise_not(k), F.left(t, F.lit(TIE)), nulls_first=True).alias("place"))
    bounds = shard_bounds(docs.select("place", F.octet_length("t").alias("size")))
    docs = docs.withColumn("shard", shard_of(F.col("place"), bounds))
    firsts = docs.groupBy("shard").agg(F.min("place").alias("top")).orderBy("shard").collect()  # as many rows as shards, MOST_SHARDS at most
    spark, before = df.sparkSession, [r.shard for r in firsts[-1:] + firsts[:-1]]
    heads = spark.createDataFrame([(r.shard, r.top, to) for r, to in zip(firsts, before, strict=True)], f"s int, top {PLACE}, to int")
    copies = docs.join(F.broadcast(heads), (docs.shard == heads.s) & (docs.place == heads.top)).groupBy("to").agg(F.min(F.struct("t", "k")).alias("x"))
    copies = cut(copies.select(F.col("x.k").alias("k"), F.col("x.t").alias("t"), F.col("to").alias("shard"), F.lit(1).alias("copy")), "heads")
    rows = docs.select("k", "t", "shard", F.lit(0).alias("copy")).unionByName(copies)
    order = [F.col("k").desc_nulls_first(), F.col("t")]
    dealt = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "copy", *order).select("shard", "copy", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, out, size = sampler(samples), None, [], 0
        for batch in batches:
            for shard, copy, key, text in zip(*batch.columns, strict=True):
                shard, copy, text = shard.as_py(), copy.as_py(), text.as_py()
                sign = made.signature(text_terms(text))
                if held and held[0] == shard:
                    out.append(edited(*held[1:], text, sign))
                held = None if copy else (shard, key.as_py(), text, sign)
                size += len(text)
                if size > 4_000_000 or len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, EDITED)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, EDITED)

    def edited(key, text, sign, following, next_sign) -> dict:
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        changed_sign = made_sign(changed)
        return {
            "k": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": sign.hex(), "edited_fingerprint": changed_sign.hex(),
            "near_edited": likeness(sign, changed_sign), "near_next": likeness(sign, next_sign),
        }

    def made_sign(text):
        return sampler(samples).signature(text_terms(text))

    return dealt.mapInArrow(run, f"k long, {EDITED_DDL}").withColumnRenamed("k", key_col)


EDITED = pa.schema(
    [("k", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
