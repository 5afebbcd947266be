"""Language identification: known words by per-language log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import cut, with_texts_mapped

#: Labelled documents that a model is fitted on at most, an equal part for each language, picked by a hash of their key.
TRAIN_ROWS = 20_000
#: Languages that a model knows at most, those with most documents.
MOST_LANGS = 256
#: Rows that a language has in the sample at least, about, if it has so many.
LEAST_PART = 30
#: Words, and n-grams of each length, that the model keeps for each language: its size does not grow with the data.
KEPT_WORDS, KEPT_GRAMS = 20_000, 8_000
#: Lengths of n-grams in the order of the backoff.
LENGTHS = (4, 3, 2, 1)
#: Unseen words that a worker remembers.
MEMORY = 200_000
#: Different words that a task counts, and characters that it reads, before it hands counts over.
HELD, HELD_CHARS = 100_000, 8_000_000
#: Letters from which on a word is a long one.
LONG = 64
#: Words whose evidence counts in full; that of longer texts is scaled down to this many.
FULL_WORDS = 40

RUNS = re.compile(r"[^\W\d_]+")
#: Numbers that are no digits, such as fractions, raised and Roman ones: word characters for re, but no letters. SEARCH finds
#: texts that may have some; characters beyond the first plane are one range there, as a long list of them would be slow.
ODD = {ord(c): " " for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}
SEARCH = re.compile("[%s\U00010000-\U0010ffff]" % "".join(chr(c) for c in ODD if c < 0x10000))


def words_in(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    return RUNS.findall((text.translate(ODD) if not text.isascii() and SEARCH.search(text) else text).lower())


def grams(word: str, n: int):
    padded = f"^{word}$" if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


@dataclass
class Model:
    """Log probabilities by item and language; words maps a word, and grams[n] an n-gram, to its row.

    A row has the languages that know the item: places[starts[row]:starts[row + 1]], and what each gains over floors[kinds[row]],
    which all languages have for items of that kind that they do not know.
    """

    langs: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    starts: np.ndarray
    places: np.ndarray
    gains: np.ndarray
    kinds: np.ndarray
    floors: np.ndarray
    default: np.ndarray

    def rows_of(self, word: str) -> list[int]:
        """The rows that stand for an unseen word: its n-grams of the greatest length of which it has a known one."""
        for n in LENGTHS:
            known = self.grams[n]
            if found := [known[g] for g in grams(word, n) if g in known]:
                return found
        return []

    def total(self, rows: list[int], weights: list[float]) -> np.ndarray:
        """By language, the sum of rows times their weights."""
        rows, weights = np.asarray(rows), np.asarray(weights, float)
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        known = np.bincount(self.places[at], self.gains[at] * np.repeat(weights, sizes), len(self.langs))
        return known + np.bincount(self.kinds[rows], weights, len(self.floors)) @ self.floors


COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())])
COUNTS_DDL = "lang string, kind string, item string, n long"


def handed_over(held: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    """The counts by (lang, kind) as rows; they are zero after that."""
    for (lang, kind), counts in held.items():
        if counts:
            n = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([kind] * n), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=COUNTS)
    held.clear()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by language, from (lang, text), handed over after HELD different words or HELD_CHARS read."""
    held, chars = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            held.setdefault((lang, "w"), Counter()).update(words_in(text))
            chars += len(text)
            if chars >= HELD_CHARS or sum(map(len, held.values())) >= HELD:
                yield from handed_over(held)
                chars = 0
    yield from handed_over(held)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, from counts of words (lang, kind, item, n), handed over after each word of HELD
    characters or more, or after so many."""
    held, chars = {}, 0
    for batch in batches:
        for lang, w, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            for k in LENGTHS:
                counts = held.setdefault((lang, str(k)), Counter())
                for g in grams(w, k):
                    counts[g] += n
            chars += len(w)
            if chars >= HELD:
                yield from handed_over(held)
                chars = 0
    yield from handed_over(held)


#: n-grams (kind, item) of a word that is not long.
GRAMS = f"""flatten(transform(array({", ".join(map(str, LENGTHS))}), k -> if(length(item) + if(k > 1, 2, 0) < k, array(),
  transform(sequence(1, length(item) + if(k > 1, 3, 1) - k), i -> named_struct('kind', string(k), 'item', substring(if(k > 1, '^' || item || '$', item), i, k))))))"""


def summed_grams(words: DataFrame) -> DataFrame:
    """Counts of n-grams from those of words: by expressions for words of up to LONG letters, and longer ones, whose n-grams
    would be too large an array, in Python, which holds a part of them at a time."""
    short = words.where(F.length("item") <= LONG).select("lang", "n", F.explode(F.expr(GRAMS)).alias("g")).select("lang", "g.kind", "g.item", "n")
    long = words.where(F.length("item") > LONG).mapInArrow(count_grams, COUNTS_DDL)
    return short.unionByName(long).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def even_sample(df: DataFrame, lang_col: str, key_col: str, most: int, most_langs: int = MOST_LANGS) -> DataFrame:
    """About `most` rows at most, as far as there are so many an equal part of each of the most_langs languages with most
    rows, and LEAST_PART of each at least, chosen by a hash of the key. Hashes have 62 bits, so a language keeps its part however
    many rows it has."""
    found = df.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not found:
        return df.limit(0)
    grain, share = 1 << 62, max(LEAST_PART, -(-most // len(found)))
    rates = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(grain, -(-grain * share // r.n)))])
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key_col)), 2) < F.try_element_at(rates, F.col(lang_col)))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", most: int = TRAIN_ROWS, most_langs: int = MOST_LANGS) -> Model:
    """Fit a model on rows with a text and a language, `most` of them at most, evenly by language.

    Words are counted by language in tasks and then over all, and the n-grams of the counted words likewise. For each
    language and kind a table of how many items occur how often gives their sum and the least count with which no more than
    KEPT_WORDS words or KEPT_GRAMS n-grams are kept: items of one count stay or go together, and those that occur once go.
    The driver holds that table and the model, which keeps the items that a language has, not a row of all languages for each:
    most_langs * (KEPT_WORDS + 4 * KEPT_GRAMS) entries of 12 bytes at most, and the items' texts. Languages beyond the
    most_langs with most rows are not learned: raise it where there are more. Repeated rows count as often as they stand there;
    rows without a text or a language do not count; texts of any length are counted whole; an empty table, or nothing to
    learn from, makes a model that answers `und`.
    """
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key")).where("lang is not null and text is not null")
    rows = even_sample(rows, "lang", "key", most, most_langs).select("lang", "text")
    words = cut(rows.mapInArrow(count_words, COUNTS_DDL).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "words")
    totals = cut(words.unionByName(summed_grams(words)), "totals")

    mass, often = Counter(), {}
    for r in totals.groupBy("lang", "kind", "n").agg(F.count("*").alias("items")).collect():
        mass[r.lang, r.kind] += r.n * r["items"]
        often.setdefault((r.lang, r.kind), []).append((r.n, r["items"]))
    least = []
    for (lang, kind), table in often.items():
        room, at = KEPT_WORDS if kind == "w" else KEPT_GRAMS, 2
        for n, items in sorted(table, reverse=True):
            room -= items
            if room < 0:
                at = max(at, n + 1)
                break
        least.append((lang, kind, at))
    if least:
        bars = df.sparkSession.createDataFrame(least, "lang string, kind string, at_least long")
        kept = totals.join(F.broadcast(bars), ["lang", "kind"]).where("n >= at_least").select("lang", "kind", "item", "n").collect()  # 5 bars for each language
    else:
        kept = []

    langs = sorted({lang for lang, _ in mass})
    place = {lang: i for i, lang in enumerate(langs)}
    kept = sorted((r.kind, r.item, place[r.lang], r.n) for r in kept)
    every = ("w", *map(str, LENGTHS))
    maps, starts, kinds = {kind: {} for kind in every}, [], []
    for i, (kind, item, _, _) in enumerate(kept):
        if item not in maps[kind]:
            maps[kind][item] = len(starts)
            starts.append(i)
            kinds.append(every.index(kind))
    totals_of = np.array([[mass.get((lang, kind), 0) for lang in langs] for kind in every], float).reshape(len(every), len(langs))
    floors = np.log(0.5 / (totals_of + 0.5 * np.array([[max(1, len(maps[kind]))] for kind in every])))
    gains = np.log((np.array([n for *_, n in kept], float) + 0.5) / 0.5)
    places = np.array([p for _, _, p, _ in kept], np.int32)
    docs = np.array([mass.get((lang, "w"), 0) for lang in langs], float)
    default = np.log((docs + 1) / (docs.sum() + len(langs))) if langs else docs
    return Model(langs, maps["w"], {n: maps[str(n)] for n in LENGTHS}, np.array([*starts, len(kept)], np.int64), places, gains, np.array(kinds, np.int64), floors, default)


class Predictor:
    def __init__(self, model: Model):
        self.model, self.memory = model, {}

    def __call__(self, text: str | None) -> tuple[str, float]:
        model = self.model
        counts = Counter(words_in(text)) if text else None
        if not counts or not model.langs:
            return "und", 0.0
        known, memory, words = model.words, self.memory, 0
        rows, weights = [], []
        if len(memory) > MEMORY:
            memory.clear()
        for word, n in counts.items():
            words += n
            row = known.get(word)
            if row is not None:
                rows.append(row)
                weights.append(n)
                continue
            unseen = memory.get(word)
            if unseen is None:
                unseen = memory[word] = model.rows_of(word)
            if unseen:
                rows += unseen
                weights += [n / len(unseen)] * len(unseen)
        if not rows:
            total = model.default
        else:
            total = model.total(rows, weights)
            total = total * (min(words, FULL_WORDS) / words)
        best = int(total.argmax())
        return model.langs[best], float(1 / np.exp(total - total[best]).sum()) if math.isfinite(total[best]) else 0.0


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all unless given), lang_pred and score.

    A text's words are its runs of letters in lower case. A word that the model knows adds its log frequency in each
    language; another one adds the mean of its 4-grams' (with marks for its ends), or if it has no known one of its
    3-grams', and so on; a word without known letters adds nothing. score is the posterior of the chosen language, with
    the evidence of FULL_WORDS words at most, so that it is no certainty merely for a long text. A text that is null or
    has no letter is `und` with score 0; so is every text if nothing was learned. Ties go to the language that sorts first.
    Texts of any length are read whole; repeated rows are answered alike; an empty frame gives an empty one; a kept column
    named lang_pred or score is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of bounded size, see train()
    return with_texts_mapped(df, text_col, df.columns if keep is None else keep, lambda: Predictor(shared.value), [("lang_pred", T.StringType()), ("score", T.DoubleType())])
