"""Quotes found in whole collections by a positional index, and extracted fields checked against what they were read from."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scriptoria.functions import text as T
from scriptoria.operators.search import CUT, lacking_words, locate_quote, located, quote_tokens, stretch
from scriptoria.operators.tables import settled

#: Characters of the neighbouring fragments in which a field's source may still be found.
EDGE = 1200
#: Postings that a task hands over at once, and beginnings of words, five characters each, that every task may be given.
POSTINGS, FEW_STEMS = 50_000, 200_000
#: Share of a claim's stems that a passage must have to back it, and the share from which a passage is shown as the closest.
BACKED, SHOWN = 0.7, 0.25


# ---- a positional index of stems ----


def quote_index(docs: DataFrame, doc_key: str, text: str, only: frozenset[str] | None = None) -> DataFrame:
    """doc_key, stem and places: for each beginning of five characters of a document's words, the numbers of these words. Words
    that alignment takes for the same begin alike, numbers too. only names the beginnings that are wanted; all unless given."""
    kind = docs.schema[doc_key].dataType
    schema = StructType([StructField(doc_key, kind), StructField("stem", StringType()), StructField("places", ArrayType(IntegerType()))])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(keys: pa.Array) -> pa.RecordBatch:
            flat = [keys.take(pa.array(rows, pa.int64())), pa.array(stems, pa.string()), pa.array(places, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(flat, names=[doc_key, "stem", "places"])

        for batch in batches:
            rows, stems, places = [], [], []
            for n, t in enumerate(batch.column(1)):
                at: dict[str, list[int]] = {}
                for i, (word, _, _, _) in enumerate(quote_tokens(t.as_py() or "")):
                    if only is None or word[:5] in only:
                        at.setdefault(word[:5], []).append(i)
                rows += [n] * len(at)
                stems += at
                places += at.values()
                if len(rows) >= POSTINGS:
                    yield handed(batch.column(0))
                    rows, stems, places = [], [], []
            yield handed(batch.column(0))

    return docs.select(doc_key, docs[text].cast("string").alias("text")).mapInArrow(postings, schema)


def pieces_of(quote: str | None) -> list[dict]:
    """A quote's pieces: their stems, how many of their words must stand in a stretch of how many, and how many may lack."""
    out = []
    for piece in (quote_tokens(t) for t in CUT.split(quote or "")):
        if piece:
            n = len(piece)
            spare = lacking_words(n)
            out.append({"stems": sorted({t[0][:5] for t in piece}), "least": n - spare, "span": stretch(n) if n >= 4 else n, "spare": spare})
    return out


def holds_piece(piece: dict, places: dict[str, list[int]]) -> bool:
    """Whether some stretch of words has as many of a piece's stems as it needs, repeats counted."""
    at = sorted(p for s in piece["stems"] for p in places.get(s, ()))
    least, span = piece["least"], piece["span"]
    return any(at[i + least - 1] - at[i] < span for i in range(len(at) - least + 1))


PIECES = "array<struct<stems:array<string>,least:int,span:int,spare:int>>"


#: Rows that Spark hands to a task's Python at once: texts, and lists of places, are long.
ARROW_ROWS = 200


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets ARROW_ROWS rows at once from Spark; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def located_quotes(quotes: DataFrame, docs: DataFrame, quote_key: str, doc_key: str, text: str) -> DataFrame:
    """quote_key, doc_key, start, end and passage: every quote in every document that has it (see search.locate_quote). The rows
    are written as a table, so that all Python work is done in batches of ARROW_ROWS rows and its memory does not grow."""
    with short_batches(docs.sparkSession):
        return settled(_located_quotes(quotes, docs, quote_key, doc_key, text))


def _located_quotes(quotes: DataFrame, docs: DataFrame, quote_key: str, doc_key: str, text: str) -> DataFrame:
    """The rows of located_quotes.

    A document that has a quote has all of its n stems but those of words that alignment lets it lack, so of the rarest
    lacking + m stems at least m: candidates have m of these, m being half of what they need, and the most frequent stems pair
    nothing. Of a candidate the places of the quote's stems are read from the index, and its text only if for each piece some
    stretch has enough of them. So no place is lost, and texts are aligned only where they nearly must match. Null and empty
    quotes and texts match nothing.
    """

    @F.pandas_udf(PIECES)
    def pieces(q: pd.Series) -> pd.Series:
        return pd.Series([pieces_of(x) for x in q], dtype=object)

    @F.pandas_udf("boolean")
    def possible(wanted: pd.Series, found: pd.Series) -> pd.Series:
        rows = zip(wanted, found, strict=True)
        return pd.Series([all(holds_piece(p, places) for p in w) for w, f in rows for places in [{x["stem"]: list(x["places"]) for x in f}]])

    asked = quotes.select(quote_key, F.col(text).alias("quote"), pieces(F.col(text)).alias("pieces"))
    asked = settled(asked.withColumn("stems", F.array_distinct(F.flatten("pieces.stems"))).where(F.size("stems") > 0))
    spare = F.aggregate("pieces", F.lit(0), lambda n, p: n + p.spare)
    words = asked.select(quote_key, F.explode("stems").alias("stem"))
    stems = settled(words.select("stem").distinct())
    # few beginnings go to the tasks and are picked there; many are picked by a join, and the rows are the same
    few = frozenset(r.stem for r in stems.collect()) if stems.count() <= FEW_STEMS else None
    index = quote_index(docs, doc_key, text, few)
    index = settled(index if few is not None else index.join(stems, "stem", "left_semi"))
    df = index.groupBy("stem").agg(F.count("*").alias("df"))
    ranked = words.join(df, "stem", "left").groupBy(quote_key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "stem"))).alias("ranked"))
    half = F.ceil(F.greatest(F.size("ranked") - F.col("spare"), F.lit(1)) / 2).cast("int")
    rarest = ranked.join(asked.select(quote_key, spare.alias("spare")), quote_key).withColumn("least", half)
    rarest = rarest.select(quote_key, "least", F.explode(F.slice("ranked.stem", F.lit(1), F.col("spare") + F.col("least"))).alias("stem"))
    pairs = rarest.join(index.select("stem", doc_key), "stem").groupBy(quote_key, doc_key, "least").agg(F.count("*").alias("both")).where("both >= least").select(quote_key, doc_key)
    places = pairs.join(words, quote_key).join(index, [doc_key, "stem"]).groupBy(quote_key, doc_key).agg(F.collect_list(F.struct("stem", "places")).alias("found"))
    likely = places.join(asked.select(quote_key, "quote", "pieces"), quote_key).where(possible("pieces", "found")).select(quote_key, doc_key, "quote")
    # pairs are few and alignment is slow, so they are dealt out anew, whatever the files that hold the texts
    rows = settled(likely).join(docs.select(doc_key, F.col(text).alias("source")), doc_key).repartition(quote_key, doc_key)
    rows = rows.withColumn("at", located(F.col("quote"), F.col("source")))
    return rows.where("at.start IS NOT NULL").select(quote_key, doc_key, "at.start", "at.end", F.col("at.text").alias("passage"))


# ---- extracted fields ----

SENTENCE = re.compile(r"[^.!?;\n]+(?:[.!?;]+|$)")


def supporting_passage(claim: str, text: str) -> tuple[int, int, str] | None:
    """The sentence, or two neighbouring ones at 0.05 less, with the largest share of a claim's content stems, if that is at
    least BACKED; the earlier and shorter one of equals. Claims of fewer than three such stems are backed by nothing."""
    wanted = {t[1] for t in quote_tokens(claim) if len(t[0]) >= 3 and t[0] not in T.FOLDED_CONTENT_STOP_WORDS}
    parts = [m.span() for m in SENTENCE.finditer(text) if m[0].strip()]
    if len(wanted) < 3 or not parts:
        return None

    def share(i: int, j: int) -> float:
        have = {t[1] for t in quote_tokens(text[parts[i][0] : parts[j][1]])}
        return round(len(wanted & have) / len(wanted) - (0.05 if j > i else 0), 9)

    spans = [(i, j) for i in range(len(parts)) for j in (i, i + 1) if j < len(parts)]
    scores = [share(i, j) for i, j in spans]
    best = max(range(len(spans)), key=lambda n: (scores[n], -n))
    if scores[best] < BACKED:
        return None
    start, end = parts[spans[best][0]][0], parts[spans[best][1]][1]
    raw = text[start:end]
    start, end = start + len(raw) - len(raw.lstrip()), end - (len(raw) - len(raw.rstrip()))
    return start, end, text[start:end]


def locate_field(quote: str | None, claim: str, text: str) -> tuple[int, int, str] | None:
    """What backs a field in a text: its quote, else its claim taken as a quote, else a passage with most of the claim."""
    return locate_quote(quote, text) or locate_quote(claim, text) or supporting_passage(claim, text)


def locate_across(quote: str | None, claim: str, before: str, here: str, after: str) -> tuple[int, int, str, str] | None:
    """(start, end, passage, place) of what backs a field in its fragment with the edges of its neighbours.

    start and end are places in the fragment that place names: the one before or after if all of the passage is there, else
    the part of the passage that is in the field's own one. White space at the seams becomes line breaks again.
    """
    head, tail = before[-EDGE:], after[:EDGE]
    found = locate_field(quote, claim, f"{head}\n{here}\n{tail}")
    if not found:
        return None
    start, end, text = found
    first, last = len(head) + 1, len(head) + 1 + len(here)
    text = re.sub(r"\s*\n\s*", lambda m: "\n\n" if "\n\n" in m[0] else "\n", text)
    if end <= first:
        return start + len(before) - len(head), end + len(before) - len(head), text, "before"
    if start >= last:
        return start - last - 1, end - last - 1, text, "after"
    return max(0, start - first), min(len(here), end - first), text, "here"


PLACE = "start int, end int, passage string, place string"


def _found_here(quote: Column, claim: Column, here: Column) -> Column:
    @F.pandas_udf(PLACE)
    def run(q: pd.Series, c: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [(*x, "here") if b is not None and d is not None and (x := locate_field(a, b, d)) else (None,) * 4 for a, b, d in zip(q, c, t, strict=True)]
        return pd.DataFrame(rows, columns=["start", "end", "passage", "place"]).astype({"start": "Int32", "end": "Int32"})

    return run(quote, claim, here)


def _found_across(*columns: Column) -> Column:
    @F.pandas_udf(PLACE)
    def run(q: pd.Series, c: pd.Series, b: pd.Series, h: pd.Series, a: pd.Series) -> pd.DataFrame:
        rows = [locate_across(*x) or (None,) * 4 if x[1] is not None else (None,) * 4 for x in zip(q, c, b, h, a, strict=True)]
        return pd.DataFrame(rows, columns=["start", "end", "passage", "place"]).astype({"start": "Int32", "end": "Int32"})

    return run(*columns)


def validated_fields(fields: DataFrame, chunks: DataFrame, neighbours: bool = True) -> DataFrame:
    """Extracted fields (field_id, chunk_id, text, quote) against the chunks (chunk_id, document, ord, text) they were read from.

    A cascade: what backs a field is looked for in its own chunk; for the fields that are left, in the chunk joined with the
    edges of the two next to it, so that a sentence which the cut went through is found. Then the numbers and provisions of
    the claim must be in its chunk or in the passage found, not just somewhere near.

    Gives field_id, chunk_id, cited_chunk, place (here, before, after), start and end in the cited chunk, passage, accepted,
    reason, own_words (the quote is the claim itself, which is what a model does that writes from memory), closest and
    closest_score: for fields that nothing backs, the most alike passage of their chunk if it has a quarter of the claim.
    Without neighbours, chunks are taken alone: nothing is joined to them and their texts are shuffled once.
    Fields with a blank claim are rejected; those of unknown chunks have no row. Repeated rows are handled each for itself.
    """
    chunk = chunks.select("chunk_id", "document", "ord", F.coalesce("text", F.lit("")).alias("here"))
    rows = fields.select("field_id", "chunk_id", F.col("text").alias("claim"), "quote").join(chunk, "chunk_id")
    blank = T.collapsed(F.coalesce("claim", F.lit(""))) == ""
    text = lambda c: F.coalesce(c, F.lit(""))
    first = rows.withColumn("at", _found_here(F.col("quote"), F.when(~blank, F.col("claim")), F.col("here")))
    first = settled(first) if neighbours else first
    done = first.where("at.start IS NOT NULL").withColumn("cited_chunk", F.col("chunk_id"))
    if neighbours:
        beside = lambda name, step: chunk.select("document", (F.col("ord") + step).alias("ord"), F.col("chunk_id").alias(f"{name}_id"), F.col("here").alias(name))
        left = first.where("at.start IS NULL").drop("at").join(beside("before", 1), ["document", "ord"], "left").join(beside("after", -1), ["document", "ord"], "left")
        joined = F.when(~blank & (F.col("before_id").isNotNull() | F.col("after_id").isNotNull()), F.col("claim"))
        left = left.withColumn("at", _found_across(F.col("quote"), joined, text("before"), F.col("here"), text("after")))
        cited = F.when(F.col("at.place") == "before", F.col("before_id")).when(F.col("at.place") == "after", F.col("after_id")).otherwise(F.col("chunk_id"))
        out = done.unionByName(left.withColumn("cited_chunk", cited).select(*done.columns))
    else:
        out = first.withColumn("cited_chunk", F.col("chunk_id"))
    inside = (F.col("at.place") == "here") & F.contains(F.col("here"), F.col("at.passage"))
    source = F.when(inside, F.col("here")).otherwise(F.concat_ws("\n", "here", "at.passage"))
    invented = F.filter(T.unsupported_facts(F.col("claim"), source), lambda x: x != "")
    missing = F.col("at.start").isNull()
    reason = F.when(blank, "no claim").when(missing, "not found in the source").when(F.size(invented) > 0, F.concat(F.lit("not in the source: "), F.array_join(invented, ", ")))
    own = F.startswith(T.normalized_for_match(text("quote")), F.substring(T.normalized_for_match(text("claim")), 1, 60)) & (T.collapsed(text("quote")) != "")
    out = out.withColumn("reason", reason).withColumn("near", F.when(missing & ~blank, T.closest_passage(F.col("claim"), F.col("here"))))
    shown = F.col("near.score") >= SHOWN
    return out.select(
        "field_id", "chunk_id", F.when(~missing, F.col("cited_chunk")).alias("cited_chunk"), "at.place", "at.start", "at.end", "at.passage", F.col("reason").isNull().alias("accepted"), "reason",
        (missing & own).alias("own_words"), F.when(shown, F.col("near.passage")).alias("closest"), F.when(shown, F.round("near.score", 6)).alias("closest_score"),
    )
