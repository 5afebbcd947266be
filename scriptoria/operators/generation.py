"""Materials that a model made of topics: checked, anchored in sources by a cascade of citations, without repeats, up to a limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators.quotes import supporting_passage
from scriptoria.operators.review import checked_materials
from scriptoria.operators.search import located
from scriptoria.operators.tables import settled

#: Materials over the limit that are looked at in case earlier ones are rejected.
SPARE = 2


def material_text(type_: Column, q: Column, a: Column, text: Column, prompt: Column, items: Column) -> Column:
    """What a material says, in one line: a gap text filled in, a list with its items, else question and answer."""
    say = lambda c: T.collapsed(F.coalesce(c, F.lit("")))
    filled = F.regexp_replace(say(text), T.CLOZE, "$2")
    listed = F.concat_ws(" ", say(prompt), F.array_join(F.coalesce(items, F.array().cast("array<string>")), "; "))
    return F.when(type_ == "cloze", filled).when(type_ == "list", F.trim(listed)).otherwise(F.trim(F.concat_ws(" ", say(q), say(a))))


def _backed(claim: Column, source: Column) -> Column:
    @F.pandas_udf("start int, end int, text string")
    def run(c: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = [(supporting_passage(a, b) if a and b else None) or (None, None, None) for a, b in zip(c, s, strict=True)]
        return pd.DataFrame(rows, columns=["start", "end", "text"]).astype({"start": "Int32", "end": "Int32"})

    return run(claim, source)


CITE = ["material_id", "chunk_id", "quote", "start", "end"]


def anchored(materials: DataFrame, sources: DataFrame, field_citations: DataFrame) -> DataFrame:
    """material_id, chunk_id, quote, start, end: what each material (material_id, topic_id, said, citations, field_ids) rests on.

    Every quote is looked for in the chunk that it names and, if it is not there, in the topic's others in their order. For
    materials without a quote that was found, the first of the topic's chunks that has a passage with most of what they say.
    For those still without, the citations of the fields that they were made from, where the chunk is one of the topic's. Each
    step works on what the steps before left. sources: topic_id, chunk_id, place, text; field_citations: field_id, chunk_id,
    quote, start, end.
    """
    said = materials.select("material_id", "topic_id", "said", F.posexplode("citations").alias("n", "c")).select("material_id", "topic_id", "n", "c.chunk_id", F.col("c.quote").alias("asked"))
    named = said.join(sources, ["topic_id", "chunk_id"]).withColumn("at", located(F.col("asked"), F.col("text")))
    by_name = settled(named.where("at.start IS NOT NULL").select("material_id", "n", "chunk_id", "at"))
    lost = said.join(by_name.select("material_id", "n"), ["material_id", "n"], "left_anti").withColumnRenamed("chunk_id", "named")
    others = lost.join(sources, "topic_id").where(~F.col("named").eqNullSafe(F.col("chunk_id"))).withColumn("at", located(F.col("asked"), F.col("text"))).where("at.start IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("material_id", "n").orderBy("place", "chunk_id"))
    elsewhere = others.withColumn("k", first).where("k = 1").select("material_id", "n", "chunk_id", "at")
    flat = lambda df: df.select("material_id", "chunk_id", F.col("at.text").alias("quote"), "at.start", "at.end")
    quoted = settled(flat(by_name.unionByName(elsewhere)))

    rest = materials.join(quoted.select("material_id").distinct(), "material_id", "left_anti")
    backed = rest.select("material_id", "topic_id", "said").join(sources, "topic_id").withColumn("at", _backed(F.col("said"), F.col("text"))).where("at.start IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("material_id").orderBy("place", "chunk_id"))
    backed = settled(flat(backed.withColumn("k", first).where("k = 1")))

    rest = rest.join(backed.select("material_id"), "material_id", "left_anti")
    fields = rest.select("material_id", "topic_id", F.explode("field_ids").alias("field_id")).join(field_citations, "field_id").join(sources.select("topic_id", "chunk_id"), ["topic_id", "chunk_id"], "left_semi")
    return quoted.unionByName(backed).unionByName(fields.select(*CITE))


def generated_materials(generated: DataFrame, sources: DataFrame, field_citations: DataFrame, existing: DataFrame, limit: int, provisions: bool = False) -> tuple[DataFrame, DataFrame]:
    """(materials, citations) of what a model generated.

    generated: material_id, topic_id, place (its number in the answer, from 0), type, q, a, text, prompt, items, citations
    (array of chunk_id, quote), field_ids; existing: topic_id and said of materials that there are. materials has material_id,
    topic_id, said, status and reason: rejected for its form (provisions only where they are asked for) or a warning, for
    having no source, or for numbers and provisions that the cited chunks do not have; repeated if the topic has the same words
    already or from an earlier accepted one; left out beyond the limit; created otherwise. citations has those of created ones.

    Of an answer the first limit + SPARE materials are looked at; the others are left out. Sources are a few chunks a topic.
    """
    said = material_text(*[F.col(c) for c in ("type", "q", "a", "text", "prompt", "items")])
    kind = F.when((F.col("type") == "provision") & ~F.lit(provisions), F.lit("not asked for")).otherwise(F.col("type"))
    rows = checked_materials(generated.withColumn("type", kind)).withColumn("said", said).withColumn("warning", F.array_join("warnings", ", "))
    form = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("warning") != "", F.col("warning"))
    rows = settled(rows.select("material_id", "topic_id", "place", "said", "citations", "field_ids", form.alias("form"), T.normalized_for_match(said).alias("key")))
    looked = rows.where((F.col("place") < limit + SPARE) & F.col("form").isNull())
    known = existing.select("topic_id", T.normalized_for_match(F.col("said")).alias("key")).distinct()
    cites = settled(anchored(looked.join(known, ["topic_id", "key"], "left_anti"), sources, field_citations).distinct())
    whole = cites.select("material_id", "chunk_id").distinct().join(sources.select("chunk_id", "text").distinct(), "chunk_id")
    whole = whole.groupBy("material_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x.text), "\n").alias("source"))
    told = rows.join(known.withColumn("known", F.lit(True)), ["topic_id", "key"], "left").join(whole, "material_id", "left")
    invented = F.filter(T.unsupported_facts(F.col("said"), F.col("source")), lambda x: x != "")
    reason = (
        F.when(F.col("form").isNotNull(), F.col("form")).when(F.col("place") >= limit + SPARE, "over the limit").when(F.col("known"), "repeated")
        .when(F.col("source").isNull(), "not found in the source").when(F.size(invented) > 0, F.concat(F.lit("not in the source: "), F.array_join(invented, ", ")))
    )
    told = settled(told.select("material_id", "topic_id", "place", "said", "key", reason.alias("reason")))
    good = told.where("reason IS NULL").withColumn("again", F.row_number().over(Window.partitionBy("topic_id", "key").orderBy("place", "material_id")))
    n = F.sum((F.col("again") == 1).cast("int")).over(Window.partitionBy("topic_id").orderBy("place", "material_id").rowsBetween(Window.unboundedPreceding, 0))
    good = good.withColumn("n", n).withColumn("reason", F.when(F.col("again") > 1, "repeated").when(F.col("n") > limit, "over the limit")).drop("again", "n")
    out = told.where("reason IS NOT NULL").unionByName(good)
    status = F.when(F.col("reason").isNull(), "created").when(F.col("reason").isin("repeated", "over the limit"), "left out").otherwise("rejected")
    out = out.select("material_id", "topic_id", "said", status.alias("status"), "reason")
    return out, cites.join(out.where("status = 'created'").select("material_id"), "material_id", "left_semi")
