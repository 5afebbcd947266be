"""Cards that ask for the structure of a topic, made from its verified fields and kept up to date in materials of any payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a topic needs, characters of a part's line, and points beyond which a line is full whatever they say.
LEAST_PARTS, LINE = 3, 90
MOST_POINTS = LINE // 2 + 1

# The parts of a topic in their order.
PARTS = ("definition", "basis", "premise", "element", "effect", "exception", "deadline", "case_law", "doctrine", "ratio")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def payload_of(payload: Column) -> Column:
    """The payload as a variant; null if it is no JSON."""
    return F.try_parse_json(payload)


def is_synthesis(payload: Column) -> Column:
    """Whether a variant says so; flags written as 1 count as well."""
    flag = F.coalesce(F.try_variant_get(payload, "$.synthesis", "boolean"), F.try_variant_get(payload, "$.synthesis", "int") == 1)
    return F.coalesce(flag, F.lit(False))


def synthesis_cards(topics: DataFrame, fields: DataFrame, labels: dict[str, str], prompt: str) -> DataFrame:
    """topic_id, prompt, items and field_ids (of each part the first field) for topics (topic_id, name) with fields of LEAST_PARTS
    parts or more. fields: field_id, topic_id, field_type, ord, text, status; active ones count, by ord and field_id.

    An item is a part's label and its points, cut to LINE characters. Of a part no more points are gathered than can show in
    its line, so a topic of any size makes a short row.
    """
    rows = fields.where(F.col("status") == "active").select("topic_id", "field_type", "ord", "field_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\.$", "").alias("text"))
    rows = rows.withColumn("part", F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("field_type"))).where("part > 0")
    place = F.row_number().over(Window.partitionBy("topic_id", "part").orderBy("ord", "field_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= MOST_POINTS)
    points = rows.groupBy("topic_id", "part", "field_type").agg(F.array_sort(F.collect_list(F.struct("place", "text", "field_id"))).alias("points"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("field_type")), F.col("field_type"))
    line = F.concat(label, F.lit(": "), shortened(F.array_join("points.text", "; "), LINE))
    parts = points.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("part", line.alias("item"), F.get("points.field_id", F.lit(0)).alias("field_id")))).alias("parts"))
    parts = parts.where(F.size("parts") >= LEAST_PARTS).join(topics.select("topic_id", "name"), "topic_id")
    return parts.select("topic_id", F.concat(F.lit(prompt), "name").alias("prompt"), F.col("parts.item").alias("items"), F.col("parts.field_id").alias("field_ids"))


def synthesis_materials(topics: DataFrame, fields: DataFrame, materials: DataFrame, labels: dict[str, str], prompt: str) -> DataFrame:
    """topic_id, material_id, action, prompt, items, field_ids and payload_json for every card of synthesis_cards.

    materials (material_id, topic_id, type, payload_json) may have payloads of any form. The topic's card is its list material
    whose payload says that it is a synthesis, the one with the smallest id of several. action is `created` where there is
    none (material_id is null), `kept` where prompt and items are the same, null for null, and `updated` otherwise. Materials
    that are no cards, payloads that are no JSON and topics with too few parts have no row.
    """
    known = materials.where("type = 'list'").withColumn("payload", payload_of(F.col("payload_json"))).where(is_synthesis(F.col("payload")))
    known = known.select("topic_id", "material_id", F.try_variant_get("payload", "$.prompt", "string").alias("old_prompt"), F.try_variant_get("payload", "$.items", "array<string>").alias("old_items"))
    first = F.row_number().over(Window.partitionBy("topic_id").orderBy("material_id"))
    known = known.withColumn("n", first).where("n = 1").drop("n")
    rows = synthesis_cards(topics, fields, labels, prompt).join(known, "topic_id", "left")
    same = F.col("prompt").eqNullSafe(F.col("old_prompt")) & F.col("items").eqNullSafe(F.col("old_items"))
    action = F.when(F.col("material_id").isNull(), "created").when(same, "kept").otherwise("updated")
    payload = F.to_json(F.struct("prompt", "items", F.lit(True).alias("synthesis")))
    return rows.select("topic_id", "material_id", action.alias("action"), "prompt", "items", "field_ids", payload.alias("payload_json"))


def synthesis_citations(cards: DataFrame, citations: DataFrame) -> DataFrame:
    """topic_id, part (from 0), field_id, chunk_id: what a new or changed card cites, of each part's first field the citation with
    the smallest chunk. citations: owner_type, owner_id, chunk_id."""
    wanted = cards.where("action <> 'kept'").select("topic_id", F.posexplode("field_ids").alias("part", "field_id"))
    cited = citations.where("owner_type = 'topic_field'").groupBy(F.col("owner_id").alias("field_id")).agg(F.min("chunk_id").alias("chunk_id"))
    return wanted.join(cited, "field_id").select("topic_id", "part", "field_id", "chunk_id")
