"""Queries over model answers, which are made of documents and then damaged in several ways, and over cards of synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import answers as A
from scriptoria.operators import synthesis as Y
from scriptoria.plans import bindings as B
from scriptoria.plans.registry import query

#: Words that no document has.
NOWHERE = "qqxvz kkwyj vvzqx jjwkq xxqzv wwvkj"


def answers(spark, sf_dir):
    """An answer of one of three models about each document, as JSON: a topic of its first words with three fields, of which the
    second is invented and the third has no known type, and a topic without a name. By doc_id modulo 8 the answer is broken off (0),
    has a number for its topics (1), stands between fences (2), has none (3) or is empty (4)."""
    docs = B.read(spark, sf_dir, "documents")
    words, d = F.split(F.get(F.split("text", "\n"), F.lit(0)), " "), F.col("doc_id")
    name, quote = F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 8), " ")
    field = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit("legal").alias("definition_kind"), text.alias("text"), text.alias("quote"))
    topic = lambda title: F.struct(title.alias("name"), F.array(F.lit(" other "), title).alias("aliases"), (d % 2 == 0).alias("emphasized"), F.array(field("definition", quote), field("effect", F.lit(NOWHERE)), field("song", quote)).alias("fields"), F.array(F.struct(F.lit("is_a").alias("type"), F.lit("x").alias("target"))).alias("relations"))
    whole = F.to_json(F.struct(F.array(topic(name), topic(F.lit("  "))).alias("topics"), F.array(F.lit("gap")).alias("gaps"), F.lit(1).alias("more")))
    raw = (
        F.when(d % 8 == 0, F.expr("left(whole, length(whole) - 7)")).when(d % 8 == 1, F.lit('{"topics": 5, "gaps": []}')).when(d % 8 == 2, F.concat(F.lit("```json\n"), "whole", F.lit("\n```")))
        .when(d % 8 == 3, F.lit('{"gaps": ["a"]}')).when(d % 8 == 4, F.lit(" ")).otherwise(F.col("whole"))
    )
    rows = docs.withColumn("whole", whole).withColumn("raw", raw)
    return rows.select(d.alias("answer_id"), F.concat(F.lit("model "), d % 3).alias("model"), d.alias("chunk_id"), "raw", (d % 10).cast("double").alias("seconds"))


def chunks(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), F.col("doc_id").alias("ord"), "text")


ERROR = "CASE doc_id % 8 WHEN 0 THEN 'no JSON of this form' WHEN 1 THEN 'no JSON of this form' WHEN 3 THEN 'no topics' WHEN 4 THEN 'empty' END"
NAME = "regexp_replace(trim(array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:2], ' ')), '\\s+', ' ', 'g')"


@query(f"""WITH a AS (SELECT doc_id AS answer_id, {ERROR} AS error, {NAME} AS name, doc_id % 2 = 0 AS emphasized FROM documents)
SELECT answer_id, error, CASE WHEN error IS NULL AND name <> '' THEN name END AS name, CASE WHEN error IS NULL AND name <> '' THEN emphasized END AS emphasized FROM a""")
def model_answers(spark, sf_dir):
    """Every answer with its error or its topic."""
    read = A.read_answers(answers(spark, sf_dir))
    topics = A.answer_topics(read, "answer_id").where(F.col("aliases") == F.array(F.lit("other"))).select("answer_id", "name", "emphasized")
    return read.select("answer_id", "error").join(topics, "answer_id", "left")


@query(f"""WITH a AS (SELECT doc_id, 'model ' || doc_id % 3 AS model, doc_id % 10 AS seconds, {ERROR} AS error, {NAME} AS name, string_split(string_split(text, chr(10))[1], ' ')[2:9] AS quote FROM documents),
f AS (SELECT *, error IS NULL AND name <> '' AND len(quote) = 8 AND length(array_to_string(quote, ' ')) > 8 AS good FROM a)
SELECT model, count(*) AS chunks, CAST(sum(seconds) AS DOUBLE) AS seconds, count(*) FILTER (error IS NULL) AS valid_json, count(*) FILTER (good) AS topics, count(*) FILTER (good) AS fields, count(*) FILTER (good) AS rejected,
CAST(0.5 AS DOUBLE) AS verified_share, arg_max(error, doc_id) FILTER (error IS NOT NULL) AS error FROM f GROUP BY model""")
def model_comparison_full(spark, sf_dir):
    """The models over every document whose first line has nine words or more; of two fields that count one is invented."""
    long = B.read(spark, sf_dir, "documents").where(F.size(F.split(F.get(F.split("text", "\n"), F.lit(0)), " ")) >= 9).select(F.col("doc_id").alias("answer_id"))
    every, there = answers(spark, sf_dir), long.withColumn("long", F.lit(True))
    # answers about shorter documents have no usable topic here
    raw = F.when(F.col("long") | ~(F.col("answer_id") % 8).isin(2, 5, 6, 7), F.col("raw")).otherwise(F.lit('{"topics": []}'))
    return A.model_comparison(every.join(there, "answer_id", "left").withColumn("raw", raw).drop("long"), chunks(spark, sf_dir))


LABELS = {"definition": "definicja", "basis": "podstawa prawna", "premise": "przesłanka", "effect": "skutek"}
PROMPT = "Odtwórz schemat: "


def schema_tables(spark, sf_dir):
    """Sources are topics; a document is a field of the part that its length names, its second line is what it says. Topics whose
    number leaves 0 or 1 by three have a card, up to date or of old, and all have other materials of all sorts."""
    docs = B.read(spark, sf_dir, "documents").withColumn("topic_id", F.substring("source", 4, 9).cast("bigint"))
    topics = docs.select("topic_id", F.col("source").alias("name")).distinct()
    part = F.get(F.array(*[F.lit(p) for p in Y.PARTS]), F.expr("cast(length(text) * (1 + topic_id % 2) % 10 as int)"))
    says = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit("nothing."))
    status = F.when(F.col("doc_id") % 11 == 0, "superseded").otherwise("active")
    fields = docs.select(F.col("doc_id").alias("field_id"), "topic_id", part.alias("field_type"), (F.col("doc_id") % 3).alias("ord"), says.alias("text"), status.alias("status"))
    fresh = Y.synthesis_materials(topics, fields, spark.createDataFrame([], "material_id long, topic_id long, type string, payload_json string"), LABELS, PROMPT).where("topic_id % 3 = 0").select("topic_id", "payload_json")
    old = topics.where("topic_id % 3 = 1").select("topic_id", F.lit('{"synthesis": 1, "items": ["a", "b"], "prompt": "old"}').alias("payload_json"))
    cards = fresh.unionByName(old).select((F.col("topic_id") + 1000).alias("material_id"), "topic_id", F.lit("list").alias("type"), "payload_json")
    other = topics.select((F.col("topic_id") + 1).alias("material_id"), "topic_id", F.when(F.col("topic_id") % 2 == 0, "list").otherwise("qa").alias("type"), F.when(F.col("topic_id") % 4 == 0, '{"synthesis"').otherwise('{"synthesis": false, "items": 5}').alias("payload_json"))
    return topics, fields, cards.unionByName(other)


_LABEL = "CASE part " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE part END"
CARDS = f"""WITH d AS (SELECT CAST(substring(source, 4) AS BIGINT) AS topic_id, source, doc_id, text FROM documents),
f AS (SELECT doc_id AS field_id, topic_id, source, length(text) * (1 + topic_id % 2) % 10 AS part_no, doc_id % 3 AS ord, regexp_replace(coalesce(string_split(text, chr(10))[2], 'nothing.'), '\\.$', '') AS says FROM d WHERE doc_id % 11 <> 0),
n AS (SELECT *, ({list(Y.PARTS)!r})[CAST(part_no AS INTEGER) + 1] AS part FROM f),
p AS (SELECT topic_id, source, part_no, part, string_agg(says, '; ' ORDER BY ord, field_id) AS line, arg_min(field_id, ord * 10000000000 + field_id) AS field_id FROM n GROUP BY ALL),
i AS (SELECT *, {_LABEL} || ': ' || CASE WHEN length(line) > 90 THEN rtrim(left(line, 89)) || '…' ELSE line END AS item FROM p),
c AS (SELECT topic_id, any_value(source) AS source, string_agg(item, ' | ' ORDER BY part_no) AS items, list(field_id ORDER BY part_no) AS fields FROM i GROUP BY topic_id HAVING count(*) >= 3)"""


@query(f"""{CARDS} SELECT topic_id, CASE WHEN topic_id % 3 < 2 THEN topic_id + 1000 ELSE -1 END AS material_id, CASE topic_id % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'updated' ELSE 'created' END AS action, '{PROMPT}' || source AS prompt, items FROM c""")
def synthesis_materials(spark, sf_dir):
    out = Y.synthesis_materials(*schema_tables(spark, sf_dir), LABELS, PROMPT)
    return out.select("topic_id", F.coalesce("material_id", F.lit(-1)).alias("material_id"), "action", "prompt", F.array_join("items", " | ").alias("items"))


@query(f"""{CARDS}, u AS (SELECT topic_id, i - 1 AS part, fields[i] AS field_id FROM (SELECT topic_id, fields, unnest(range(1, len(fields) + 1)) AS i FROM c WHERE topic_id % 3 > 0))
SELECT topic_id, CAST(part AS INTEGER) AS part, field_id, min(l_partkey) AS chunk_id FROM u JOIN lineitem ON l_orderkey % 1000 = field_id AND l_quantity <= 25 GROUP BY ALL""")
def synthesis_citations(spark, sf_dir):
    cards = Y.synthesis_materials(*schema_tables(spark, sf_dir), LABELS, PROMPT)
    rows = B.read(spark, sf_dir, "lineitem")
    cited = rows.select(F.when(F.col("l_quantity") > 25, "material").otherwise("topic_field").alias("owner_type"), (F.col("l_orderkey") % 1000).alias("owner_id"), F.col("l_partkey").alias("chunk_id"))
    return Y.synthesis_citations(cards, cited)
