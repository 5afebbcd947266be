"""Queries from chunks to topics: a document's first words name what it is about, its next words are another name for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import quotes as Q
from scriptoria.operators import topics as K
from scriptoria.plans import bindings as B
from scriptoria.plans.registry import query
from scriptoria.plans.text_plans import search_tokens_sql


def mentions(spark, sf_dir):
    words = F.split("text", "[ \n]+")
    part = lambda a: F.array_join(F.slice(words, a, 3), " ")
    docs = B.read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("mention_id"), F.col("source").alias("subject_id"), part(1).alias("name"), F.array(part(4)).alias("aliases"), (F.col("doc_id") % 3 == 0).alias("emphasized"))


def relations(spark, sf_dir):
    """Each document refers to the one 20 ids later, or to itself by its other name."""
    m = mentions(spark, sf_dir)
    later = m.select((F.col("mention_id") - 20).alias("mention_id"), F.lit("distinguish").alias("type"), F.col("name").alias("target"))
    own = m.select("mention_id", F.lit("is_a").alias("type"), F.get("aliases", F.lit(0)).alias("target"))
    return later.unionByName(own)


def fields(spark, sf_dir):
    """A field for each document: the first words of its text, wider apart in every other one, and its second line as quote."""
    lines = F.split("text", "\n")
    text = F.substring("text", 1, 40)
    docs = B.read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("field_id"), (F.col("doc_id") % 7).alias("topic_id"), F.col("lang").alias("field_type"),
        F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit(" "), F.lit("  "))).otherwise(text).alias("text"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("quote"),
    )


NORMAL = lambda text: f"array_to_string({search_tokens_sql(text)}, ' ')"
NAMES = lambda words: f"array_to_string({words}, ' ')"
MENTIONS = f"""w AS (SELECT doc_id, source, string_split_regex(text, '[ \\n]+') AS words FROM documents),
mention AS (SELECT doc_id AS mention_id, source AS subject_id, {NAMES('words[1:3]')} AS name, {NAMES('words[4:6]')} AS alias, doc_id % 3 = 0 AS emphasized FROM w),
label AS (SELECT mention_id, subject_id, {NORMAL('name')} AS label, true AS main FROM mention UNION ALL SELECT mention_id, subject_id, {NORMAL('alias')}, false FROM mention),
named AS (SELECT subject_id, label, bool_or(main) AS main, list_distinct(string_split(label, ' ')) AS tokens FROM label WHERE label <> '' GROUP BY ALL),
near AS (SELECT a.subject_id, a.label, b.label AS other FROM named a JOIN named b ON a.subject_id = b.subject_id AND a.label <> b.label AND (a.main OR b.main)
  AND len(list_intersect(a.tokens, b.tokens)) >= 0.5 * (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)))),
link AS (SELECT DISTINCT x.mention_id AS a, y.mention_id AS b FROM label x JOIN label y ON x.subject_id = y.subject_id AND x.label = y.label AND x.label <> ''
  UNION SELECT x.mention_id, y.mention_id FROM label x JOIN near n ON n.subject_id = x.subject_id AND n.label = x.label JOIN label y ON y.subject_id = n.subject_id AND y.label = n.other),
reach(a, b) AS (SELECT mention_id, mention_id FROM mention UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
resolved AS (SELECT a AS mention_id, min(b) AS topic_id FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {MENTIONS} SELECT * FROM resolved")
def resolved_topics(spark, sf_dir):
    """Every document's topic, by equal and alike names within its source."""
    return K.resolved_topics(mentions(spark, sf_dir))


@query(f"""WITH RECURSIVE {MENTIONS}, t AS (SELECT topic_id, any_value(subject_id) AS subject_id, arg_min(name, mention_id) AS name, count(*) AS mentions, count(*) FILTER (emphasized) AS emphasis FROM mention JOIN resolved USING (mention_id) GROUP BY topic_id),
a AS (SELECT DISTINCT topic_id, alias FROM (SELECT mention_id, name AS alias FROM mention UNION ALL SELECT mention_id, alias FROM mention) JOIN resolved USING (mention_id) WHERE alias <> '')
SELECT t.*, (SELECT count(*) FROM a WHERE a.topic_id = t.topic_id AND {NORMAL('a.alias')} <> {NORMAL('t.name')}) AS aliases FROM t""")
def topic_table(spark, sf_dir):
    m = mentions(spark, sf_dir)
    found = K.resolved_topics(m)
    topics = K.topics_of(m, found)
    aliases = K.topic_aliases(m, found, topics).groupBy("topic_id").agg(F.count("*").alias("aliases"))
    return topics.join(aliases, "topic_id", "left").withColumn("aliases", F.coalesce("aliases", F.lit(0)))


@query(f"""WITH RECURSIVE {MENTIONS}, named_topic AS (SELECT subject_id, label, min(topic_id) AS to_topic FROM label JOIN resolved USING (mention_id) GROUP BY ALL),
r AS (SELECT mention_id - 20 AS mention_id, 'distinguish' AS type, name AS target FROM mention UNION ALL SELECT mention_id, 'is_a', alias FROM mention),
x AS (SELECT q.topic_id AS from_topic, type, m.subject_id, {NORMAL('target')} AS label FROM r JOIN mention m USING (mention_id) JOIN resolved q USING (mention_id) WHERE length(target) BETWEEN 1 AND 120)
SELECT DISTINCT from_topic, type, to_topic, CASE WHEN to_topic IS NULL THEN x.label END AS draft FROM x LEFT JOIN named_topic USING (subject_id, label) WHERE x.label <> '' AND (to_topic IS NULL OR to_topic <> from_topic)""")
def topic_relations(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return K.resolved_relations(relations(spark, sf_dir), m, K.resolved_topics(m))


@query(f"""WITH RECURSIVE {MENTIONS}, named_topic AS (SELECT subject_id, label, min(topic_id) AS to_topic FROM label JOIN resolved USING (mention_id) GROUP BY ALL),
x AS (SELECT q.topic_id AS from_topic, m.subject_id, {NORMAL('other.name')} AS label FROM mention other JOIN mention m ON m.mention_id = other.mention_id - 20 JOIN resolved q ON q.mention_id = m.mention_id WHERE length(other.name) BETWEEN 1 AND 120 AND label <> ''),
r AS (SELECT DISTINCT from_topic, to_topic FROM x JOIN named_topic USING (subject_id, label) WHERE to_topic <> from_topic),
b AS (SELECT from_topic AS topic_id, to_topic AS related_id FROM r UNION SELECT to_topic, from_topic FROM r)
SELECT topic_id, related_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY related_id) AS INTEGER) AS place FROM b) WHERE place <= 2""")
def related_topics(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return K.related_topics(K.resolved_relations(relations(spark, sf_dir), m, K.resolved_topics(m)), "distinguish", 2)


_MATCH = lambda c: f"trim(regexp_replace(regexp_replace(translate(lower({c}), '„”“«»‘’–—−', '\"\"\"\"\"''''---'), '-\\s*\\n\\s*', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH RECURSIVE f AS (SELECT doc_id AS field_id, doc_id % 7 AS topic_id, lang AS field_type, {_MATCH("CASE WHEN doc_id % 2 = 0 THEN replace(substring(text, 1, 40), ' ', '  ') ELSE substring(text, 1, 40) END")} AS t, {_MATCH("coalesce(string_split(text, chr(10))[2], '')")} AS q FROM documents),
l AS (SELECT a.field_id AS a, b.field_id AS b FROM f a JOIN f b ON a.topic_id = b.topic_id AND a.field_type = b.field_type AND a.t = b.t AND a.t <> '' UNION SELECT a.field_id, b.field_id FROM f a JOIN f b ON a.topic_id = b.topic_id AND a.field_type = b.field_type AND a.q = b.q AND a.q <> ''),
reach(a, b) AS (SELECT field_id, field_id FROM f UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b) SELECT a AS field_id, min(b) AS kept_id FROM reach GROUP BY a""")
def merged_fields(spark, sf_dir):
    return K.merged_fields(fields(spark, sf_dir))


FIELD_KINDS = 5


def read_fields(spark, sf_dir):
    """Chunks are the lines of documents. Each document with three lines or more has a field read from its second line: quoted
    word for word, quoted from the third line, across the edge to the first, from nowhere, or with a number that is not there."""
    lines = B.read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    chunks = lines.select(F.posexplode("lines").alias("ord", "text"), "doc_id").select(F.concat_ws("-", "doc_id", "ord").alias("chunk_id"), F.col("doc_id").alias("document"), "ord", "text")
    part = lambda line, a, n: F.array_join(F.slice(F.split(F.get("lines", F.lit(line)), " "), a, n), " ")
    kind, nowhere = F.col("doc_id") % FIELD_KINDS, F.lit("qqxvz kkwyj vvzqx jjwkq xxqzv wwvkj")
    across = F.concat_ws(" ", F.array_join(F.slice(F.reverse(F.split(F.get("lines", F.lit(0)), " ")), 1, 4), " "), part(1, 1, 4))
    quote = F.when(kind == 1, part(2, 1, 8)).when(kind == 2, across).when(kind == 3, nowhere).otherwise(part(1, 2, 8))
    claim = F.when(kind == 4, F.concat_ws(" ", quote, F.lit("987654"))).otherwise(quote)
    fields = lines.where(F.size("lines") >= 3).select(F.col("doc_id").alias("field_id"), F.concat_ws("-", "doc_id", F.lit(1)).alias("chunk_id"), claim.alias("text"), quote.alias("quote"))
    return fields, chunks


@query()
def validated_fields(spark, sf_dir):
    """Every field of read_fields; alignment and passages are beyond SQL, so the cascade is tested row by row on fixtures."""
    return Q.validated_fields(*read_fields(spark, sf_dir))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
f AS (SELECT doc_id, lines[2] AS here, array_to_string(string_split(lines[2], ' ')[2:9], ' ') AS quote, doc_id % 5 AS kind FROM l WHERE len(lines) >= 3 AND len(string_split(lines[2], ' ')) >= 9 AND doc_id % 5 IN (0, 3, 4))
SELECT doc_id AS field_id, CASE WHEN kind <> 3 THEN 'here' END AS place, CASE WHEN kind = 3 THEN 'not found in the source' WHEN kind = 4 THEN 'not in the source: 987654' END AS reason, kind = 0 AS accepted FROM f""")
def validated_fields_exact(spark, sf_dir):
    """The fields quoted word for word or not at all, for which SQL can say what must come out."""
    fields, chunks = read_fields(spark, sf_dir)
    whole = F.size(F.split("text", " ")) >= 9
    fields = fields.where((F.col("field_id") % FIELD_KINDS).isin(0, 3, 4)).join(chunks.where(whole).select("chunk_id"), "chunk_id", "left_semi")
    return Q.validated_fields(fields, chunks).select("field_id", "place", "reason", "accepted")
