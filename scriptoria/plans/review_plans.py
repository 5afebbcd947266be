"""Queries over what waits for people and what comes from outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import external as X
from scriptoria.operators import review as V
from scriptoria.plans import bindings as B
from scriptoria.plans.bindings import TABLES
from scriptoria.plans.registry import query

SOURCES = "chunk AS (SELECT p_partkey AS chunk_id, p_brand AS document, p_size > 20 AS processed FROM part), citation AS (SELECT CASE WHEN l_quantity > 25 THEN 'material' ELSE 'topic_field' END AS owner_type, l_orderkey % 400 AS owner_id, l_partkey AS chunk_id FROM lineitem)"


def chunk(spark, sf_dir):
    return B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document"), (F.col("p_size") > 20).alias("processed"))


def citation(spark, sf_dir):
    rows = B.read(spark, sf_dir, "lineitem")
    return rows.select(F.when(F.col("l_quantity") > 25, "material").otherwise("topic_field").alias("owner_type"), (F.col("l_orderkey") % 400).alias("owner_id"), F.col("l_partkey").alias("chunk_id"))


@query(f"""WITH {TABLES}, {SOURCES}, s AS (SELECT owner_id AS material_id, count(*) AS citations, string_agg(DISTINCT document, ', ' ORDER BY document) AS documents FROM citation JOIN chunk USING (chunk_id) WHERE owner_type = 'material' GROUP BY owner_id)
SELECT material_id, topic_id, status, coalesce(citations, 0) AS citations, coalesce(documents, '') AS documents, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY (status = 'needs_review') DESC, material_id) AS INTEGER) AS place
FROM material LEFT JOIN s USING (material_id) WHERE status IN ('pending', 'needs_review')""")
def review_queue(spark, sf_dir):
    return V.review_queue(B.material(spark, sf_dir), citation(spark, sf_dir), chunk(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id % 300 AS conflict_id, doc_id AS candidate_id, 1 + CAST(substring(source, 4) AS INTEGER) % 4 + doc_id // 300 % 2 AS rank FROM documents), m AS (SELECT *, min(rank) OVER (PARTITION BY conflict_id) AS best FROM c)
SELECT conflict_id, CASE WHEN count(*) = 1 THEN min(candidate_id) END AS hint FROM m WHERE rank = best GROUP BY conflict_id""")
def conflict_hint(spark, sf_dir):
    rank = 1 + F.substring("source", 4, 9).cast("int") % 4 + F.floor(F.col("doc_id") / 300) % 2
    rows = B.read(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("conflict_id"), F.col("doc_id").alias("candidate_id"), rank.alias("rank"))
    return V.conflict_hints(rows)


@query(f"WITH {SOURCES} SELECT document, count(*) AS chunks, count(*) FILTER (processed) AS processed, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM citation)) AS cited FROM chunk GROUP BY document")
def document_stats(spark, sf_dir):
    return V.document_stats(chunk(spark, sf_dir), citation(spark, sf_dir))


@query(f"""WITH {TABLES} SELECT subject_id, name, (SELECT count(*) FROM topic t WHERE t.subject_id = s.subject_id) AS topics, (SELECT count(*) FROM material m JOIN topic t USING (topic_id) WHERE t.subject_id = s.subject_id AND m.status = 'active') AS active,
(SELECT count(*) FROM material m JOIN topic t USING (topic_id) WHERE t.subject_id = s.subject_id AND m.status = 'pending') AS pending,
(SELECT count(*) FROM review_item i JOIN material m USING (material_id) JOIN topic t ON t.topic_id = m.topic_id WHERE t.subject_id = s.subject_id AND m.status = 'active') AS items FROM subject s""")
def subject_stats(spark, sf_dir):
    return V.subject_stats(B.subject(spark, sf_dir), B.topic(spark, sf_dir), B.material(spark, sf_dir), B.review_item(spark, sf_dir))


@query(f"""WITH {TABLES}, e AS (SELECT subject_id, min(date) AS exam FROM exam WHERE date >= DATE '2024-02-10' GROUP BY subject_id)
SELECT subject_id, name, exam, CAST(row_number() OVER (ORDER BY exam ASC NULLS LAST, lower(name)) AS INTEGER) AS place FROM subject LEFT JOIN e USING (subject_id)""")
def subjects_by_exam(spark, sf_dir):
    return V.subjects_by_exam(B.subject(spark, sf_dir), B.exam(spark, sf_dir), F.lit("2024-02-10").cast("date")).select("subject_id", "name", "exam", "place")


@query("""WITH m AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'qa' WHEN 1 THEN 'cloze' WHEN 2 THEN 'list' ELSE 'song' END AS type, CASE WHEN p_size % 3 = 0 THEN 'Omów ' || p_name ELSE p_name END AS q, CASE WHEN p_size % 5 <> 0 THEN p_type END AS a,
CASE WHEN p_size % 7 = 0 THEN '{{c1::' || p_brand || '}}' ELSE p_brand END AS text, p_size % 10 AS n FROM part),
c AS (SELECT *, CASE WHEN type = 'qa' AND a IS NULL THEN 'question or answer is missing' WHEN type = 'cloze' AND text NOT LIKE '{{c1::%' THEN 'no gap' WHEN type = 'list' AND n < 2 THEN 'fewer than two items' WHEN type = 'song' THEN 'unknown type' END AS problem FROM m)
SELECT p_partkey, problem, CASE WHEN problem IS NULL THEN 'valid' ELSE 'invalid' END AS "check", CASE WHEN type = 'qa' AND q LIKE 'Omów%' THEN 'essay question' WHEN type = 'list' AND n > 7 THEN 'many items' ELSE '' END AS warnings FROM c""")
def checked_materials(spark, sf_dir):
    s = F.col("p_size")
    rows = B.read(spark, sf_dir, "part").select(
        "p_partkey", F.when(s % 4 == 0, "qa").when(s % 4 == 1, "cloze").when(s % 4 == 2, "list").otherwise("song").alias("type"),
        F.when(s % 3 == 0, F.concat(F.lit("Omów "), "p_name")).otherwise(F.col("p_name")).alias("q"), F.when(s % 5 != 0, F.col("p_type")).alias("a"),
        F.when(s % 7 == 0, F.concat(F.lit("{{c1::"), "p_brand", F.lit("}}"))).otherwise(F.col("p_brand")).alias("text"), F.lit("list").alias("prompt"), F.array_repeat(F.lit("x"), s % 10).alias("items"),
    )
    return V.checked_materials(rows).select("p_partkey", "problem", "check", F.array_join("warnings", ", ").alias("warnings"))


@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority LIKE '1-%') DESC, o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3""")
def ranked_acts(spark, sf_dir):
    title = F.when(F.col("o_orderpriority").startswith("1-"), "tekst jednolity").otherwise(F.col("o_orderpriority"))
    acts = B.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", title.alias("title"), F.col("o_orderdate").alias("date"))
    return X.ranked_acts(acts, "o_orderkey", ["o_custkey"], 3).select("o_custkey", "o_orderkey", "place")


@query("""WITH l AS (SELECT p_brand AS act, p_partkey AS ord, CASE WHEN p_size % 4 = 0 THEN 'Art. ' || (p_size % 9) || CASE WHEN p_size % 8 = 0 THEN 'a' ELSE '' END || '. ' || p_name ELSE p_name END AS text FROM part),
a AS (SELECT *, CASE WHEN text LIKE 'Art. %' THEN ord END AS s FROM l), r AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY act ORDER BY ord ROWS UNBOUNDED PRECEDING) AS start FROM a),
n AS (SELECT r.act, r.ord, r.text, r.start, regexp_extract(h.text, 'Art\\. (\\d+a?)', 1) AS article FROM r JOIN l h ON h.ord = r.start), f AS (SELECT *, min(start) OVER (PARTITION BY act, article) AS first FROM n)
SELECT act, article, count(*) AS lines, string_agg(text, chr(10) ORDER BY ord) AS text FROM f WHERE start = first GROUP BY act, article""")
def act_articles(spark, sf_dir):
    s = F.col("p_size")
    head = F.concat(F.lit("Art. "), s % 9, F.when(s % 8 == 0, "a").otherwise(""), F.lit(". "), "p_name")
    lines = B.read(spark, sf_dir, "part").select(F.col("p_brand").alias("act"), F.col("p_partkey").alias("ord"), F.when(s % 4 == 0, head).otherwise(F.col("p_name")).alias("text"))
    return X.act_articles(lines, "act", "ord", "text")


@query("""SELECT query, work_id, CAST(row_number() OVER (PARTITION BY query ORDER BY (lang = 'de') DESC, year DESC, work_id) AS INTEGER) AS place FROM (SELECT source AS query, doc_id AS work_id, lang, 2000 + doc_id % 25 AS year FROM documents WHERE length(text) > 80)""")
def papers(spark, sf_dir):
    works = B.read(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("work_id"), (F.col("lang") == "de").alias("home"), (2000 + F.col("doc_id") % 25).alias("year"), F.col("text").alias("abstract"))
    return X.papers(works).select("query", "work_id", "place")
