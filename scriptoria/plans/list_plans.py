"""Queries for lists: articles found and missing, lectures with untried materials, settings over defaults, names in two tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import external as X
from scriptoria.operators import review as V
from scriptoria.operators import search as S
from scriptoria.plans import bindings as B
from scriptoria.plans.bindings import TABLES
from scriptoria.plans.registry import query
from scriptoria.plans.review_plans import SOURCES, chunk, citation
from scriptoria.plans.text_plans import search_tokens_sql


@query("""WITH l AS (SELECT p_brand AS act, p_partkey AS ord, CASE WHEN p_size % 4 = 0 THEN 'Art. ' || (p_size % 9) || CASE WHEN p_size % 8 = 0 THEN 'a' ELSE '' END || '. ' || p_name ELSE p_name END AS text FROM part),
a AS (SELECT *, max(CASE WHEN text LIKE 'Art. %' THEN ord END) OVER (PARTITION BY act ORDER BY ord) AS start FROM l), n AS (SELECT a.act, a.start, regexp_extract(h.text, 'Art\\. (\\d+a?)', 1) AS article, a.ord, a.text FROM a JOIN l h ON h.ord = a.start),
f AS (SELECT act, article, string_agg(text, chr(10) ORDER BY ord) AS text FROM (SELECT *, min(start) OVER (PARTITION BY act, article) AS first FROM n) WHERE start = first GROUP BY act, article),
w AS (SELECT DISTINCT 'Brand#' || o_custkey % 30 AS act, CAST(o_orderkey % 12 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN 'a' ELSE '' END AS article FROM orders)
SELECT act, article, f.text IS NOT NULL AS found, coalesce(f.text, '') AS text FROM w LEFT JOIN f USING (act, article)""")
def articles_found(spark, sf_dir):
    """Articles that orders ask for, in several spellings, of acts that are made of parts."""
    s = F.col("p_size")
    head = F.concat(F.lit("Art. "), s % 9, F.when(s % 8 == 0, "a").otherwise(""), F.lit(". "), "p_name")
    lines = B.read(spark, sf_dir, "part").select(F.col("p_brand").alias("act"), F.col("p_partkey").alias("ord"), F.when(s % 4 == 0, head).otherwise(F.col("p_name")).alias("text"))
    o = F.col("o_orderkey")
    number = F.concat(F.when(o % 2 == 0, "Art. ").otherwise(""), (o % 12).cast("string"), F.when(o % 5 == 0, F.when(o % 3 == 0, "A").otherwise("a")).otherwise(""), F.when(o % 7 == 0, ".").otherwise(""))
    wanted = B.read(spark, sf_dir, "orders").select(F.concat(F.lit("Brand#"), F.col("o_custkey") % 30).alias("act"), number.alias("article"))
    out = X.wanted_articles(X.act_articles(lines, "act", "ord", "text"), wanted, "act")
    return out.withColumn("text", F.coalesce("text", F.lit("")))


@query(f"""WITH {TABLES}, {SOURCES}, d AS (SELECT DISTINCT p_brand AS document, CASE WHEN CAST(substring(p_brand, 7) AS INTEGER) % 4 <> 0 THEN 'note' ELSE 'act' END AS kind, DATE '2024-01-31' - CAST(substring(p_brand, 7) AS INTEGER) % 3 AS day FROM part)
SELECT document, strftime(day, '%Y-%m-%d') AS lecture_date, count(DISTINCT material_id) AS fresh FROM d JOIN chunk USING (document) JOIN citation USING (chunk_id) JOIN material m ON m.material_id = owner_id
WHERE kind = 'note' AND day >= DATE '2024-01-30' AND owner_type = 'material' AND m.status = 'active' AND NOT m.synthesis AND NOT EXISTS (SELECT 1 FROM review_item i WHERE i.material_id = m.material_id AND reps > 0) GROUP BY ALL""")
def untried_by_lecture(spark, sf_dir):
    number = F.substring("p_brand", 7, 9).cast("int")
    docs = B.read(spark, sf_dir, "part").select(F.col("p_brand").alias("document"), F.when(number % 4 != 0, "note").otherwise("act").alias("kind"), F.date_sub(F.lit("2024-01-31").cast("date"), number % 3).alias("lecture_date")).distinct()
    return V.untried_by_lecture(docs, chunk(spark, sf_dir), citation(spark, sf_dir), B.material(spark, sf_dir), B.review_item(spark, sf_dir), F.lit("2024-01-31").cast("date")).withColumn("lecture_date", F.col("lecture_date").cast("string"))


DEFAULTS = {"newPerDay": "10", "interleave": "true", "ai.model": '"small"', "ai.window": "8192"}


@query("""WITH s AS (SELECT c_custkey AS profile, c_custkey % 6 AS kind, c_nationkey AS n FROM customer),
d(key, usual) AS (VALUES ('newPerDay', '10'), ('interleave', 'true'), ('ai.model', '"small"'), ('ai.window', '8192')),
o AS (SELECT profile, key, CASE WHEN key = 'newPerDay' AND kind = 0 THEN CAST(n AS VARCHAR) WHEN key = 'ai.window' AND kind = 2 THEN CAST(n * 100 AS VARCHAR) WHEN key = 'ai.model' AND kind = 3 THEN '"m' || n || '"' WHEN key = 'interleave' AND kind = 5 THEN 'false' END AS mine, usual FROM s, d)
SELECT profile, key, coalesce(mine, usual) AS value, mine IS NOT NULL AS own FROM o""")
def merged_settings(spark, sf_dir):
    """Customers as profiles, each with one stored row: a number, no JSON, an object with one field, an unknown key and so on."""
    kind, n = F.col("c_custkey") % 6, F.col("c_nationkey").cast("string")
    key = F.when(kind < 2, "newPerDay").when(kind < 4, "ai").when(kind == 4, "unknown").otherwise("interleave")
    value = (
        F.when(kind == 0, n).when(kind == 1, "{broken").when(kind == 2, F.concat(F.lit('{"window": '), (F.col("c_nationkey") * 100).cast("string"), F.lit(', "more": [1]}')))
        .when(kind == 3, F.concat(F.lit('{"model": "m'), n, F.lit('"}'))).when(kind == 4, "5").otherwise("false")
    )
    stored = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile"), key.alias("key"), value.alias("value_json"))
    return V.merged_settings(stored, DEFAULTS)


_N = lambda words: f"array_to_string({search_tokens_sql(words)}, ' ')"


@query(f"""WITH w AS (SELECT doc_id, lang, string_split_regex(text, '[ \\n]+') AS words FROM documents), n AS (SELECT doc_id, lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[3:4], ' ')]) AS name FROM w),
k AS (SELECT doc_id, lang, {_N('name')} AS name FROM n WHERE {_N('name')} <> '')
SELECT a.doc_id, min(b.doc_id) AS same_id FROM k a JOIN k b USING (name) WHERE a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 GROUP BY a.doc_id""")
def alias_matches(spark, sf_dir):
    """For each odd document the first even one that shares a name with it: its first two words or the next two."""
    words = F.split("text", "[ \n]+")
    part = lambda a: F.array_join(F.slice(words, a, 2), " ")
    rows = B.read(spark, sf_dir, "documents").select("doc_id", "lang", F.array(part(1), part(3)).alias("names"))
    found = S.same_names(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "same_id"), "doc_id", "same_id", "names")
    return found.select("doc_id", "same_id")
