"""Queries over printed pages, made of documents, and over lists drawn by a seed."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import pages as G
from scriptoria.plans import bindings as B
from scriptoria.plans.registry import query


def glyphs(spark, sf_dir):
    """Sources are books, documents their pages: lines 12 points apart, empty ones too, every fifth page with its first line in a
    large type, a head with the book's name, and at the foot the page's number and 5, but on every seventh page another one."""
    docs = B.read(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.expr("cast(doc_id div 20 + 1 as int)").alias("page"), F.split("text", "\n").alias("lines"))
    line = docs.select("book", "page", F.posexplode("lines").alias("n", "str"))
    large = (F.col("n") == 0) & (F.col("page") % 5 == 0)
    text = line.select("book", "page", (5000.0 - 12 * F.col("n")).alias("y"), F.lit(10.0).alias("x"), F.when(large, 14.0).otherwise(10.0).alias("size"), F.substring("str", 1, 100).alias("str"))
    foot = F.least(F.lit(-4990.0), 4980.0 - 12 * F.size("lines"))  # below the lines, however many there are
    extra = lambda y, s: docs.select("book", "page", y.alias("y"), F.lit(10.0).alias("x"), F.lit(8.0).alias("size"), s.alias("str"))
    number = F.when(F.col("page") % 7 == 0, F.col("page") + 90).otherwise(F.col("page") + 5).cast("string")
    heads = extra(F.lit(5100.0), F.concat(F.lit("The book "), "book")).unionByName(extra(F.lit(5090.0), F.lit("Part 1"))).unionByName(extra(foot - 10, number)).unionByName(extra(foot, F.lit("All rights reserved")))
    return text.unionByName(heads)


@query("""WITH d AS (SELECT source AS book, CAST(doc_id // 20 + 1 AS INTEGER) AS page, string_split(text, chr(10)) AS xs FROM documents),
l AS (SELECT book, page, i - 1 AS n, trim(regexp_replace(substring(xs[i], 1, 100), '\\s+', ' ', 'g')) AS text FROM (SELECT book, page, xs, unnest(range(1, len(xs) + 1)) AS i FROM d)),
k AS (SELECT *, n = 0 AND page % 5 = 0 AND length(text) < 120 AS head FROM l WHERE text <> ''),
b AS (SELECT *, lag(page) OVER w AS p0, lag(n) OVER w AS n0, lag(text) OVER w AS t0, lag(head) OVER w AS h0 FROM k WINDOW w AS (PARTITION BY book ORDER BY page, n)),
f AS (SELECT *, CASE WHEN h0 IS NULL OR h0 <> head THEN 1 WHEN head THEN 0 WHEN p0 = page AND (n - n0) * 12 > CASE WHEN n = 0 AND page % 5 = 0 THEN 14 ELSE 10 END * 1.9 THEN 1 WHEN regexp_matches(t0, '[.:;]$') AND length(t0) < 55 THEN 1 ELSE 0 END AS begins FROM b),
o AS (SELECT *, sum(begins) OVER (PARTITION BY book ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS ord FROM f)
SELECT book, CAST(ord AS INTEGER) AS ord, CASE WHEN bool_or(head) THEN 'heading' ELSE 'para' END AS kind, CAST(CASE WHEN bool_or(head) THEN 1 ELSE 0 END AS INTEGER) AS level, CAST(min(page) + 5 AS INTEGER) AS page,
CASE WHEN bool_or(head) THEN string_agg(text, ' ' ORDER BY page, n) ELSE list_reduce(list(text ORDER BY page, n), lambda a, t: CASE WHEN a LIKE '%-' AND regexp_matches(t, '^[a-ząćęłńóśźż]') THEN left(a, length(a) - 1) || t ELSE a || ' ' || t END) END AS text
FROM o GROUP BY book, ord""")
def page_blocks(spark, sf_dir):
    return G.page_blocks(glyphs(spark, sf_dir), "book").withColumn("level", F.coalesce("level", F.lit(0)))


@query("""WITH RECURSIVE p AS (SELECT p_brand, CAST(substring(p_brand, 7) AS BIGINT) AS seed, list(DISTINCT p_name ORDER BY p_name) AS pool, list(DISTINCT p_name) FILTER (p_size > 47) AS avoid FROM part GROUP BY p_brand),
q AS (SELECT p_brand, seed, pool, list_filter(pool, lambda w: NOT coalesce(list_contains(avoid, w), false)) AS fresh FROM p),
s(p_brand, i, x, a) AS (SELECT p_brand, len(CASE WHEN len(fresh) >= 10 THEN fresh ELSE pool END) - 1, CASE WHEN seed = 0 THEN 1 ELSE seed END, CASE WHEN len(fresh) >= 10 THEN fresh ELSE pool END FROM q
  UNION ALL SELECT p_brand, i - 1, y, list_transform(a, lambda v, k: CASE WHEN k = i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[i + 1] ELSE v END) FROM (
    SELECT p_brand, i, y, a, least(CAST(floor(y / 2147483647.0::DOUBLE * (i + 1)) AS BIGINT), i) AS j FROM (SELECT p_brand, i, a, CAST(CAST(x AS DOUBLE) * 1103515245::DOUBLE + 12345::DOUBLE AS BIGINT) & 2147483647 AS y FROM s WHERE i > 0)))
SELECT p_brand, array_to_string(a[1:10], ', ') AS names FROM s WHERE i <= 0""")
def drawn_names(spark, sf_dir):
    """Ten part names of each brand in an order that the brand's number fixes, without those of large parts."""
    by = B.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("pool"), F.collect_set(F.when(F.col("p_size") > 47, F.col("p_name"))).alias("avoid"))
    return by.select("p_brand", F.array_join(T.drawn(F.col("pool"), 10, F.substring("p_brand", 7, 9).cast("bigint"), F.col("avoid")), ", ").alias("names"))
