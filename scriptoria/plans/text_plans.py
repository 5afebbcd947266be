"""Queries over texts and pages: tokens, search, likeness, provisions, passages, blocks, chunks, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import etl as E
from scriptoria.operators import quotes as Q
from scriptoria.operators import search as S
from scriptoria.plans import bindings as B
from scriptoria.plans.registry import query

STOPS = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOP_WORDS)) + "]"
FOLD = "strip_accents(lower({}))"


def search_tokens_sql(text: str) -> str:
    words = f"regexp_extract_all({FOLD.format(text)}, '[a-z0-9§]+')"
    kept = f"list_filter({words}, lambda t: NOT list_contains({STOPS}, t) AND (length(t) > 1 OR regexp_matches(t, '[0-9]')))"
    return f"list_transform({kept}, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN t ELSE substring(t, 1, 6) END)"


def docs(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ' ') AS terms FROM (SELECT doc_id, {search_tokens_sql('text')} AS tokens FROM documents)")
def tokenize_terms(spark, sf_dir):
    tokens = docs(spark, sf_dir).select("doc_id", T.search_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("terms"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({search_tokens_sql('text')}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, sf_dir):
    return S.document_frequency(docs(spark, sf_dir), "text")


@query(f"""WITH d AS (SELECT doc_id, {search_tokens_sql('text')} AS tokens FROM documents), c AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({search_tokens_sql('text')}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 3""")
def bm25_topk(spark, sf_dir):
    found = S.bm25_top(docs(spark, sf_dir), B.read(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 3)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH t AS (SELECT p_partkey, list_sort(list_distinct({search_tokens_sql("p_type || ' ' || p_brand")})) AS tokens FROM part),
n AS (SELECT tokens, min(p_partkey) AS first_id, count(*) AS n_rows FROM t WHERE len(tokens) > 0 GROUP BY tokens),
s AS (SELECT a.first_id, b.first_id AS other_id, a.n_rows, b.n_rows AS other_rows, len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) AS score FROM n a JOIN n b ON a.first_id < b.first_id)
SELECT first_id, other_id, n_rows, other_rows, round(score, 6) AS score FROM s WHERE score >= 0.5""")
def jaccard_similar_pairs(spark, sf_dir):
    """All pairs of similar part names, each name by the smallest part that has it."""
    parts = B.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    return S.similar_classes(parts, "p_partkey", "name", 0.5).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT p_partkey, list_sort(list_distinct({search_tokens_sql("p_type || ' ' || p_brand")})) AS tokens FROM part), n AS (SELECT DISTINCT tokens FROM t WHERE len(tokens) > 0),
s AS (SELECT a.tokens, b.tokens AS others, len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) AS score FROM n a, n b),
p AS (SELECT t.p_partkey, o.p_partkey AS other_id, score FROM s JOIN t USING (tokens) JOIN t o ON o.tokens = s.others WHERE score >= 0.5 AND o.p_partkey <> t.p_partkey)
SELECT p_partkey, other_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other_id) AS INTEGER) AS rank FROM p) WHERE rank <= 3""")
def jaccard_similar_all(spark, sf_dir):
    """Every part's name against all other parts."""
    parts = B.read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    return S.similar_among(parts, "p_partkey", "name").withColumn("score", F.round("score", 6))


CLAIM = """'art. ' || (o_orderkey % 900 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN '–' || (o_orderkey % 900 + 1 + o_orderkey % 4) ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ' § ' || (o_orderkey % 7 + 1) ELSE '' END
|| CASE WHEN o_orderkey % 5 = 0 THEN ' pkt ' || (o_orderkey % 4 + 1) ELSE '' END || CASE o_orderkey % 4 WHEN 0 THEN ' k.c.' WHEN 1 THEN ' kpc' WHEN 2 THEN ' Konstytucji RP' ELSE '' END
|| ', termin ' || CASE o_orderkey % 3 WHEN 0 THEN 'lat dwudziestu' WHEN 1 THEN (o_orderkey % 50) || ' dni' ELSE (o_orderkey % 9) || ',5 roku' END"""
SOURCE = """'art. ' || (o_orderkey % 900 + 1 + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) || CASE WHEN o_orderkey % 4 = 0 THEN ' § ' || (o_orderkey % 5 + 1) ELSE '' END || CASE WHEN o_orderkey % 8 < 4 THEN ' k.c.' ELSE '' END || ', termin 20 lat albo ' || (o_orderkey % 40) || ' dni'"""


def claims(spark, sf_dir):
    return B.read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{CLAIM} AS claim", f"{SOURCE} AS source")


def provisions_sql(name: str, key: str, text: str, table: str) -> str:
    """Provisions of a text that has one reference, in rows; written for one match with its parts taken apart."""
    re_ = r"art\.\s*(\d+)(?:–(\d+))?(?:\s*§\s*(\d+))?(?:\s*pkt\s*(\d+))?(?:\s+(k\.c\.|kpc|Konstytucji RP))?"
    g = lambda i: f"regexp_extract({text}, '{re_}', {i})"
    return f"""{name} AS (SELECT {key}, CAST(a AS VARCHAR) AS article, nullif(paragraph, '') AS paragraph, nullif(point, '') AS point,
  CASE WHEN act LIKE 'Konst%' THEN 'konst' ELSE replace(lower(act), '.', '') END AS act, raw FROM (
  SELECT {key}, unnest(CASE WHEN l = '' THEN [CAST(f AS INTEGER)] WHEN CAST(l AS INTEGER) > CAST(f AS INTEGER) THEN range(CAST(f AS INTEGER), CAST(l AS INTEGER) + 1) ELSE [CAST(f AS INTEGER), CAST(l AS INTEGER)] END) AS a, paragraph, point, act, raw
  FROM (SELECT {key}, {g(1)} AS f, {g(2)} AS l, {g(3)} AS paragraph, {g(4)} AS point, {g(5)} AS act, {g(0)} AS raw FROM {table})))"""


@query(f"""WITH c AS (SELECT o_orderkey, {CLAIM} AS claim FROM orders), {provisions_sql('p', 'o_orderkey', 'claim', 'c')}
SELECT o_orderkey, article, paragraph, point, act, raw, act || ':' || article || coalesce('§' || paragraph, '') || coalesce('pkt' || point, '') AS key FROM p""")
def provisions(spark, sf_dir):
    rows = claims(spark, sf_dir).select("o_orderkey", F.explode(T.provisions(F.col("claim"))).alias("p"))
    return rows.select("o_orderkey", "p.*", T.provision_key(F.col("p")).alias("key"))


@query(f"""WITH c AS (SELECT o_orderkey, {CLAIM} AS claim, {SOURCE} AS source FROM orders), {provisions_sql('p', 'o_orderkey', 'claim', 'c')}, {provisions_sql('s', 'o_orderkey', 'source', 'c')}
SELECT p.act, p.article, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.article = p.article AND s.act = p.act) GROUP BY p.act, p.article""")
def provision_gaps(spark, sf_dir):
    """Provisions that claims name and no source covers, over the whole collection."""
    rows = claims(spark, sf_dir)
    named = lambda c: rows.select(F.explode(T.provisions(F.col(c))).alias("p")).select("p.act", "p.article")
    return named("claim").join(named("source").distinct(), ["act", "article"], "left_anti").groupBy("act", "article").agg(F.count("*").alias("n"))


WORD_NUMBERS = "CASE WHEN claim LIKE '%dwudziestu%' THEN ['20'] ELSE [] END"


@query(f"""WITH c AS (SELECT o_orderkey, {CLAIM} AS claim FROM orders) SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(claim, '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')), {WORD_NUMBERS}))), ' ') AS numbers FROM c""")
def numbers(spark, sf_dir):
    return claims(spark, sf_dir).select("o_orderkey", F.array_join(F.array_sort(T.numbers(F.col("claim"))), " ").alias("numbers"))


@query(f"""WITH c AS (SELECT o_orderkey, {CLAIM} AS claim, {SOURCE} AS source FROM orders), {provisions_sql('p', 'o_orderkey', 'claim', 'c')}, {provisions_sql('s', 'o_orderkey', 'source', 'c')},
bad AS (SELECT o_orderkey, raw AS fact FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = p.o_orderkey AND s.article = p.article AND (s.paragraph IS NULL OR p.paragraph IS NULL OR s.paragraph = p.paragraph)
    AND (s.point IS NULL OR p.point IS NULL OR s.point = p.point) AND (s.act = '' OR p.act = '' OR s.act = p.act))
  UNION SELECT o_orderkey, n FROM (SELECT o_orderkey, source, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(regexp_replace(claim, '^.*, termin', ''), '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')), {WORD_NUMBERS}))) AS n FROM c)
    WHERE NOT list_contains(regexp_extract_all(source, '\\d+'), n))
SELECT o_orderkey, fact FROM bad""")
def unsupported_facts(spark, sf_dir):
    return claims(spark, sf_dir).select("o_orderkey", F.explode(T.unsupported_facts(F.col("claim"), F.col("source"))).alias("fact"))


BARE, FACTLESS = r"(?i)\bart\.\s*\d+[a-z]*(\s*§\s*\d+)?", r"(?i)\bart\.\s*\d+[a-z]*(\s*§\s*\d+[a-z]?)?(\s*(pkt|ust\.)\s*\d+)?"


@query(f"""WITH c AS (SELECT o_orderkey, o_custkey AS topic_id, o_orderstatus AS field_type, o_orderkey % 50 AS document_id, {CLAIM} AS claim FROM orders), {provisions_sql('p', 'o_orderkey', 'claim', 'c')},
k AS (SELECT o_orderkey, list_sort(list(act || ':' || article || coalesce('§' || paragraph, '') || coalesce('pkt' || point, ''))) AS keys FROM p GROUP BY o_orderkey),
w AS (SELECT o_orderkey, topic_id, field_type, document_id, coalesce(keys, []) AS keys, list_distinct(list_filter({search_tokens_sql(f"regexp_replace(claim, '{BARE}', ' ', 'g')")}, lambda t: NOT regexp_matches(t, '^[0-9]') AND t <> '§')) AS words,
  list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(regexp_replace(claim, '{FACTLESS}', ' ', 'g'), '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')), {WORD_NUMBERS}))) AS numbers FROM c LEFT JOIN k USING (o_orderkey))
SELECT a.topic_id, a.field_type, a.o_orderkey AS claim_id, b.o_orderkey AS other_id, CASE WHEN a.keys <> b.keys THEN 'provision_number' ELSE 'content' END AS kind
FROM w a JOIN w b ON a.topic_id = b.topic_id AND a.field_type = b.field_type AND a.o_orderkey < b.o_orderkey AND a.document_id <> b.document_id
WHERE len(a.words) > 0 AND len(b.words) > 0 AND (a.keys <> b.keys OR a.numbers <> b.numbers) AND len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) >= 0.8""")
def conflict_pairs(spark, sf_dir):
    """Claims of one topic and part, from different documents, that use the same words and state different facts."""
    rows = B.read(spark, sf_dir, "orders").selectExpr("o_custkey AS topic_id", "o_orderstatus AS field_type", "o_orderkey AS claim_id", "o_orderkey % 50 AS document_id", f"{CLAIM} AS text")
    return S.conflicting_claims(rows)


CONTENT = "[" + ", ".join(f"'{w}'" for w in sorted({w.translate(str.maketrans(T.MARKED, T.PLAIN)) for w in T.CONTENT_STOP_WORDS})) + "]"
CUT5 = "CASE WHEN regexp_matches(t, '^[0-9]') THEN t ELSE substring(t, 1, 5) END"


def stems_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all({FOLD.format(text)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: {CUT5})"


CLOSEST_PAIRS = "SELECT a.conv_id, a.turn, a.text AS claim, b.text AS source FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1"


def closest_sql(keys: str, pair: str) -> str:
    return f"""WITH pair AS ({pair}),
want AS (SELECT {keys}, list_distinct(list_transform(list_filter(regexp_extract_all({FOLD.format('claim')}, '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 AND NOT list_contains({CONTENT}, t)), lambda t: {CUT5})) AS want FROM pair),
parts AS (SELECT {keys}, list_filter(regexp_extract_all(source, '[^.!?;\\n]+(?:[.!?;]+|$)'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')) <> '') AS parts FROM pair),
one AS (SELECT {keys}, parts[i] AS passage, 2 * i AS place, 0.0 AS less FROM (SELECT {keys}, parts, unnest(range(1, len(parts) + 1)) AS i FROM parts)),
two AS (SELECT {keys}, parts[i] || parts[i + 1] AS passage, 2 * i + 1 AS place, 0.05 AS less FROM (SELECT {keys}, parts, unnest(range(1, len(parts))) AS i FROM parts)),
scored AS (SELECT {keys}, passage, place, len(list_intersect(want, list_distinct({stems_sql('passage')}))) / len(want) - less AS score FROM (FROM one UNION ALL FROM two) JOIN want USING ({keys}) WHERE len(want) >= 3)
SELECT {keys}, round(greatest(score, 0), 6) AS score, trim(regexp_replace(passage, '\\s+', ' ', 'g')) AS passage FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, place) AS rank FROM scored) WHERE rank = 1"""


@query(closest_sql("conv_id, turn", CLOSEST_PAIRS))
def closest_passage(spark, sf_dir):
    """Each turn of a conversation against the turn before it."""
    c = B.read(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    rows = c.select("conv_id", "turn", F.col("text").alias("claim")).join(before, ["conv_id", "turn"])
    rows = rows.select("conv_id", "turn", T.closest_passage(F.col("claim"), F.col("source")).alias("p"))
    return rows.where("p is not null").select("conv_id", "turn", F.round("p.score", 6).alias("score"), "p.passage")


@query(f"SELECT * FROM ({closest_sql('o_orderkey', f'SELECT o_orderkey, {CLAIM} AS claim, {SOURCE} AS source FROM orders')}) WHERE score >= 0.7")
def supporting_passage(spark, sf_dir):
    """The closest passage where it has seven tenths of the claim's stems."""
    rows = claims(spark, sf_dir).select("o_orderkey", T.closest_passage(F.col("claim"), F.col("source")).alias("p"))
    return rows.where("p.score >= 0.7 - 1e-9").select("o_orderkey", F.round("p.score", 6).alias("score"), "p.passage")


@query()
def closest_passage_all(spark, sf_dir):
    """Each benchmark item's closest passage in all documents; pairs are too many for SQL, so it is tested by brute force."""
    found = S.closest_passages(B.read(spark, sf_dir, "benchmark"), docs(spark, sf_dir), "item_id", "doc_id", "text")
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "passage")


@query()
def locate_quote(spark, sf_dir):
    """Benchmark passages located in all documents, word for word or nearly; needs alignment, so no SQL."""
    return Q.located_quotes(B.read(spark, sf_dir, "benchmark"), docs(spark, sf_dir), "item_id", "doc_id", "text")


@query("""WITH w AS (SELECT n_nationkey, n_name AS expected, CASE n_nationkey % 5 WHEN 0 THEN lower(n_name) WHEN 1 THEN substring(n_name, 1, length(n_name) - 1) WHEN 2 THEN n_name || 'XY' WHEN 3 THEN reverse(n_name) ELSE 'é' || n_name END AS answer FROM nation),
f AS (SELECT n_nationkey, trim(regexp_replace(regexp_replace(strip_accents(lower(expected)), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS e, trim(regexp_replace(regexp_replace(strip_accents(lower(answer)), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS a FROM w)
SELECT n_nationkey, CASE WHEN a = '' THEN false WHEN e = a THEN true WHEN length(e) <= 4 THEN false ELSE (length(e) >= 6 AND length(a) >= 6 AND substring(e, 1, 5) = substring(a, 1, 5)) OR levenshtein(e, a) <= CASE WHEN length(e) >= 8 THEN 2 ELSE 1 END END AS same FROM f""")
def fuzzy_same_word(spark, sf_dir):
    n, name = F.col("n_nationkey") % 5, F.col("n_name")
    answer = F.when(n == 0, F.lower(name)).when(n == 1, F.expr("substring(n_name, 1, length(n_name) - 1)")).when(n == 2, F.concat(name, F.lit("XY"))).when(n == 3, F.reverse(name)).otherwise(F.concat(F.lit("é"), name))
    return B.read(spark, sf_dir, "nation").select("n_nationkey", T.same_word(name, answer).alias("same"))


# The names again, apart from the operator's.
NAMED_SQL = "MAP {'amp': '&', 'lt': '<', 'gt': '>', 'quot': '\"', 'apos': '''', 'nbsp': ' ', 'sect': '§', 'ndash': '–', 'mdash': '—', 'bdquo': '„', 'rdquo': '”', 'ldquo': '“'}"


def decoded_sql(text: str) -> str:
    number = "CASE WHEN regexp_matches(x, '^&#[xX]') THEN CAST('0x' || substring(x, 4, length(x) - 4) AS BIGINT) ELSE CAST(substring(x, 3, length(x) - 3) AS BIGINT) END"
    one = f"CASE WHEN regexp_matches(x, '^&#([xX][0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});$') THEN chr(CAST({number} AS INTEGER)) WHEN regexp_matches(x, '^&[A-Za-z]+;$') THEN coalesce({NAMED_SQL}[lower(x[2:-2])], x) ELSE x END"
    pieces = f"regexp_extract_all({text}, '&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);|[^&]+|&')"
    return f"trim(regexp_replace(array_to_string(list_transform({pieces}, lambda x: {one}), ''), '\\s+', ' ', 'g'))"


def body_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for tag in E.DROPPED_TAGS:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    return f"regexp_replace({out}, '(?i)<br\\s*/?>', ' ', 'g')"


@query(f"""WITH m AS (SELECT page_id, string_split(regexp_replace({body_sql('html')}, '(?i)<(/?)({E.BLOCK_TAGS}|{E.END_TAGS})\\b[^>]*>', chr(1) || '\\1\\2' || chr(2), 'g'), chr(1)) AS parts FROM pages),
p AS (SELECT page_id, i - 1 AS ord, parts[i] AS part FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM m))
SELECT page_id, CAST(ord AS INTEGER) AS ord, lower(string_split(part, chr(2))[1]) AS tag, {decoded_sql("regexp_replace(substring(part, strpos(part, chr(2)) + 1), '<[^>]+>', '', 'g')")} AS text FROM p
WHERE regexp_matches(part, '(?i)^({E.BLOCK_TAGS})' || chr(2)) AND {decoded_sql("regexp_replace(substring(part, strpos(part, chr(2)) + 1), '<[^>]+>', '', 'g')")} <> ''""")
def html_blocks(spark, sf_dir):
    return E.html_blocks(B.read(spark, sf_dir, "pages"), "page_id", "html")


@query(f"""SELECT page_id, nullif({decoded_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title FROM pages""")
def html_title(spark, sf_dir):
    return B.read(spark, sf_dir, "pages").select("page_id", E.html_title(F.col("html")).alias("title"))


@query()
def text_blocks(spark, sf_dir):
    """Blocks of every document as plain text; the heading rule needs look-ahead, so it is tested on fixtures."""
    return E.text_blocks(docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("ord.part").alias("part"), F.col("ord.at").alias("at"), "kind", "level", "text")


@query()
def chunks(spark, sf_dir):
    """Chunks of every document; the packing is tested on fixtures."""
    return E.chunk_blocks(E.text_blocks(docs(spark, sf_dir), "doc_id", "text"), "doc_id").select("doc_id", "ord", F.size("heading_path").alias("depth"), "text_hash", F.length("text").alias("n_chars"))


HASH = "sha256(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))))"


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, {HASH.format('line')} AS text_hash, count(*) AS n, max(length(line)) AS longest FROM l GROUP BY ALL")
def chunk_hashes(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", T.content_hash(F.col("line")).alias("text_hash")).agg(F.count("*").alias("n"), F.max(F.length("line")).cast("bigint").alias("longest"))


@query(f"""SELECT doc_id, {HASH.format('text')} AS text_hash, min(doc_id) OVER (PARTITION BY {HASH.format('text')}) AS first_id, count(*) OVER (PARTITION BY {HASH.format('text')}) AS copies FROM documents""")
def exact_duplicates(spark, sf_dir):
    return E.exact_duplicates(docs(spark, sf_dir), "doc_id", "text")


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents), o AS (SELECT doc_id, {HASH.format('xs[i]')} AS h, i FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM l)),
n AS (SELECT doc_id, h, i + 1 AS i FROM o JOIN l USING (doc_id) WHERE i < len(xs) UNION ALL SELECT doc_id, {HASH.format("'note ' || doc_id")}, 0 FROM l WHERE doc_id % 2 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS k FROM n),
r AS (SELECT doc_id, CASE WHEN a.i IS NULL THEN 'inserted' WHEN b.i IS NULL THEN CASE WHEN doc_id % 5 = 0 THEN 'retired' ELSE 'dropped' END ELSE 'reused' END AS action FROM a FULL JOIN b USING (doc_id, h, k))
SELECT doc_id, action, count(*) AS n FROM r GROUP BY doc_id, action""")
def reimport_diff(spark, sf_dir):
    """Lines as chunks; the new version begins with a note in every other document and lacks the last line."""
    lines = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("xs"))
    old = lines.select("doc_id", F.posexplode("xs").alias("ord", "line")).select("doc_id", "ord", T.content_hash(F.col("line")).alias("text_hash"), F.concat_ws(":", "doc_id", "ord").alias("chunk_id"))
    kept = F.slice("xs", F.lit(1), F.size("xs") - 1)
    note = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("note "), "doc_id"))).otherwise(F.array().cast("array<string>"))
    new = lines.select("doc_id", F.posexplode(F.concat(note, kept)).alias("ord", "line")).select("doc_id", "ord", T.content_hash(F.col("line")).alias("text_hash"))
    cited = old.where(F.col("doc_id") % 5 == 0).select("chunk_id")
    return E.version_diff(old, new, "doc_id", cited).groupBy("doc_id", "action").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT p_partkey, '{{c' || (p_size % 12) || '::' || p_brand || '}} i {{c' || (p_size % 3) || '::' || p_type || '::' || p_name || '}} oraz {{c' || (p_size % 12) || '::x}}' AS text FROM part),
k AS (SELECT p_partkey, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\{\\{c(\\d+)::', 1), lambda n: CAST(n AS INTEGER)))) AS ns, text FROM t)
SELECT p_partkey, array_to_string(list_transform(ns, lambda n: 'c' || n), ' ') AS keys, regexp_replace(text, '\\{\\{c(\\d+)::(.*?)(?:::(.*?))?\\}\\}', '[\\2]', 'g') AS filled FROM k""")
def cloze_units(spark, sf_dir):
    text = F.expr("'{{c' || (p_size % 12) || '::' || p_brand || '}} i {{c' || (p_size % 3) || '::' || p_type || '::' || p_name || '}} oraz {{c' || (p_size % 12) || '::x}}'")
    rows = B.read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", F.array_join(T.cloze_keys(F.col("text")), " ").alias("keys"), T.cloze_filled(F.col("text")).alias("filled"))


CASES = "'W sprawie ' || CASE o_orderkey % 3 WHEN 0 THEN 'III CZP ' WHEN 1 THEN 'SK ' ELSE 'Dz ' END || (o_orderkey % 300 + 1) || '/' || (10 + o_orderkey % 20) || ' oraz I CSK ' || (o_orderkey % 77) || '/19'"


@query(f"""WITH t AS (SELECT o_orderkey, {CASES} AS text FROM orders) SELECT o_orderkey, array_to_string(list_filter(list_distinct(regexp_extract_all(text, '\\b((?:[IVX]+ )?[A-Z][A-Za-z]{{0,4}} \\d{{1,5}}/\\d{{2}})\\b', 1)), lambda s: NOT starts_with(s, 'Dz')), '; ') AS x FROM t""".replace("AS x FROM", "AS found FROM").replace("list_filter(", "list_sort(list_filter(").replace("starts_with(s, 'Dz'))", "starts_with(s, 'Dz')))"))
def case_numbers(spark, sf_dir):
    rows = B.read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{CASES} AS text")
    return rows.select("o_orderkey", F.array_join(F.array_sort(T.case_numbers(F.col("text"))), "; ").alias("found"))


@query("""WITH w AS (SELECT user_id, event_type, list(event_id ORDER BY event_id) AS xs FROM events GROUP BY ALL), x AS (SELECT user_id, event_type, unnest(xs) AS pos FROM w) SELECT user_id, string_agg(event_type, ' ' ORDER BY pos) AS abstract FROM x GROUP BY user_id""")
def abstract_from_index(spark, sf_dir):
    e = B.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("at"))
    index = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "at"))).alias("index"))
    return index.select("user_id", T.abstract_from_index(F.col("index")).alias("abstract"))


@query("""WITH m AS (SELECT event_id, greatest(1, floor(event_id * event_id * 40.0 / 60 + 0.5)) AS mi FROM events), d AS (SELECT event_id, mi, floor(mi / 60 + 0.5) AS h, floor(floor(mi / 60 + 0.5) / 24 + 0.5) AS d FROM m)
SELECT event_id, CASE WHEN mi < 60 THEN CAST(mi AS BIGINT) || ' min' WHEN h < 24 THEN CAST(h AS BIGINT) || ' h' WHEN d < 31 THEN CASE WHEN d = 1 THEN '1 dzień' ELSE CAST(d AS BIGINT) || ' dni' END
WHEN floor(d / 30.4 + 0.5) < 12 THEN CAST(floor(d / 30.4 + 0.5) AS BIGINT) || ' mies.' ELSE replace(regexp_replace(CAST(CAST(floor(d / 365 * 10 + 0.5) AS BIGINT) / 10 AS VARCHAR), '\\.0$', ''), '.', ',')
|| CASE WHEN floor(d / 365 * 10 + 0.5) / 10 < 2 THEN ' rok' WHEN floor(d / 365 * 10 + 0.5) / 10 < 5 THEN ' lata' ELSE ' lat' END END AS label FROM d""")
def interval_label(spark, sf_dir):
    n = F.col("event_id").cast("double")
    return B.read(spark, sf_dir, "events").select("event_id", T.interval_label(n * n * 40_000).alias("label"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_partkey % 500 AS a, l_partkey % 500 + l_quantity AS b FROM lineitem), r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
p AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM r) SELECT k AS l_orderkey, min(a) AS start, max(b) AS "end" FROM p GROUP BY k, part""")
def span_union(spark, sf_dir):
    start = F.col("l_partkey") % 500
    spans = B.read(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start"), (start + F.col("l_quantity")).alias("end"))
    return E.union_of_spans(spans, "l_orderkey")
