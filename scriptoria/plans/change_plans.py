"""Queries over changes by people and imports, over answers in words, and over what waits after a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import changes as H
from scriptoria.operators import planner as P
from scriptoria.plans import bindings as B
from scriptoria.plans.bindings import NOW, TABLES
from scriptoria.plans.registry import query
from scriptoria.plans.review_plans import SOURCES, chunk, citation
from scriptoria.plans.text_plans import CLAIM, search_tokens_sql

PLAIN = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"


def same_sql(e: str, a: str) -> str:
    """same_word of two plain words."""
    return f"(CASE WHEN {a} = '' THEN false WHEN {e} = {a} THEN true WHEN length({e}) <= 4 THEN false ELSE (length({e}) >= 6 AND length({a}) >= 6 AND substring({e}, 1, 5) = substring({a}, 1, 5)) OR levenshtein({e}, {a}) <= CASE WHEN length({e}) >= 8 THEN 2 ELSE 1 END END)"


#: Answers with the words in another order, fewer or misspelled ones.
ANSWERS = """phrases AS (SELECT p_partkey, p_type || ' ' || p_name AS expected, CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN p_name WHEN 2 THEN p_type || ' ' || reverse(p_name) WHEN 3 THEN '' ELSE substring(p_type, 1, length(p_type) - 1) || 'Ó ' || p_name END AS answer FROM part)"""


def phrases(spark, sf_dir):
    kind, name, k = F.col("p_type"), F.col("p_name"), F.col("p_partkey") % 5
    blank = F.lit(" ")
    answer = F.when(k == 0, F.concat(name, blank, F.lower(kind))).when(k == 1, name).when(k == 2, F.concat(kind, blank, F.reverse(name))).when(k == 3, F.lit("")).otherwise(F.concat(F.expr("substring(p_type, 1, length(p_type) - 1)"), F.lit("Ó "), name))
    return B.read(spark, sf_dir, "part").select("p_partkey", F.concat(kind, blank, name).alias("expected"), answer.alias("answer"))


@query(f"""WITH {ANSWERS}, w AS (SELECT p_partkey, {PLAIN.format('expected')} AS e, {PLAIN.format('answer')} AS a FROM phrases),
l AS (SELECT *, list_filter(string_split(e, ' '), lambda x: length(x) >= 3) AS want, list_filter(string_split(a, ' '), lambda x: length(x) >= 3) AS have FROM w)
SELECT p_partkey, CASE WHEN len(want) = 0 THEN {same_sql('e', 'a')} ELSE len(list_filter(want, lambda x: len(list_filter(have, lambda y: {same_sql('x', 'y')})) > 0)) >= 0.6 * len(want) END AS same FROM l""")
def phrase_matches(spark, sf_dir):
    return phrases(spark, sf_dir).select("p_partkey", T.same_phrase(F.col("expected"), F.col("answer")).alias("same"))


@query(f"""WITH {ANSWERS}, l AS (SELECT p_partkey, string_split(expected, ' ') AS e, string_split(answer, ' ') AS a FROM phrases),
x AS (SELECT p_partkey, unnest(e) AS e, unnest(range(1, len(e) + 1)) AS i, a FROM l), y AS (SELECT p_partkey, i, {PLAIN.format('e')} AS e, {PLAIN.format("coalesce(a[i], '')")} AS a FROM x)
SELECT p_partkey, count(*) AS asked, count(*) FILTER ({same_sql('e', 'a')}) AS correct FROM y GROUP BY p_partkey""")
def recall_scores(spark, sf_dir):
    hits = T.recalled(F.split("expected", " "), F.split("answer", " "))
    rows = phrases(spark, sf_dir).select("p_partkey", hits.alias("hits"))
    return rows.select("p_partkey", F.size("hits").cast("bigint").alias("asked"), F.size(F.filter("hits", lambda x: x)).cast("bigint").alias("correct"))


#: The replacements of the oracle, apart from the operator's.
SAID = "CLAIM"
for _short, _full in (("k.c.", "kodeksu cywilnego"), ("k.k.", "kodeksu karnego"), ("k.p.c.", "kodeksu postępowania cywilnego"), ("k.p.", "kodeksu pracy")):
    SAID = f"replace({SAID}, '{_short}', '{_full}')"
for _pattern, _full in ((r"(?i)\bart\.\s*", "artykuł "), (r"§\s*", "paragraf "), (r"(?i)\bust\.\s*", "ustęp "), (r"(?i)\bpkt\s*", "punkt "), (r"\bnp\.", "na przykład"), (r"\bSN\b", "Sąd Najwyższy")):
    SAID = f"regexp_replace({SAID}, '{_pattern}', '{_full}', 'g')"


@query(f"WITH c AS (SELECT o_orderkey, {CLAIM} || '  Ust. 2 pkt 1, np. wyrok SN' AS said FROM orders) SELECT o_orderkey, trim(regexp_replace({SAID.replace('CLAIM', 'said')}, '\\s+', ' ', 'g')) AS spoken FROM c")
def spoken_claims(spark, sf_dir):
    rows = B.read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{CLAIM} AS claim")
    return rows.select("o_orderkey", T.spoken(F.concat("claim", F.lit("  Ust. 2 pkt 1, np. wyrok SN"))).alias("spoken"))


TITLES = ["Kodeks cywilny", "KODEKS POSTĘPOWANIA CYWILNEGO", "Kodeks karny wykonawczy", "kodeks karny", "Kodeks pracy", "Ordynacja", "Konstytucja Rzeczypospolitej Polskiej", "Kodeks spółek handlowych"]
SHORTS = ["K.C.", "k. p. c.", "kkw", "x.y.", "Konstytucji RP", "k.s.h."]


@query("""WITH t(i, title) AS (VALUES (0, 'Kodeks cywilny'), (1, 'KODEKS POSTĘPOWANIA CYWILNEGO'), (2, 'Kodeks karny wykonawczy'), (3, 'kodeks karny'), (4, 'Kodeks pracy'), (5, 'Ordynacja'), (6, 'Konstytucja Rzeczypospolitej Polskiej'), (7, 'Kodeks spółek handlowych')),
a(i, abbreviation) AS (VALUES (0, 'k.c.'), (1, 'k.p.c.'), (2, 'k.k.w.'), (3, 'k.k.'), (4, 'k.p.'), (6, 'Konstytucja RP'), (7, 'k.s.h.')),
s(j, name) AS (VALUES (0, 'Kodeks cywilny'), (1, 'Kodeks postępowania cywilnego'), (2, 'Kodeks karny wykonawczy'), (4, 'Konstytucja Rzeczypospolitej Polskiej'), (5, 'Kodeks spółek handlowych'))
SELECT o_orderkey, abbreviation, name AS title FROM orders LEFT JOIN a ON a.i = o_orderkey % 8 LEFT JOIN s ON s.j = o_orderkey % 6""")
def act_names(spark, sf_dir):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values)).cast("int"))
    titles = F.concat(F.lit("Ustawa: "), pick(TITLES), F.lit(" z dnia"))
    return B.read(spark, sf_dir, "orders").select("o_orderkey", T.act_abbreviation(titles).alias("abbreviation"), T.act_title(pick(SHORTS)).alias("title"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 4 IN (0, 1) THEN true ELSE lower(text) SIMILAR TO '(?s).*(context (length|window|size|overflow)|n_ctx|prompt is (too )?long|too many tokens|maximum context).*' END AS too_long FROM conversations""")
def context_errors(spark, sf_dir):
    k = F.col("conv_id") % 4
    said = F.concat("text", F.when(k == 0, " Exceeds the available context").when(k == 1, " TOO MANY TOKENS").otherwise(""))
    return B.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_context_error(said).alias("too_long"))


@query("""WITH g AS (SELECT l_orderkey, 'c' || (l_partkey % 12 + 1) AS sub_key, l_partkey % 12 + 1 AS number, l_partkey AS item FROM lineitem)
SELECT l_orderkey, sub_key, item FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY number, item) = 1""")
def first_new_gap(spark, sf_dir):
    rows = B.read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("c"), F.col("l_partkey") % 12 + 1).alias("sub_key"), F.col("l_partkey").alias("item"))
    return P.first_gaps(rows, "l_orderkey", "sub_key", "item")


@query("""WITH d AS (SELECT l_orderkey, l_quantity AS cost, (l_orderkey + l_partkey) % 3 <> 0 AS taken FROM lineitem)
SELECT l_orderkey, count(*) FILTER (NOT taken) AS deferred, CAST(CASE WHEN count(*) FILTER (NOT taken) > 0 THEN ceil(sum(cost) / 60) ELSE 0 END AS BIGINT) AS backlog_days FROM d GROUP BY l_orderkey""")
def backlog_days(spark, sf_dir):
    taken = ((F.col("l_orderkey") + F.col("l_partkey")) % 3 != 0).alias("taken")
    return P.backlog(B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", taken), ["l_orderkey"], "l_quantity", 60)


@query(f"""WITH {TABLES}, a AS (SELECT item_id, max(ts) AS last FROM review_log WHERE counted GROUP BY item_id)
SELECT i.item_id, strftime(date_trunc('day', max(a.last) - INTERVAL 4 HOUR) + INTERVAL 28 HOUR, '%Y-%m-%d %H:%M:%S') AS buried_until FROM review_item i JOIN review_item o ON o.material_id = i.material_id AND o.item_id <> i.item_id JOIN a ON a.item_id = o.item_id GROUP BY i.item_id""")
def buried_siblings(spark, sf_dir):
    out = P.buried(B.review_log(spark, sf_dir), B.review_item(spark, sf_dir))
    return out.select("item_id", F.date_format("buried_until", "yyyy-MM-dd HH:mm:ss").alias("buried_until"))


S = P.Scheduler()


@query(f"""WITH {TABLES}, i AS (SELECT item_id, CASE WHEN state = 0 THEN 0.0 ELSE stability END AS s, 1.0 + item_id % 9 AS old, greatest(0, coalesce(floor(date_sub('second', last_review, TIMESTAMP '{NOW}') / 86400.0), 0)) AS days FROM review_item),
r AS (SELECT *, unnest([1, 2, 3, 4]) AS rating FROM i), d AS (SELECT *, least(10.0, greatest(1.0, old - 0.8 * (rating - 3) * (10 - old) / 9)) AS d, 1 - pow(1 + {0.9 ** (1 / S.decay) - 1!r} * days / nullif(s, 0), {S.decay}) AS lost FROM r),
x AS (SELECT *, CASE WHEN s <= 0 THEN [{', '.join(map(str, S.initial))}][rating] WHEN rating = 1 THEN least(s, {S.lapse[0]} * pow(d, -{S.lapse[1]}) * (pow(s + 1, {S.lapse[2]}) - 1) * exp({S.lapse[3]} * lost))
  ELSE s * (1 + exp({S.growth}) * (11 - d) * pow(s, -{S.saturation}) * (exp(lost * {S.recall_gain}) - 1) * CASE rating WHEN 2 THEN {S.hard} WHEN 4 THEN {S.easy} ELSE 1 END) END AS after FROM d)
SELECT item_id, rating, round(CAST(after AS DOUBLE), 4) AS stability, CAST(greatest(1, round_even(CAST(after AS DOUBLE), 0)) AS BIGINT) AS interval FROM x""")
def rating_previews(spark, sf_dir):
    """What each of the four ratings would do to each item now."""
    items = B.review_item(spark, sf_dir).select("item_id", F.when(F.col("state") == 0, 0.0).otherwise(F.col("stability")).alias("stability"), (1.0 + F.col("item_id") % 9).alias("difficulty"), "last_review")
    days = F.greatest(F.lit(0), F.coalesce(F.floor(F.timestamp_diff("SECOND", F.col("last_review"), F.lit(NOW).cast("timestamp_ntz")) / 86400.0), F.lit(0)))
    return P.rating_preview(items, days).withColumn("stability", F.round("stability", 4))


@query(f"""WITH {TABLES}, {SOURCES}, x AS (SELECT owner_id AS material_id, bool_and(document LIKE '%1') AS orphan FROM citation JOIN chunk USING (chunk_id) WHERE owner_type = 'material' GROUP BY owner_id)
SELECT material_id, CASE WHEN orphan AND status <> 'rejected' THEN 'needs_review' ELSE status END AS status FROM material LEFT JOIN x USING (material_id)""")
def delete_documents(spark, sf_dir):
    chunks = chunk(spark, sf_dir)
    deleted = chunks.where(F.col("document").endswith("1")).select("document")
    return H.after_deletion(B.material(spark, sf_dir).select("material_id", "status"), citation(spark, sf_dir), chunks, deleted)


#: Conflicts of two or three fields each; every third is open, and one in 50 decisions names no candidate.
CONFLICTS = """conflicts AS (SELECT o_orderkey AS conflict_id, [o_custkey % 400, (o_custkey * 7 + o_orderkey) % 400, (o_orderkey * 3) % 400] AS candidates, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 50 = 1 THEN -1 ELSE [o_custkey % 400, (o_custkey * 7 + o_orderkey) % 400, (o_orderkey * 3) % 400][1 + o_orderkey % 2] END END AS chosen FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT DISTINCT conflict_id, coalesce(list_contains(candidates, chosen), false) AS decided, chosen, unnest(candidates) AS field_id FROM conflicts),
resolved AS (SELECT field_id, CASE WHEN NOT arg_max(chosen = field_id, conflict_id) FILTER (decided) THEN 'superseded' WHEN bool_or(NOT decided) THEN 'conflicted' ELSE 'active' END AS status, coalesce(bool_or(decided AND chosen <> field_id), false) AS superseded FROM f GROUP BY field_id HAVING bool_or(decided))"""


def resolved(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    listed = F.array(c % 400, (c * 7 + o) % 400, o * 3 % 400)
    orders = B.read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    conflicts = orders.select(o.alias("conflict_id"), F.to_json(listed).alias("candidates_json"))
    chosen = F.when(o % 50 == 1, F.lit(-1)).otherwise(F.get(listed, (o % 2).cast("int")))
    return H.resolved_fields(conflicts, orders.where(o % 3 != 0).select(o.alias("conflict_id"), chosen.alias("chosen")))


@query(f"WITH {CONFLICTS} SELECT * FROM resolved")
def resolve_conflicts(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(f"WITH {TABLES}, {CONFLICTS} SELECT material_id, CASE WHEN status IN ('active', 'pending') AND material_id IN (SELECT material_id FROM material_field JOIN resolved USING (field_id) WHERE superseded) THEN 'needs_review' ELSE status END AS status FROM material")
def materials_after_conflicts(spark, sf_dir):
    return H.after_decisions(B.material(spark, sf_dir).select("material_id", "status"), B.material_field(spark, sf_dir), resolved(spark, sf_dir))


@query(f"""WITH {TABLES} SELECT item_id, material_id, CASE WHEN material_id % 4 = 0 AND status IN ('pending', 'needs_review', 'active') THEN 'active' WHEN material_id % 4 = 1 THEN 'rejected' ELSE status END AS status,
CASE material_id % 4 WHEN 0 THEN false WHEN 2 THEN true ELSE suspended END AS suspended, material_id % 8 = 1 AS too_easy FROM review_item JOIN material USING (material_id)""")
def reviewed_items(spark, sf_dir):
    m = F.col("material_id")
    action = F.when(m % 4 == 0, "approve").when(m % 4 == 1, "reject").otherwise("flag")
    decisions = B.material(spark, sf_dir).where(m % 4 != 3).select(m, action.alias("action"), (m % 8 == 1).alias("too_easy"))
    return H.after_review(B.review_item(spark, sf_dir), B.material(spark, sf_dir), decisions)


@query("""WITH s AS (SELECT p_partkey AS id, p_size % 5 AS subject_id, p_brand AS kind, trim(p_type || ' ' || p_name) AS text, p_partkey * 7 % 100 AS created FROM part WHERE p_size % 2 = 0),
o AS (SELECT p_size % 5 AS subject_id, p_brand AS kind, p_type || ' ' || p_name AS text FROM part WHERE p_size % 2 = 1 AND p_size % 3 <> 0)
SELECT id, subject_id, kind, text, created FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, kind, text ORDER BY created, id) AS n FROM s) WHERE n = 1 AND (subject_id, kind, text) NOT IN (SELECT (subject_id, kind, text) FROM o)""")
def suggestions_added(spark, sf_dir):
    part = B.read(spark, sf_dir, "part")
    row = lambda text: [F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("subject_id"), F.col("p_brand").alias("kind"), text.alias("text"), (F.col("p_partkey") * 7 % 100).alias("created")]
    existing = part.where("p_size % 2 = 1").select(*row(F.concat_ws(" ", "p_type", "p_name")), F.when(F.col("p_size") % 3 != 0, "open").otherwise("done").alias("status"))
    return H.added_suggestions(existing, part.where("p_size % 2 = 0").select(*row(F.concat(F.lit(" "), "p_type", F.lit("  "), "p_name", F.lit("\n")))))


@query(f"""WITH {TABLES}, s AS (SELECT p_partkey AS id, p_size % 5 AS subject_id, p_partkey % 60 AS topic_id, p_partkey * 7 % 100 AS created FROM part WHERE p_size % 3 <> 0)
SELECT id, s.subject_id, topic_id, name AS topic_name, CAST(row_number() OVER (PARTITION BY s.subject_id ORDER BY created DESC, id) AS INTEGER) AS place FROM s LEFT JOIN topic USING (topic_id)""")
def suggestion_list(spark, sf_dir):
    k = F.col("p_partkey")
    rows = B.read(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") % 5).alias("subject_id"), (k % 60).alias("topic_id"), (k * 7 % 100).alias("created"), F.when(F.col("p_size") % 3 != 0, "open").otherwise("done").alias("status"))
    return H.open_suggestions(rows, B.topic(spark, sf_dir)).select("id", "subject_id", "topic_id", "topic_name", "place")


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS subject_id, 'file ' || doc_id % 40 AS name, source AS kind, sha256(coalesce(text, '')) AS hash FROM documents), known AS (SELECT *, 1 + doc_id // 80 AS version FROM d WHERE doc_id % 2 = 0), files AS (SELECT * FROM d WHERE doc_id % 2 = 1),
x AS (SELECT f.*, (subject_id, hash) IN (SELECT (subject_id, hash) FROM known) OR doc_id <> min(doc_id) OVER (PARTITION BY subject_id, hash) AS duplicate FROM files f), b AS (SELECT subject_id, name, kind, max(version) AS before FROM known GROUP BY ALL)
SELECT doc_id AS file_id, duplicate, CASE WHEN NOT duplicate THEN coalesce(before, 0) + row_number() OVER (PARTITION BY subject_id, name, kind, duplicate ORDER BY doc_id) END AS version FROM x LEFT JOIN b USING (subject_id, name, kind)""")
def import_versions(spark, sf_dir):
    k = F.col("doc_id")
    docs = B.read(spark, sf_dir, "documents").select(k, (k % 3).alias("subject_id"), F.concat(F.lit("file "), k % 40).alias("name"), F.col("source").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    known = docs.where(k % 2 == 0).withColumn("version", 1 + F.floor(k / 80))
    return H.import_versions(known, docs.where(k % 2 == 1).withColumnRenamed("doc_id", "file_id"))


LINES = """lines AS (SELECT DISTINCT line FROM (SELECT unnest([p_type, p_name || ' ' || lower(p_type)]) AS line FROM part) WHERE length(line) BETWEEN 3 AND 160),
topics AS (SELECT min(id) AS topic_id, name FROM (SELECT 2 * p_partkey AS id, lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS name FROM part UNION ALL SELECT 2 * p_partkey + 1, lower(p_type) FROM part WHERE p_size > 10) GROUP BY name)"""


@query(f"""WITH {LINES}, a AS (SELECT line, list_distinct({search_tokens_sql('line')}) AS x FROM lines), b AS (SELECT topic_id, name, list_distinct({search_tokens_sql('name')}) AS y FROM topics),
same AS (SELECT line, min(topic_id) AS same_id FROM lines JOIN topics ON strip_accents(lower(line)) = strip_accents(lower(name)) GROUP BY line),
s AS (SELECT line, topic_id, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS score FROM a, b WHERE len(list_intersect(x, y)) > 0),
alike AS (SELECT line, topic_id AS alike_id FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, topic_id) = 1)
SELECT line, coalesce(same_id, alike_id) AS topic_id, CASE WHEN same_id IS NOT NULL THEN 'same' WHEN alike_id IS NOT NULL THEN 'alike' ELSE 'new' END AS how FROM lines LEFT JOIN same USING (line) LEFT JOIN alike USING (line)""")
def topic_list_matches(spark, sf_dir):
    part = B.read(spark, sf_dir, "part")
    lists = part.select(F.concat(F.col("p_partkey"), F.lit(") "), "p_type", F.lit("\n\n  - "), "p_name", F.lit(" "), F.lower("p_type"), F.lit("\nx")).alias("text"))
    names = part.select((F.col("p_partkey") * 2).alias("id"), F.concat_ws(" ", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name")).unionByName(part.where("p_size > 10").select((F.col("p_partkey") * 2 + 1).alias("id"), F.lower("p_type").alias("name")))
    return H.matched_topics(lists, names.groupBy("name").agg(F.min("id").alias("topic_id")), "text")
