"""Queries over replicas, caches and session plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import merge as M
from scriptoria.operators import planner as P
from scriptoria.operators import recall as R
from scriptoria.plans import bindings as B
from scriptoria.plans.bindings import NOW, TABLES, recall_sql
from scriptoria.plans.registry import query

#: Lines of an order in a total order: their numbers repeat.
LINES = ["l_linenumber", "l_partkey", "l_extendedprice"]
#: Two replicas of the customers: what each holds, when it wrote it, and what was deleted.
REPLICAS = """
base AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_custkey * 7 % 30 AS updated_at FROM customer WHERE c_custkey % 3 <> 0),
incoming AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_custkey * 11 % 30 AS updated_at FROM customer WHERE c_custkey % 2 = 0),
merged AS (SELECT * EXCLUDE (own, place) FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY updated_at DESC, own DESC) AS place FROM (SELECT *, 1 AS own FROM base UNION ALL SELECT *, 0 AS own FROM incoming)) WHERE place = 1),
dead AS (SELECT 'customer' AS table_name, c_custkey AS id, min(d) AS deleted_at FROM (SELECT c_custkey, c_custkey % 9 AS d FROM customer WHERE c_custkey % 17 = 0 UNION ALL SELECT c_custkey, c_custkey % 5 FROM customer WHERE c_custkey % 34 = 0) GROUP BY c_custkey)
"""


def replicas(spark, sf_dir):
    k = F.col("c_custkey")
    c = B.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    base = c.where(k % 3 != 0).withColumn("updated_at", k * 7 % 30)
    return base, c.where(k % 2 == 0).withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("updated_at", k * 11 % 30)


def deleted(spark, sf_dir):
    k = F.col("c_custkey")
    c = B.read(spark, sf_dir, "customer")
    row = lambda d: [F.lit("customer").alias("table_name"), k.alias("id"), d.alias("deleted_at")]
    return M.merged_tombstones(c.where(k % 17 == 0).select(*row(k % 9)), c.where(k % 34 == 0).select(*row(k % 5)))


def merged(spark, sf_dir):
    return M.last_writer_wins(*replicas(spark, sf_dir), ["c_custkey"])


@query(f"WITH {REPLICAS} SELECT * FROM merged")
def merge_lww(spark, sf_dir):
    return merged(spark, sf_dir)


@query(f"WITH {REPLICAS} SELECT * FROM dead")
def merge_tombstones(spark, sf_dir):
    return deleted(spark, sf_dir)


@query(f"WITH {REPLICAS} SELECT * FROM merged WHERE c_custkey NOT IN (SELECT id FROM dead)")
def merge_without_deleted(spark, sf_dir):
    return M.without_deleted(merged(spark, sf_dir), deleted(spark, sf_dir), "c_custkey", "customer")


@query(f"""WITH {REPLICAS}, n AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 <> 5), c AS (SELECT * FROM merged WHERE c_custkey NOT IN (SELECT id FROM dead) AND c_nationkey IN (SELECT n_nationkey FROM n))
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)""")
def merge_orphans(spark, sf_dir):
    """Orders whose customer survives, whose nation survives: cascades in the order of the parents."""
    nations = B.read(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5")
    customers = M.without_orphans(M.without_deleted(merged(spark, sf_dir), deleted(spark, sf_dir), "c_custkey", "customer"), [(nations, "n_nationkey", "c_nationkey")])
    return M.without_orphans(B.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [(customers, "c_custkey", "o_custkey")])


@query(f"WITH {REPLICAS} SELECT * FROM merged")
def merge_idempotent(spark, sf_dir):
    """Merging the incoming rows a second time, and the result with itself, changes nothing."""
    once, (_, incoming) = merged(spark, sf_dir), replicas(spark, sf_dir)
    return M.last_writer_wins(M.last_writer_wins(once, incoming, ["c_custkey"]), once, ["c_custkey"])


TWINS = f"""{TABLES},
a AS (SELECT material_id, sub_key, item_id * 2 AS id, last_review, suspended, reps, item_id % 7 AS updated_at FROM review_item WHERE item_id % 4 <> 0),
b AS (SELECT material_id, sub_key, item_id * 2 + item_id % 3 % 2 AS id, CASE WHEN item_id % 5 = 0 THEN last_review + INTERVAL 1 DAY ELSE last_review END AS last_review, suspended, reps + item_id % 2 AS reps, item_id % 6 AS updated_at FROM review_item WHERE item_id % 3 <> 0),
u AS (SELECT *, 1 AS own FROM a UNION ALL SELECT *, 0 AS own FROM b),
t AS (SELECT material_id, sub_key, id, first_value(id) OVER (PARTITION BY material_id, sub_key ORDER BY last_review DESC NULLS LAST, suspended DESC, reps DESC, updated_at DESC, own DESC, id) AS survivor, own FROM u)"""


def twins(spark, sf_dir):
    i, items = F.col("item_id"), B.review_item(spark, sf_dir)
    a = items.where(i % 4 != 0).select("material_id", "sub_key", (i * 2).alias("id"), "last_review", "suspended", "reps", (i % 7).alias("updated_at"))
    later = F.when(i % 5 == 0, F.col("last_review") + F.expr("interval 1 day")).otherwise(F.col("last_review"))
    b = items.where(i % 3 != 0).select("material_id", "sub_key", (i * 2 + i % 3 % 2).alias("id"), later.alias("last_review"), "suspended", (F.col("reps") + i % 2).alias("reps"), (i % 6).alias("updated_at"))
    return M.resolve_twins(a, b, ["material_id", "sub_key"], "id", ["last_review", "suspended", "reps", "updated_at"])


@query(f"WITH {TWINS} SELECT material_id, sub_key, id, survivor, own FROM t")
def merge_twins(spark, sf_dir):
    return twins(spark, sf_dir)


@query(f"WITH {TWINS}, m AS (SELECT DISTINCT id, survivor FROM t WHERE id <> survivor) SELECT log_id, coalesce(survivor, item_id * 2) AS id FROM review_log LEFT JOIN m ON m.id = item_id * 2")
def merge_remapped_log(spark, sf_dir):
    log = B.review_log(spark, sf_dir).select("log_id", (F.col("item_id") * 2).alias("id"))
    return M.remapped(log, twins(spark, sf_dir), "id").select("log_id", "id")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def cited_chunks_only(spark, sf_dir):
    used = B.read(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return M.referenced_only(B.read(spark, sf_dir, "part").select("p_partkey", "p_name"), used, "p_partkey", "l_partkey")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F') WHERE place = 1""")
def cache_hits_latest(spark, sf_dir):
    """Orders as model calls: the newest successful answer of each (prompt, input)."""
    ok = B.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return M.newest_by(ok, ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query(f"""WITH {TABLES}, f AS (SELECT topic_id, sha256(string_agg(x, ',' ORDER BY x)) AS fingerprint FROM (SELECT topic_id, CAST(field_id AS VARCHAR) AS x FROM topic_field WHERE status = 'active') GROUP BY topic_id),
k AS (SELECT topic_id, sha256(string_agg(x, ',' ORDER BY x)) AS fingerprint FROM (SELECT topic_id, CAST(field_id AS VARCHAR) AS x FROM topic_field WHERE (status = 'active' OR topic_id % 4 = 0) AND topic_id % 3 <> 0) GROUP BY topic_id)
SELECT f.topic_id, f.fingerprint FROM f LEFT JOIN k USING (topic_id) WHERE f.fingerprint IS DISTINCT FROM k.fingerprint""")
def topics_to_generate(spark, sf_dir):
    fields = B.topic_field(spark, sf_dir)
    stored = fields.where((F.col("status") == "active") | (F.col("topic_id") % 4 == 0)).where("topic_id % 3 <> 0")
    known = stored.groupBy("topic_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("field_id").cast("string"))), ","), 256).alias("fingerprint"))
    return M.changed_fingerprints(fields.where("status = 'active'"), known, "topic_id", "field_id")


DUE = f"""{TABLES}, days AS (SELECT subject_id, CAST(min(date) - DATE '2024-01-31' AS INTEGER) AS days FROM exam WHERE date >= DATE '2024-01-31' GROUP BY subject_id),
due AS (SELECT i.item_id, i.material_id, s.subject_id, t.topic_id, m.type, i.state, (CASE WHEN i.state IN (1, 3) THEN 10 ELSE 0 END) + (1 - ({recall_sql(f"TIMESTAMP '{NOW}'")})) * (0.5 + coalesce(exam_weight_override, exam_weight)) *
  CASE WHEN s.status = 'maintenance' THEN 0.5 WHEN days IS NULL THEN 1 ELSE 1 + 1.5 * exp(-greatest(days, 0) / 14.0) END AS priority
  FROM review_item i JOIN material m USING (material_id) JOIN topic t ON t.topic_id = m.topic_id JOIN subject s ON s.subject_id = t.subject_id LEFT JOIN days d ON d.subject_id = s.subject_id
  WHERE m.status = 'active' AND s.status <> 'archived' AND NOT suspended AND state <> 0),
best AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY round(priority, 9) DESC, item_id) AS place FROM due) WHERE place = 1)"""


def best_due(spark, sf_dir):
    subjects = B.subject(spark, sf_dir).where("status != 'archived'").select("subject_id", "status")
    days = R.days_to_exam(B.exam(spark, sf_dir), NOW).select("subject_id", "days")
    topics = B.topic(spark, sf_dir).select("topic_id", "subject_id", F.coalesce("exam_weight_override", "exam_weight").alias("weight"))
    materials = B.material(spark, sf_dir).where("status = 'active'").select("material_id", "topic_id", "type")
    items = B.review_item(spark, sf_dir).where("not suspended and state <> 0")
    rows = items.join(materials, "material_id").join(topics, "topic_id").join(subjects, "subject_id").join(days, "subject_id", "left")
    return P.best_per_material(rows.withColumn("priority", P.priority(NOW)))


@query(f"WITH {DUE} SELECT material_id, item_id, round(priority, 6) AS priority FROM best")
def due_best_per_material(spark, sf_dir):
    return best_due(spark, sf_dir).select("material_id", "item_id", F.round("priority", 6).alias("priority"))


@query(f"WITH {DUE} SELECT item_id, round(priority, 6) AS priority FROM best ORDER BY round(priority, 9) DESC, item_id LIMIT 20")
def due_priority_topk(spark, sf_dir):
    return best_due(spark, sf_dir).orderBy(F.desc(F.round("priority", 9)), "item_id").limit(20).select("item_id", F.round("priority", 6).alias("priority"))


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_quantity AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS place FROM lineitem),
s(l_orderkey, place, l_linenumber, used, taken) AS (SELECT l_orderkey, place, l_linenumber, CASE WHEN cost <= 60 THEN cost ELSE 0 END, cost <= 60 FROM r WHERE place = 1
UNION ALL SELECT r.l_orderkey, r.place, r.l_linenumber, s.used + CASE WHEN s.used + r.cost <= 60 THEN r.cost ELSE 0 END, s.used + r.cost <= 60 FROM s JOIN r ON r.l_orderkey = s.l_orderkey AND r.place = s.place + 1)
SELECT l_orderkey, l_linenumber, taken FROM s""")
def plan_first_fit(spark, sf_dir):
    """Order lines as due cards, quantity as seconds, 60 seconds a session."""
    rows = B.read(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber").cast("bigint"))
    out = P.first_fit(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], "l_quantity", "line", 60)
    return out.select("l_orderkey", F.col("line").cast("int").alias("l_linenumber"), "taken")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice) AS inside FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS used FROM i WHERE l_returnflag = 'N' OR inside <= 2)
SELECT l_orderkey, l_linenumber, used FROM p WHERE place <= 4 AND used <= 90""")
def plan_new_caps(spark, sf_dir):
    rows = B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey", "l_extendedprice")
    cap = F.when(F.col("l_returnflag") != "N", 2)
    return P.within_caps(rows, ["l_orderkey"], "l_returnflag", LINES, "l_quantity", cap, 4, 90).select("l_orderkey", "l_linenumber", "used")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS a,
row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice) AS turn FROM lineitem),
f AS (SELECT *, min(a) OVER (PARTITION BY l_orderkey, l_returnflag) AS first FROM n) SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY turn, first) AS INTEGER) AS place FROM f""")
def round_robin_order(spark, sf_dir):
    rows = B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_extendedprice")
    return P.round_robin(rows, ["l_orderkey"], "l_returnflag", LINES).select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AND l_linenumber % 3 = 0 AS fresh FROM lineitem), n AS (SELECT *, count(*) FILTER (fresh) OVER w AS nf, count(*) FILTER (NOT fresh) OVER w AS nr,
row_number() OVER (PARTITION BY l_orderkey, fresh ORDER BY l_linenumber) - 1 AS i FROM x WINDOW w AS (PARTITION BY l_orderkey)),
g AS (SELECT *, CASE WHEN nf = 0 THEN 1 ELSE greatest(1, nr // nf) END AS gap FROM n)
SELECT l_orderkey, l_linenumber, fresh, CASE WHEN fresh THEN least(nr, (i + 1) * gap) + i ELSE i + CASE WHEN nf = 0 THEN 0 ELSE least(nf, i // gap) END END AS place FROM g""")
def arrange_order(spark, sf_dir):
    rows = B.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0)).alias("fresh"))
    out = P.arranged(rows.where("not fresh"), rows.where("fresh"), ["l_orderkey"], "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "fresh", "place")


@query()
def spread_order(spark, sf_dir):
    """Cards of each learner reordered so that neighbours differ; a greedy choice, tested on fixtures."""
    rows = best_due(spark, sf_dir).select(F.expr("item_id div 5").alias("learner"), F.col("item_id").alias("place"), "topic_id", "subject_id")
    return P.spread(rows, ["learner"], "learner long, place long, topic_id long, subject_id long")


@query()
def fsrs_replay(spark, sf_dir):
    """Review items as replaying all answers leaves them; tested against a plain loop."""
    return P.replay(B.review_log(spark, sf_dir))


@query(f"""WITH {TABLES}, want AS (SELECT DISTINCT material_id, 'c' || k AS sub_key FROM material, (VALUES (1), (10), (11)) v(k) WHERE material_id % k <> 1),
have AS (SELECT DISTINCT material_id, sub_key FROM review_item)
SELECT material_id, sub_key, CASE WHEN have.material_id IS NULL THEN 'created' WHEN want.material_id IS NULL THEN 'removed' ELSE 'kept' END AS action FROM want FULL JOIN have USING (material_id, sub_key)""".replace(
    "CASE WHEN have.material_id IS NULL", "CASE WHEN h IS NULL").replace("WHEN want.material_id IS NULL", "WHEN w IS NULL").replace("SELECT DISTINCT material_id, 'c' || k AS sub_key", "SELECT DISTINCT material_id, 'c' || k AS sub_key, 1 AS w").replace("SELECT DISTINCT material_id, sub_key FROM", "SELECT DISTINCT material_id, sub_key, 1 AS h FROM"))
def item_sync_diff(spark, sf_dir):
    keys = F.filter(F.array(F.lit(1), F.lit(10), F.lit(11)), lambda k: F.col("material_id") % k != 1)
    materials = B.material(spark, sf_dir).select("material_id", F.transform(keys, lambda k: F.concat(F.lit("c"), k.cast("string"))).alias("keys"))
    return P.sync_items(materials, B.review_item(spark, sf_dir))


KINDS = "CASE doc_id % 6 WHEN 0 THEN 'note' WHEN 1 THEN 'act' WHEN 2 THEN 'textbook' WHEN 3 THEN 'syllabus' WHEN 4 THEN 'case_law' ELSE 'note' END"


@query(f"""WITH r AS (SELECT doc_id * 7 % 97 AS topic_id, doc_id, {KINDS} AS kind, CAST(doc_id * 7 % 97 % 4 = 0 AS INTEGER) AS emphasis, doc_id * 7 % 97 % 3 AS listed FROM documents WHERE doc_id * 7 % 97 % 5 <> doc_id % 6),
k AS (SELECT topic_id, count(DISTINCT doc_id) FILTER (kind = 'note') AS notes, bool_or(kind = 'act') AS act, bool_or(kind IN ('textbook', 'case_law')) AS book, max(emphasis) AS e, max(listed) AS l FROM r GROUP BY topic_id)
SELECT topic_id, CAST(round(greatest(CASE WHEN l = 2 THEN 1 ELSE 0 END, CASE WHEN l = 1 THEN 0.5 ELSE 0 END, CASE WHEN notes > 0 THEN least(0.9, 0.5 + 0.1 * (notes - 1) + CASE WHEN e > 0 THEN 0.2 ELSE 0 END) ELSE 0 END,
CASE WHEN act THEN 0.3 ELSE 0 END, CASE WHEN book THEN 0.2 ELSE 0 END), 2) AS DOUBLE) AS weight FROM k""")
def exam_weight(spark, sf_dir):
    t = F.col("doc_id") * 7 % 97
    rows = B.read(spark, sf_dir, "documents").where(t % 5 != F.col("doc_id") % 6).select(t.alias("topic_id"), F.col("doc_id").alias("document_id"), F.expr(KINDS).alias("kind"), (t % 4 == 0).cast("int").alias("emphasis"), (t % 3).alias("on_exam_list"))
    return P.exam_weight(rows, "topic_id")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id, count(*) AS answers, count(DISTINCT n) AS sessions FROM s GROUP BY user_id""")
def study_sessions(spark, sf_dir):
    from scriptoria.streaming.live import study_sessions as sessions

    found = sessions(B.read(spark, sf_dir, "events"))
    return found.groupBy("user_id").agg(F.sum("answers").alias("answers"), F.count("*").alias("sessions"))
