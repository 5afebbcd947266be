"""Queries over answer logs, review items, materials, topics and subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import recall as R
from scriptoria.plans import bindings as B
from scriptoria.plans.bindings import NOW, TABLES, recall_sql
from scriptoria.plans.registry import query

DAY = "CAST(CAST(TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 4 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 4 HOUR"
T = f"TIMESTAMP '{NOW}'"
ITEMS = "SELECT i.*, t.topic_id, t.subject_id, t.section_id FROM review_item i JOIN material m USING (material_id) JOIN topic t ON t.topic_id = m.topic_id WHERE m.status = 'active' AND NOT i.suspended"


def rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def big(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query(f"WITH {TABLES} SELECT confidence, count(*) AS answers, count(*) FILTER (rating >= 3) AS correct FROM review_log WHERE confidence IS NOT NULL GROUP BY confidence")
def calibration(spark, sf_dir):
    return R.calibration(B.review_log(spark, sf_dir))


@query(f"WITH {TABLES} SELECT confidence, count(*) AS answers, count(*) FILTER (rating >= 3) AS correct FROM review_log WHERE confidence IS NOT NULL AND ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY confidence")
def calibration_since(spark, sf_dir):
    return R.calibration(B.review_log(spark, sf_dir), "2024-01-15 00:00:00")


@query(f"""WITH {TABLES} SELECT m.material_id, m.topic_id, max(i.lapses) AS lapses, any_value(a.answers) AS answers, round(any_value(a.share), 6) AS again_share
FROM material m JOIN review_item i USING (material_id)
JOIN (SELECT material_id, count(*) AS answers, avg(CAST(rating = 1 AS INTEGER)) AS share FROM review_log JOIN review_item USING (item_id) GROUP BY material_id) a USING (material_id)
WHERE m.status = 'active' GROUP BY m.material_id, m.topic_id HAVING any_value(a.answers) >= 3 AND (max(i.lapses) > 0 OR any_value(a.share) >= 0.3)
ORDER BY any_value(a.share) DESC, lapses DESC, m.material_id LIMIT 8""")
def hardest_items(spark, sf_dir):
    return rounded(R.hardest_materials(B.review_log(spark, sf_dir), B.review_item(spark, sf_dir), B.material(spark, sf_dir)), "again_share")


@query(f"""WITH {TABLES} SELECT subject_id, count(*) AS introduced FROM (SELECT item_id, min(ts) AS first FROM review_log WHERE counted GROUP BY item_id)
JOIN review_item USING (item_id) JOIN material USING (material_id) JOIN topic USING (topic_id) WHERE first >= TIMESTAMP '2024-01-03 04:00:00' GROUP BY subject_id""")
def introduced_per_subject(spark, sf_dir):
    return R.introduced_since(B.review_log(spark, sf_dir), B.review_item(spark, sf_dir), B.material(spark, sf_dir), B.topic(spark, sf_dir), "2024-01-03 04:00:00")


@query(f"""WITH {TABLES}, recent AS (SELECT type, least(duration_ms, 120000) / 1000 AS s FROM review_log JOIN review_item USING (item_id) JOIN material USING (material_id)
  WHERE duration_ms IS NOT NULL ORDER BY ts DESC, log_id LIMIT 1000),
ranked AS (SELECT type, s, row_number() OVER (PARTITION BY type ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY type) AS n FROM recent),
measured AS (SELECT type, greatest(4.0, s) AS s FROM ranked WHERE n >= 10 AND k = n // 2),
usual(type, s) AS (VALUES ('qa', 12.0), ('cloze', 12.0), ('list', 35.0), ('provision', 12.0), ('distinction', 20.0), ('why', 18.0))
SELECT u.type, CAST(round(coalesce(m.s, u.s), 6) AS DOUBLE) AS seconds FROM usual u LEFT JOIN measured m USING (type)""")
def typical_seconds(spark, sf_dir):
    return rounded(R.typical_seconds(B.review_log(spark, sf_dir), B.review_item(spark, sf_dir), B.material(spark, sf_dir)), "seconds")


@query(f"WITH {TABLES} SELECT CAST(floor(coalesce(sum(least(coalesce(duration_ms, 0), 120000)), 0) / 1000 + 0.5) AS BIGINT) AS seconds FROM review_log WHERE ts >= {DAY} - INTERVAL 7 DAY")
def studied_seconds(spark, sf_dir):
    return R.studied_seconds(B.review_log(spark, sf_dir), R.study_day_start(NOW) - F.expr("interval 7 days"))


@query(f"""WITH {TABLES} SELECT subject_id, min(date) AS date, CAST(min(date) - DATE '2024-01-31' AS INTEGER) AS days, round(1 + 1.5 * exp(-greatest(CAST(min(date) - DATE '2024-01-31' AS INTEGER), 0) / 14.0), 6) AS urgency
FROM exam WHERE date >= DATE '2024-01-31' GROUP BY subject_id""")
def days_to_exam(spark, sf_dir):
    return rounded(R.days_to_exam(B.exam(spark, sf_dir), NOW), "urgency")


@query(f"""WITH {TABLES}, d AS (SELECT CAST(DATE '2024-01-31' - CAST(k AS INTEGER) AS DATE) AS day FROM range(14) r(k))
SELECT d.day, count(l.log_id) AS answers FROM d LEFT JOIN review_log l ON CAST(l.ts - INTERVAL 4 HOUR AS DATE) = d.day GROUP BY d.day""")
def answers_last14(spark, sf_dir):
    return big(R.answers_by_day(B.review_log(spark, sf_dir), NOW), "answers")


@query(f"""WITH {TABLES}, d AS (SELECT DISTINCT item_id // 5 AS learner, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day FROM review_log WHERE CAST(ts - INTERVAL 4 HOUR AS DATE) <= DATE '2024-01-31'),
n AS (SELECT learner, day, day - CAST(row_number() OVER (PARTITION BY learner ORDER BY day) AS INTEGER) AS island FROM d)
SELECT learner, count(*) AS streak FROM n GROUP BY learner, island HAVING max(day) >= DATE '2024-01-30'""")
def streak(spark, sf_dir):
    log = B.review_log(spark, sf_dir).withColumn("learner", F.expr("item_id div 5"))
    return R.streaks(log, NOW, ["learner"])


@query(f"WITH {TABLES} SELECT item_id, round({recall_sql(T)}, 6) AS recall FROM review_item")
def recall_now(spark, sf_dir):
    return B.review_item(spark, sf_dir).select("item_id", F.round(R.recall_probability(NOW), 6).alias("recall"))


TOPICS = f"""masteries AS (SELECT t.topic_id, t.name, t.subject_id, t.section_id, coalesce(avg({recall_sql(T)}) FILTER (i.item_id IS NOT NULL), 0) AS mastery, count(i.item_id) AS items, count(*) FILTER (i.reps > 0) AS learned,
coalesce(t.exam_weight_override, t.exam_weight) AS weight, t.on_exam_list = 2 AS on_list FROM topic t LEFT JOIN ({ITEMS}) i ON i.topic_id = t.topic_id
GROUP BY t.topic_id, t.name, t.subject_id, t.section_id, t.exam_weight_override, t.exam_weight, t.on_exam_list)"""


def masteries(spark, sf_dir):
    return R.topic_mastery(B.review_item(spark, sf_dir), B.material(spark, sf_dir), B.topic(spark, sf_dir), NOW)


@query(f"WITH {TABLES}, {TOPICS} SELECT topic_id, name, subject_id, section_id, round(mastery, 6) AS mastery, items, learned, weight, on_list FROM masteries")
def topic_mastery(spark, sf_dir):
    return rounded(masteries(spark, sf_dir), "mastery")


@query(f"WITH {TABLES}, {TOPICS} SELECT subject_id, section_id, round(coalesce(avg(mastery) FILTER (items > 0), 0), 6) AS mastery, count(*) AS topics FROM masteries GROUP BY subject_id, section_id")
def section_mastery(spark, sf_dir):
    return rounded(R.section_mastery(masteries(spark, sf_dir)), "mastery")


@query(f"""WITH {TABLES}, e AS (SELECT subject_id, min(date) AS exam_date FROM exam WHERE date >= DATE '2024-01-31' GROUP BY subject_id),
i AS (SELECT x.*, e.exam_date FROM ({ITEMS}) x LEFT JOIN e USING (subject_id))
SELECT s.subject_id, s.name, round(coalesce(avg({recall_sql(T)}) FILTER (i.item_id IS NOT NULL), 0), 6) AS mastery, count(i.item_id) AS items, count(*) FILTER (i.reps > 0) AS learned, min(e2.exam_date) AS exam_date,
  round(avg({recall_sql("(CAST(i.exam_date AS TIMESTAMP) + INTERVAL 9 HOUR)")}) FILTER (i.exam_date IS NOT NULL), 6) AS readiness
FROM subject s LEFT JOIN i ON i.subject_id = s.subject_id LEFT JOIN e e2 ON e2.subject_id = s.subject_id WHERE s.status <> 'archived' GROUP BY s.subject_id, s.name""")
def subject_mastery_readiness(spark, sf_dir):
    out = R.subject_mastery(B.review_item(spark, sf_dir), B.material(spark, sf_dir), B.topic(spark, sf_dir), B.subject(spark, sf_dir), B.exam(spark, sf_dir), NOW)
    return rounded(out, "mastery", "readiness")


@query(f"""WITH {TABLES}, {TOPICS} SELECT m.topic_id, s.name AS subject, m.items, m.learned, round((0.3 + m.weight) * (1 - m.mastery), 6) AS worth FROM masteries m JOIN subject s USING (subject_id)
WHERE s.status = 'active' AND (m.items > 0 OR m.on_list) AND NOT (m.items > 0 AND m.learned = m.items AND m.mastery >= 0.9) ORDER BY (0.3 + m.weight) * (1 - m.mastery) DESC, m.topic_id LIMIT 5""")
def today_focus_top5(spark, sf_dir):
    return rounded(R.today_focus(masteries(spark, sf_dir), B.subject(spark, sf_dir)), "worth")


@query(f"""WITH {TABLES} SELECT material_id, arg_min(field_type, slot_order) AS slot FROM material_field JOIN topic_field USING (field_id) GROUP BY material_id""")
def material_slot(spark, sf_dir):
    return R.material_slots(B.material_field(spark, sf_dir), B.topic_field(spark, sf_dir))


PARTS = f"""slots AS (SELECT material_id, arg_min(field_type, slot_order) AS slot FROM material_field JOIN topic_field USING (field_id) GROUP BY material_id),
slotted AS (SELECT m.material_id, m.topic_id, m.status, s.slot FROM material m JOIN slots s USING (material_id) WHERE m.status IN ('active', 'pending')),
points AS (SELECT topic_id, field_type AS slot, count(*) AS points FROM topic_field WHERE status = 'active' GROUP BY ALL),
made AS (SELECT topic_id, slot, count(*) AS materials FROM slotted GROUP BY ALL),
learned AS (SELECT s.topic_id, s.slot, count(*) AS items, count(*) FILTER (reps > 0) AS learned, avg({recall_sql(T)}) AS mastery FROM review_item JOIN slotted s USING (material_id) WHERE s.status = 'active' AND NOT suspended GROUP BY ALL),
parts AS (SELECT topic_id, slot, coalesce(points, 0) AS points, coalesce(materials, 0) AS materials, coalesce(items, 0) AS items, coalesce(learned, 0) AS learned, round(coalesce(mastery, 0), 6) AS mastery,
  points IS NOT NULL AND materials IS NULL AS uncovered FROM points FULL JOIN made USING (topic_id, slot) LEFT JOIN learned USING (topic_id, slot))"""


def parts(spark, sf_dir):
    return R.topic_parts(B.topic(spark, sf_dir), B.topic_field(spark, sf_dir), B.material(spark, sf_dir), B.material_field(spark, sf_dir), B.review_item(spark, sf_dir), NOW)


@query(f"WITH {TABLES}, {PARTS} SELECT * FROM parts")
def topic_schema_parts(spark, sf_dir):
    return rounded(parts(spark, sf_dir), "mastery")


@query(f"WITH {TABLES}, {PARTS} SELECT topic_id, slot FROM parts WHERE uncovered")
def uncovered_parts(spark, sf_dir):
    return parts(spark, sf_dir).where("uncovered").select("topic_id", "slot")


@query(f"""WITH {TABLES} SELECT topic_id, name, (SELECT count(*) FROM topic_field f WHERE f.topic_id = t.topic_id AND status = 'active') AS fields,
(SELECT count(DISTINCT field_type) FROM topic_field f WHERE f.topic_id = t.topic_id AND status = 'active') AS parts, (SELECT count(*) FROM material m WHERE m.topic_id = t.topic_id AND status = 'active') AS active,
(SELECT count(*) FROM material m WHERE m.topic_id = t.topic_id AND status = 'pending') AS pending,
(SELECT count(*) FROM review_item i JOIN material m USING (material_id) WHERE m.topic_id = t.topic_id AND m.status = 'active' AND reps > 0) AS started FROM topic t""")
def topic_list(spark, sf_dir):
    return R.topic_list(B.topic(spark, sf_dir), B.topic_field(spark, sf_dir), B.material(spark, sf_dir), B.review_item(spark, sf_dir))


@query(f"""WITH {TABLES} SELECT topic_id, coalesce(exam_weight_override, exam_weight) AS weight, fresh, seen FROM topic JOIN (SELECT m.topic_id, count(*) FILTER (reps = 0) AS fresh, count(*) FILTER (reps > 0) AS seen
FROM review_item JOIN material m USING (material_id) WHERE m.status = 'active' AND NOT m.synthesis AND NOT suspended GROUP BY m.topic_id) USING (topic_id) WHERE fresh >= 2 ORDER BY seen, weight DESC, topic_id LIMIT 3""")
def lesson_candidates(spark, sf_dir):
    return R.lesson_candidates(B.topic(spark, sf_dir), B.material(spark, sf_dir), B.review_item(spark, sf_dir))


@query(f"""WITH {TABLES} SELECT topic_id, count(DISTINCT material_id) AS fresh FROM material m WHERE status = 'active' AND NOT synthesis
AND NOT EXISTS (SELECT 1 FROM review_item i WHERE i.material_id = m.material_id AND i.reps > 0) GROUP BY topic_id""")
def fresh_materials(spark, sf_dir):
    return R.untouched_materials(B.material(spark, sf_dir), B.review_item(spark, sf_dir)).groupBy("topic_id").agg(F.count_distinct("material_id").alias("fresh"))


@query(f"""WITH {TABLES} SELECT subject_id, count(*) AS all, count(*) FILTER (m.status = 'active') AS active, count(*) FILTER (m.status = 'pending') AS pending, count(*) FILTER (m.status = 'needs_review') AS needs_review,
count(*) FILTER (m.status = 'rejected') AS rejected, count(*) FILTER (m.status = 'suspended') AS suspended FROM material m JOIN topic USING (topic_id) GROUP BY subject_id""".replace("AS all", 'AS "all"'))
def workshop_counts(spark, sf_dir):
    return R.status_counts(B.material(spark, sf_dir).join(B.topic(spark, sf_dir).select("topic_id", "subject_id"), "topic_id"), ["subject_id"])


@query("""SELECT lang AS model, count(*) AS outputs, count(*) FILTER (quality = 1) AS verified, round(count(*) FILTER (quality = 1) / count(*), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def model_verified_share(spark, sf_dir):
    rows = B.read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model")).join(B.read(spark, sf_dir, "labels"), "doc_id")
    return rounded(R.verified_share(rows, "model", F.col("quality") == 1), "share")


@query("""SELECT l_orderkey, CAST(CASE WHEN bool_and(l_quantity < 40) THEN 3 WHEN count(*) FILTER (l_quantity >= 40) = 1 AND count(*) >= 4 THEN 2 ELSE 1 END AS INTEGER) AS rating FROM lineitem GROUP BY l_orderkey""")
def list_rating(spark, sf_dir):
    lists = B.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") < 40).alias("items"))
    return lists.select("l_orderkey", R.list_rating(F.col("items")).cast("int").alias("rating"))


STAGE_LIST = ["signup", "view", "click", "purchase", "error"]


@query("""WITH d AS (SELECT user_id AS learner, event_type AS stage, count(*) AS drills, count(*) FILTER (event_id % 10 >= 0.5 * (5 + event_id % 7)) AS good, max(5 + event_id % 7) AS largest,
CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS place FROM events GROUP BY user_id, event_type)
SELECT *, good >= 6 AS done, coalesce(min(CAST(good >= 6 AS INTEGER)) OVER (PARTITION BY learner ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS unlocked FROM d""")
def course_status(spark, sf_dir):
    n = F.col("event_id")
    drills = B.read(spark, sf_dir, "events").select(F.col("user_id").alias("learner"), F.col("event_type").alias("stage"), (5 + n % 7).alias("size"), (n % 10).alias("correct"))
    return R.course_status(drills, STAGE_LIST, 6, 0.5)
